"""Positions of rows within their keys when one key may hold a third of all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from lexmill.llm.common import cut
from lexmill.shipping import ship


def _run_positions(key: str):
    """The task's number and each row's position in the run of its key within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            column = batch.column(key)
            value, null = column.fill_null(0).to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
            new = np.ones(n, bool)
            new[1:] = (value[1:] != value[:-1]) | (null[1:] != null[:-1])
            at = np.arange(n)
            pos = at - np.maximum.accumulate(np.where(new, at, 0))
            own = (int(value[0]), bool(null[0]))
            if own == last:
                run = int(np.append(np.flatnonzero(new[1:]) + 1, n)[0])
                pos[:run] += held
            last, held = (int(value[-1]), bool(null[-1])), int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(pos)], names=[*batch.schema.names, "_part", "_pos"])

    return run


def numbered(rows: DataFrame, key: str, order: list[Column], ranges: list[Column] | None = None) -> DataFrame:
    """``rows`` (none of their columns named _part, _pos or _before) with ``pos``, from 0, in each key's ``order``.

    ``key`` is a bigint column; null is a key of its own.  Rows are dealt out by ranges of key and ``ranges`` (what
    orders rows alike, ``order`` itself where it is short), so a key of any size spreads over tasks.  A task counts
    on from what its first key has in the tasks before, a row for each task at most."""
    ship(rows.sparkSession)
    schema = StructType([*rows.schema.fields, StructField("_part", IntegerType()), StructField("_pos", LongType())])
    dealt = rows.repartitionByRange(F.col(key), *(ranges or order)).sortWithinPartitions(F.col(key), *order)
    dealt = cut(dealt.mapInArrow(_run_positions(key), schema))
    runs = dealt.groupBy("_part", key).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    carried = runs.select(F.col("_part").alias("_of"), F.col(key).alias("_key"), before.alias("_before")).filter("_before > 0")
    joined = dealt.join(F.broadcast(carried), (F.col("_part") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.select(*rows.columns, (F.col("_pos") + F.coalesce("_before", F.lit(0))).alias("pos"))
