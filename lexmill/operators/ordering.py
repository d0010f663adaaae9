"""Ordered work on groups of any size: a group spreads over tasks in ranges of its order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from lexmill.storage import shared_dir, shuffles_removed


def new_runs(batch: pa.RecordBatch, by: list[str]) -> np.ndarray:
    """Which rows differ from the one before in a column of ``by``; null equals null."""
    out = np.zeros(batch.num_rows, bool)
    out[:1] = True
    for name in by:
        column = batch.column(name)
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        differ = pc.if_else(pc.or_(pc.is_null(a), pc.is_null(b)), pc.xor(pc.is_null(a), pc.is_null(b)), pc.not_equal(a, b))
        out[1:] |= differ.to_numpy(zero_copy_only=False).astype(bool)
    return out


def key_of(batch: pa.RecordBatch, by: list[str], row: int) -> tuple:
    return tuple(batch.column(name)[row].as_py() for name in by)


def _positions(by: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new, at = new_runs(batch, by), np.arange(batch.num_rows)
            pos = at - np.maximum.accumulate(np.where(new, at, 0))
            if key_of(batch, by, 0) == last:
                pos[: int(np.append(np.flatnonzero(new[1:]) + 1, len(pos))[0])] += held
            last, held = key_of(batch, by, len(pos) - 1), int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(pos), part, np.int32)), pa.array(pos)], names=[*batch.schema.names, "_part", "_pos"])

    return run


def numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, from 0, in the ``order`` of each group of ``by`` (columns of plain values; null is one).

    A task counts on from what its first group has in the tasks before it: a row for each task at most."""
    schema = StructType([*rows.schema.fields, StructField("_part", IntegerType()), StructField("_pos", LongType())])
    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).mapInArrow(_positions(by), schema)
    shared_dir(rows.sparkSession)
    with shuffles_removed(rows.sparkSession):
        dealt = dealt.checkpoint()
    runs = dealt.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    carried = runs.select("_part", *by, before.alias("_before")).filter("_before > 0")
    names = {c: f"_of{k}" for k, c in enumerate(["_part", *by])}
    carried = carried.withColumnsRenamed(names)
    match = F.lit(True)
    for c, other in names.items():
        match = match & F.col(c).eqNullSafe(F.col(other))
    return dealt.join(F.broadcast(carried), match, "left").select(*rows.columns, (F.col("_pos") + F.coalesce("_before", F.lit(0))).alias("pos"))


def folded_runs(rows: DataFrame, by: list[str], order: str, maps, combine, columns: list[str], schema: str) -> DataFrame:
    """A row for each group and task, in the order of ``_part``: what ``combine`` makes of the group's rows there.

    ``maps(batch)`` gives a matrix with a row for each of the batch's, ``combine(first, second)`` puts matrices together
    row by row and must be associative; the runs of a batch are combined pairwise, all runs at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held_key, held = None, None

        def out(keys: list[tuple], values: np.ndarray) -> pa.RecordBatch:
            kinds = [empty.schema.field(name).type for name in by]
            arrays = [pa.array([k[i] for k in keys], kind) for i, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(len(keys), part, np.int32)), *(pa.array(values[:, i]) for i in range(values.shape[1]))], names=[*by, "_part", *columns])

        for batch in batches:
            empty = batch.slice(0, 0)
            if not batch.num_rows:
                continue
            starts = np.flatnonzero(new_runs(batch, by))
            values, size = maps(batch), np.diff(np.append(starts, batch.num_rows))
            while len(values) > len(size):  # neighbours of a run become one
                ends = np.cumsum(size)
                at = np.arange(len(values)) - np.repeat(ends - size, size)
                first = np.flatnonzero(at % 2 == 0)
                paired = (at[first] + 1) < np.repeat(size, size)[first]
                merged = values[first]
                merged[paired] = combine(merged[paired], values[first[paired] + 1])
                values, size = merged, (size + 1) // 2
            keys = [key_of(batch, by, int(k)) for k in starts]
            if held_key is not None:
                if keys[0] == held_key:
                    values[:1] = combine(held, values[:1])
                else:
                    yield out([held_key], held)
            if len(keys) > 1:
                yield out(keys[:-1], values[:-1])
            held_key, held = keys[-1], values[-1:].copy()
        if held_key is not None:
            yield out([held_key], held)

    ranged = rows.repartitionByRange(*by, order).sortWithinPartitions(*by, order)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema.fields)
    return ranged.mapInArrow(run, f"{kinds}, _part int, {schema}")
