"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are dealt out by ranges of ``doc_id`` and sorted within a range, each task encodes its range and
writes one file, so file statistics, row indexes and Bloom filters prune by ``doc_id`` and every stripe can
be read by a task of its own.  Positions in the whole corpus come from the counts of the ranges, never from
a global window.

Null or empty texts give a document of the end id alone; a null ``doc_id`` comes first; repeated rows with
one ``doc_id`` are ordered by a hash of their text and may lie in several files; texts of any length are taken whole; other columns are ignored, whatever
their names; an empty table gives empty files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lexmill.llm.common import shared_path
from lexmill.llm.encoding import encode_with_end, encoder, slices, vocabulary_path
from lexmill.shipping import ship

SCHEMA = "part int, doc_id bigint, start_in_part bigint, n_tokens bigint, ids array<int>"
_ARROW = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("start_in_part", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _encode_range(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, start = encoder(path), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, bounds = encode_with_end(enc, batch.column("text"), end_id)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, part, np.int32)), batch.column("doc_id"), pa.array(start + bounds[:-1]), pa.array(np.diff(bounds)), lists], schema=_ARROW)
                start += int(bounds[-1])

    return run


def write_token_ids(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 1, stripe_bytes: int = 64 << 20, row_stride: int = 10_000, bloom_fpp: float = 0.01, bloom_columns: str = "doc_id") -> None:
    """Encode ``docs`` (doc_id, text) and write them to ``path`` as ORC in ascending order of doc_id."""
    ship(docs.sparkSession)
    hashed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))  # splits rows that repeat an id
    ranged = hashed.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").drop("hash")
    (
        ranged.mapInArrow(_encode_range(vocabulary or vocabulary_path(), end_id), SCHEMA)
        .write.option("orc.bloom.filter.columns", bloom_columns)
        .option("orc.bloom.filter.fpp", str(bloom_fpp))
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(row_stride))
        .option("orc.stripe.size", str(stripe_bytes))
        .option("compression", "snappy")
        .orc(path)
    )


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """The files of ``write_token_ids``: doc_id, start (ids of all documents before it), n_tokens, ids.

    A filter on doc_id reaches the ORC reader, which skips stripes and row groups by statistics and Bloom
    filters; the starts come from one row of 12 bytes for each file."""
    rows = spark.read.schema(SCHEMA).orc(path)
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("part").alias("of_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    return rows.join(F.broadcast(starts), rows.part == starts.of_part).select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


@F.arrow_udf(LongType())
def ids_crc32(ids: pa.Array) -> pa.Array:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<u4").tobytes())
    at = ids.offsets.to_pylist()
    return pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:])], pa.int64())


def token_files(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1) -> DataFrame:
    """Write the documents' ids to files in the shared folder and read them back."""
    path = shared_path(docs.sparkSession, "token-ids")
    write_token_ids(docs, path, vocabulary, end_id)
    return read_token_ids(docs.sparkSession, path)
