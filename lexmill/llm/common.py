"""What the operators of this subpackage share: tables, words, and places that all executors see."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.shipping import ship
from lexmill.storage import Stored, shared_dir, shared_path, shuffles_removed

__all__ = ["Stored", "crc_mod", "cut", "lower_ascii", "shared_dir", "shared_path", "table", "text_buckets", "words"]

#: A word: a run of characters other than ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
_SPACES = re.compile("[\x20\x09-\x0d]+")
_UPPER = {c: c + 32 for c in range(65, 91)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[str]:
    """The words of a text (none for null)."""
    return [w for w in _SPACES.split(text) if w] if text else []


def lower_ascii(text: str) -> str:
    return text.translate(_UPPER)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` computed once and kept in the shared folder, without their lineage.

    What lies in the shared folder outlives lost executors, so the shuffle files behind it go at once."""
    shared_dir(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.checkpoint(eager=True)


#: Text in bytes for each bucket of what a corpus is compared by; half of what fits well into a worker's memory.
BUCKET_BYTES = 24 << 20


def text_buckets(docs: DataFrame, column: str = "text") -> int:
    """Buckets for comparing the texts of ``docs``: as many as their size asks for, and the session's number of
    shuffle partitions at least."""
    size = docs.agg(F.sum(F.octet_length(column).cast("bigint")).alias("n")).first()["n"] or 0
    return max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
