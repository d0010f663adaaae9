"""Places that the driver and all executors see, and tables kept there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see, from ``spark.checkpoint.dir``.

    It is set here only where the session leaves it unset, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        at = tempfile.mkdtemp(prefix="lexmill-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lexmill/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within this block Spark removes the shuffle files of each query as soon as that query has ended."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing later reads, wherever Spark can reach it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Stored:
    """The rows of a DataFrame, computed once and kept as Parquet in the shared folder until ``drop``.

    Rows may hold values of megabytes, so row groups are small and their size is looked at after few rows."""

    OPTIONS = {"compression": "none", "parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "16", "parquet.enable.dictionary": "false"}

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.schema, self.path = df.sparkSession, df.schema, shared_path(df.sparkSession, name)
        with shuffles_removed(self.spark):
            df.write.options(**self.OPTIONS).parquet(self.path)

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)
