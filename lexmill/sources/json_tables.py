"""JSON tables: case governors, calibration profiles, personal exports, and snapshots that are swapped whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOVERNOR = "map<string, struct<mass: double, p_case: array<double>, entropy_ratio: double, p_noun_slot: array<double>>>"
CALIBRATION = "schema string, addK double, meanLogFrequency double, stdLogFrequency double, warmupWords array<string>"


def read_governors(spark: SparkSession, path: str) -> DataFrame:
    """governor, mass, p_case, entropy_ratio and p_noun_slot of a (gzipped) JSON object; unknown keys are ignored."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", f"governors {GOVERNOR}").alias("j"))
    return text.select(F.explode("j.governors").alias("governor", "g")).select("governor", "g.*").filter(F.size("p_case") == 4)


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """add_k, mu, sigma and warm-up words of calibration profiles; profiles that are not valid are left out."""
    rows = spark.read.schema(CALIBRATION).json(path, multiLine=True)
    ok = (F.col("addK") > 0) & (F.col("stdLogFrequency") > 0) & ~F.isnan("meanLogFrequency") & ~F.isnan("stdLogFrequency")
    return rows.filter(ok).select(F.col("addK").alias("add_k"), F.col("meanLogFrequency").alias("mu"), F.col("stdLogFrequency").alias("sigma"), F.col("warmupWords").alias("warmup"))


def export_personal(words: DataFrame, pairs: DataFrame, version: int = 1) -> DataFrame:
    """One JSON document a word, sorted by word within each file: its count, mark and following words.

    A document a word, and not one for everything, so that an export of any size is written in parallel."""
    after = pairs.groupBy(F.col("previous").alias("word")).agg(F.array_sort(F.collect_list(F.struct(F.col("word").alias("next"), "count"))).alias("next"))
    rows = words.join(after, "word", "left").select("word", F.to_json(F.struct(F.lit(version).alias("version"), "word", "count", "explicit", F.coalesce("next", F.array()).alias("next"))).alias("value"))
    return rows.repartitionByRange("word").sortWithinPartitions("word").select("value")


def save_snapshot(df: DataFrame, path: str) -> None:
    """Write ``df`` beside ``path`` and put it in its place, so that readers see the old or the new table whole."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    staging, old = (f"{path}.{k}-{uuid.uuid4().hex}" for k in ("new", "old"))
    df.write.parquet(staging)
    to = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = to(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(to(path)):
        fs.rename(to(path), to(old))
    if not fs.rename(to(staging), to(path)):
        raise OSError(f"snapshot could not be put at {path}")
    fs.delete(to(old), True)
