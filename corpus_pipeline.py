"""The corpus pipeline: quality classifier, near-duplicates, repeated passages, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  All but the last return
the columns of documents; where a stage changes a text, ``n_chars`` follows it.

In every stage null and empty texts are texts of no words, texts of any length are taken whole, more columns travel
along whatever their names, and an empty table gives an empty table.  A null doc_id is an id of its own for the
classifier, which scores each row by itself; it is compared with nothing when near-duplicates go and stays; it counts
as the smallest one for passages; rows without id go together when one of them holds a benchmark item.  Rows that
repeat an id stay or go together: as near-duplicates they are one document, so exact copies under one id all stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import chosen_path, fm_quality, packing, qgram_decontam, substring_dedup
from lexmill.llm.common import crc_mod, shared_path, table
from lexmill.shipping import ship


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good; it learns from two thirds of the labels."""
    ship(spark)
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    machine = fm_quality.fit(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return fm_quality.keep_good(docs, machine)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates."""
    ship(spark)
    return chosen_path.first_of_each(docs, chosen_path.near_duplicates(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that an earlier document or place has; documents of which
    nothing is left go."""
    ship(spark)
    return substring_dedup.with_kept_text(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship(spark)
    return qgram_decontam.without_leaks(docs, qgram_decontam.leaks(docs, table(spark, sf_dir, "benchmark"), passage=qgram_decontam.PASSAGE))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' tokens and their places in sequences."""
    ship(spark)
    return packing.packed_digests(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]
#: No stage but the last could be written in SQL: a trained model, a similarity join, an index and alignments.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
