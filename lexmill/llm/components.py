"""Connected components by alternating large-star and small-star steps, with a row for each edge at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """large: link every larger neighbour of u to the least of u and its neighbours; small: likewise the
    smaller neighbours and u itself."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """doc_id and component_id, the smallest id reachable, for every end of ``edges`` (u, v)."""
    edges = cut(edges.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            break
        seen = state
        edges = cut(_stars(_stars(edges, True), False))
    labels = edges.groupBy("u").agg(F.min("v").alias("component_id")).withColumnRenamed("u", "doc_id")
    roots = edges.select(F.col("v").alias("doc_id"), F.col("v").alias("component_id")).distinct()
    return labels.union(roots)
