"""A calibrated two-lane language model as column expressions over joined counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.config import DEFAULT, Config
from lexmill.operators.ordering import folded_runs


def add_k(frequency: Column, total: Column, config: Config = DEFAULT) -> Column:
    return (F.coalesce(frequency, F.lit(0)) + config.add_k) / (total + config.add_k * config.vocabulary)


def interpolated(pair: Column, first: Column, unigram: Column, config: Config = DEFAULT) -> Column:
    """Weighted pair and single probability; the single one alone where the first word is unknown."""
    known = F.coalesce(first, F.lit(0)) > 0
    return F.when(known, config.bigram_weight * F.coalesce(pair, F.lit(0)) / F.nullif(first, F.lit(0)) + (1 - config.bigram_weight) * unigram).otherwise(unigram)


def z_score(probability: Column, total: Column, mu: Column, sigma: Column, config: Config = DEFAULT) -> Column:
    return (F.log(probability) - (mu - F.log(total + config.add_k * config.vocabulary))) / sigma


def blend(z_primary: Column, z_secondary: Column, p_primary: Column, config: Config = DEFAULT) -> Column:
    """log of the mixture of both lanes."""
    p = F.least(F.greatest(p_primary, F.lit(1e-6)), F.lit(1 - 1e-6))
    a, b = F.log(p) + config.temperature * z_primary, F.log(1 - p) + config.temperature * z_secondary
    high = F.greatest(a, b)
    return high + F.log(F.exp(a - high) + F.exp(b - high))


def lane_evidence(z_primary: Column, z_secondary: Column, known_primary: Column, known_secondary: Column, config: Config = DEFAULT) -> Column:
    """How far a word speaks for the primary lane: its margin outside the dead zone, capped."""
    floor = F.lit(config.evidence_floor)
    a = F.when(known_primary, z_primary).otherwise(F.greatest(z_primary, floor))
    b = F.when(known_secondary, z_secondary).otherwise(F.greatest(z_secondary, floor))
    margin = a - b
    beyond = F.signum(margin) * (F.abs(margin) - config.evidence_dead_zone)
    return F.when(F.abs(margin) <= config.evidence_dead_zone, 0.0).otherwise(F.least(F.greatest(beyond, F.lit(-config.evidence_cap)), F.lit(config.evidence_cap)))


def lane_step(p: Column, evidence: Column) -> Column:
    """One word: a little mixing, the evidence's odds, and bounds."""
    mixed = 0.92 * p + 0.08 * (1 - p)
    odds = mixed / (1 - mixed) * F.exp(evidence)
    return F.least(F.greatest(odds / (1 + odds), F.lit(0.1)), F.lit(0.9))


def boundary_step(p: Column) -> Column:
    return 0.5 + (p - 0.5) * 0.8


_MAP = ["a", "b", "c", "d", "low", "high"]


def _step_maps(batch: pa.RecordBatch) -> np.ndarray:
    """Each step as p -> (a p + b) / (c p + d) between two bounds: a rising map, whatever the evidence."""
    column = batch.column("evidence")
    evidence, boundary = column.fill_null(0.0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)
    odds = np.exp(np.minimum(evidence, 0)), np.exp(np.minimum(-evidence, 0))  # of one word for either lane, none of them above 1
    out = np.empty((len(evidence), 6))
    out[:, 0], out[:, 1] = 0.84 * odds[0], 0.08 * odds[0]
    out[:, 2], out[:, 3] = 0.84 * (odds[0] - odds[1]), 0.08 * odds[0] + 0.92 * odds[1]
    out[:, 4], out[:, 5] = 0.1, 0.9
    out[boundary] = (0.8, 0.1, 0.0, 1.0, 0.0, 1.0)
    return out


def _at(maps: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.clip((maps[:, 0] * p + maps[:, 1]) / (maps[:, 2] * p + maps[:, 3]), maps[:, 4], maps[:, 5])


def _then(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One map for two in a row: bounds of the first go through the second, which rises."""
    a, b, c, d = (first[:, k] for k in range(4))
    e, f, g, h = (second[:, k] for k in range(4))
    both = np.stack([e * a + f * c, e * b + f * d, g * a + h * c, g * b + h * d], axis=1)
    both /= np.abs(both).max(axis=1, keepdims=True)  # only ratios count
    return np.column_stack([both, _at(second, first[:, 4]), _at(second, first[:, 5])])


def lane_posterior(steps: DataFrame, by: list[str], order: str) -> DataFrame:
    """The filter over each session's words in order: evidence, or null at a sentence boundary.

    A step is a rising fractional map between two bounds, and so are steps in a row: each task makes one map of the part
    of a session that it has, and a session's few maps, one for each task that it meets, are applied in their order."""
    rows = steps.select(*by, order, F.col("evidence").cast("double").alias("evidence"))
    maps = folded_runs(rows, by, order, _step_maps, _then, _MAP, ", ".join(f"{c} double" for c in _MAP))
    ordered = F.array_sort(F.collect_list(F.struct("_part", *_MAP)))
    apply = lambda p, m: F.least(F.greatest((m["a"] * p + m["b"]) / (m["c"] * p + m["d"]), m["low"]), m["high"])
    return maps.groupBy(*by).agg(F.aggregate(ordered, F.lit(0.5), apply).alias("p_primary"))


def _lanes(config: Config) -> tuple[tuple[str, str], ...]:
    return ("primary", config.primary), ("secondary", config.secondary)


def by_lane(counts: DataFrame, keys: list[str], prefix: str, config: Config = DEFAULT) -> DataFrame:
    """``keys`` with their frequency in each lane side by side, from one scan of (lane, keys, frequency)."""
    counts = counts.filter(F.col("lane").isin(config.primary, config.secondary))
    return counts.groupBy(*keys).agg(*[F.max(F.when(F.col("lane") == lane, F.col("frequency"))).alias(f"{prefix}_{name}") for name, lane in _lanes(config)])


def with_scores(words: DataFrame, unigram: DataFrame, scale: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``words`` (word, ...) with frequency and z in both lanes; ``scale`` has mu, sigma and total of each lane."""
    of = lambda column, lane: F.max(F.when(F.col("lane") == lane, F.col(column)))
    one = scale.agg(*[of(column, lane).alias(f"{short}_{name}") for name, lane in _lanes(config) for short, column in (("mu", "mu"), ("sigma", "sigma"), ("n", "total"))])
    out = words.join(by_lane(unigram, ["word"], "f", config), "word", "left").crossJoin(F.broadcast(one))  # a single row
    for name, _ in _lanes(config):
        p = add_k(F.col(f"f_{name}"), F.col(f"n_{name}"), config)
        out = out.withColumn(f"p_{name}", p).withColumn(f"z_{name}", z_score(p, F.col(f"n_{name}"), F.col(f"mu_{name}"), F.col(f"sigma_{name}"), config))
    return out


def with_pair_scores(rows: DataFrame, unigram: DataFrame, bigram: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Rows of ``with_scores`` that also have ``previous``: z of the word after that word in both lanes."""
    first = by_lane(unigram, ["word"], "first", config).withColumnRenamed("word", "previous")
    pair = by_lane(bigram.withColumnsRenamed({"w1": "previous", "w2": "word"}), ["previous", "word"], "pair", config)
    out = rows.join(first, "previous", "left").join(pair, ["previous", "word"], "left")
    for name, _ in _lanes(config):
        p = interpolated(F.col(f"pair_{name}"), F.col(f"first_{name}"), F.col(f"p_{name}"), config)
        out = out.withColumn(f"zp_{name}", z_score(p, F.col(f"n_{name}"), F.col(f"mu_{name}"), F.col(f"sigma_{name}"), config))
    return out


def ranked(rows: DataFrame, by: list[str], limit: int, rounded: str = "score", word: str = "word", score: str = "score") -> DataFrame:
    """Rank by the (rounded) score, then word, with the softmax of the unrounded score over the first eight as confidence."""
    order = Window.partitionBy(*by).orderBy(F.col(rounded).desc(), F.col(word))
    rows = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(8, limit))
    group = Window.partitionBy(*by)
    head = F.when(F.col("rank") <= 8, F.col(score))
    rows = rows.withColumn("_e", F.exp(F.col(score) - F.max(head).over(group)))
    rows = rows.withColumn("confidence", F.col("_e") / F.sum(F.when(F.col("rank") <= 8, F.col("_e"))).over(group))
    return rows.filter(F.col("rank") <= limit).drop("_e")


def margins(rows: DataFrame, by: list[str], score: str = "score", word: str = "word") -> DataFrame:
    """The winner of each group and how far it is ahead (null if alone)."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(word))
    rows = rows.withColumn("rank", F.row_number().over(order)).withColumn("margin", F.col(score) - F.lead(score).over(order))
    return rows.filter("rank = 1").drop("rank")
