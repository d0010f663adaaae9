"""Folding an append-only event log into personal snapshots: counts, decay, caps, moments and indexes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.ordering import numbered


def committed(events: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The word commits among events (seq, day, kind, word, previous, hint): wc as it is, sa and cr in an unknown
    language and without a previous word, wt as an explicit mark; deleted words are left out."""
    rows = events.filter(F.col("kind").isin("wc", "sa", "cr", "wt") & F.col("word").isNotNull())
    rows = rows.select("seq", "day", "kind", "word", F.when(F.col("kind") == "wc", F.col("previous")).alias("previous"), F.when(F.col("kind") == "wc", F.col("hint")).otherwise("un").alias("hint"))
    return rows.join(tombstones.select("word"), "word", "left_anti")


def fold_words(commits: DataFrame, days: int = 8) -> DataFrame:
    """Count, counts by language, explicit mark, and the first ``days`` distinct days by arrival, sorted.

    A word's days are reduced to one row a day before they meet, so a frequent word stays small."""
    by_day = commits.groupBy("word", "day").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"), F.bool_or(F.col("kind") == "wt").alias("explicit"), *(F.count_if(F.col("hint") == h).alias(h) for h in ("is", "en", "un"))
    )
    order = Window.partitionBy("word").orderBy("first")
    by_day = by_day.withColumn("_at", F.row_number().over(order))
    return by_day.groupBy("word").agg(
        F.sum("n").alias("count"), *(F.sum(h).alias(f"count_{h}") for h in ("is", "en", "un")), F.bool_or("explicit").alias("explicit"),
        F.array_sort(F.collect_list(F.when(F.col("_at") <= days, F.col("day")))).alias("days"),
    )


def fold_pairs(commits: DataFrame, tombstones: DataFrame) -> DataFrame:
    pairs = commits.filter(F.col("previous").isNotNull()).groupBy("previous", "word").agg(F.count(F.lit(1)).alias("count"))
    return pairs.join(tombstones.select(F.col("word").alias("previous")), "previous", "left_anti")


def learned(words: DataFrame) -> Column:
    """Marked by the user, or seen on two days."""
    return F.col("explicit") | (F.size("days") >= 2)


def decayed(words: DataFrame, limit: int, factor: float = 0.5) -> DataFrame:
    """If all counts together exceed ``limit``, each count times ``factor``, cut to an integer; words at zero go
    unless they are explicit."""
    total = words.agg(F.sum("count").alias("_total"))
    count = F.when(F.col("_total") > limit, (F.col("count") * factor).cast("bigint")).otherwise(F.col("count"))
    return words.crossJoin(F.broadcast(total)).withColumn("count", count).filter((F.col("count") > 0) | F.col("explicit")).drop("_total")


def capped_words(words: DataFrame, cap: int) -> DataFrame:
    """Beyond ``cap`` words those of the lowest counts go; explicit ones always stay.

    The rest is a top-k, which each partition cuts first; only its ``cap`` rows are ranked in one task."""
    kept = F.broadcast(words.filter("explicit").agg(F.count(F.lit(1)).alias("_kept")))  # a single row
    best = words.filter(~F.col("explicit")).orderBy(F.col("count").desc(), F.col("word").desc()).limit(cap)
    ranked = best.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("count").desc(), F.col("word").desc())))
    return words.filter("explicit").unionByName(ranked.crossJoin(kept).filter(F.col("_rank") + F.col("_kept") <= cap).drop("_rank", "_kept"))


def capped_pairs(pairs: DataFrame, cap: int) -> DataFrame:
    return pairs.orderBy(F.col("count").desc(), "previous", "word").limit(cap)


def moments(touches: DataFrame, by: str = "key") -> DataFrame:
    """Count, means, sample variances and covariance of (dx, dy) for each key."""
    return touches.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("dx").alias("mean_dx"), F.avg("dy").alias("mean_dy"), F.var_samp("dx").alias("var_dx"), F.var_samp("dy").alias("var_dy"), F.covar_samp("dx", "dy").alias("cov"),
    )


def shrunk(stats: DataFrame, prior: float = 0.49, weight: int = 50, least: int = 30, floor: float = 0.08, rho: float = 0.9) -> DataFrame:
    """Moments pulled towards a prior by their number; null with fewer than ``least`` rows; correlation bounded."""
    w = F.col("n") / (F.col("n") + weight)
    enough = F.col("n") >= least
    sx = F.sqrt(F.greatest(w * F.col("var_dx") + (1 - w) * prior, F.lit(floor**2)))
    sy = F.sqrt(F.greatest(w * F.col("var_dy") + (1 - w) * prior, F.lit(floor**2)))
    bounded = F.least(F.greatest(w * F.col("cov") / (sx * sy), F.lit(-rho)), F.lit(rho))
    return stats.select("*", *(F.when(enough, x).alias(n) for n, x in (("shift_x", w * F.col("mean_dx")), ("shift_y", w * F.col("mean_dy")), ("sigma_x", sx), ("sigma_y", sy), ("rho", bounded))))


def halvings(limit: int, factor: float) -> tuple[np.ndarray, int]:
    """After how many rows the weight of all is cut, until weights repeat, and the cut from which they do.

    Weights are those of a fold in double precision, in which they come back to one that was there before."""
    rows, weight, cuts, seen = 0, 0.0, [], {}
    while weight not in seen:
        seen[weight] = len(cuts)
        while weight <= limit:
            weight, rows = weight + 1, rows + 1
        weight *= factor
        cuts.append(rows)
        if len(cuts) > 100_000:
            raise ValueError(f"weights below {limit} times {factor} do not come back")
    return np.array(cuts, np.int64), seen[weight]


def cuts_until(rows: np.ndarray, cuts: np.ndarray, again: int) -> np.ndarray:
    """How often weight was cut once so many rows were there: ``cuts``, whose part behind number ``again`` - 1 repeats."""
    start = int(cuts[again - 1]) if again else 0
    period, count = int(cuts[-1]) - start, len(cuts) - again
    turns = np.maximum(rows - start, 0) // period
    return np.searchsorted(cuts, rows - turns * period, side="right") + turns * count


def _merged(a: Column, b: Column, factor: Column) -> Column:
    """Moments ``a``, weighted by ``factor``, and ``b`` together: n, means, sums of squares and of products, decay."""
    n = a["n"] * factor
    total = n + b["n"]
    share = F.when(total > 0, b["n"] / total).otherwise(0.0)
    dx, dy = b["mx"] - a["mx"], b["my"] - a["my"]
    cross = n * share
    return F.struct(
        total.alias("n"), (a["mx"] + dx * share).alias("mx"), (a["my"] + dy * share).alias("my"), (a["sx"] * factor + b["sx"] + dx * dx * cross).alias("sx"),
        (a["sy"] * factor + b["sy"] + dy * dy * cross).alias("sy"), (a["c"] * factor + b["c"] + dx * dy * cross).alias("c"), (a["decay"] * b["decay"]).alias("decay"),
    )


def _in_order(parts: Column) -> Column:
    """Fold of parts in order: what is there decays by each part's own decay first."""
    start = F.struct(*(F.lit(0.0).alias(c) for c in ("n", "mx", "my", "sx", "sy", "c")), F.lit(1.0).alias("decay"))
    return F.aggregate(parts, start, lambda a, b: _merged(a, b, b["decay"]))


def decaying_moments(touches: DataFrame, limit: int = 500, factor: float = 0.5, block: int = 1000) -> DataFrame:
    """Moments whose weight is cut to ``factor`` whenever a key has more than ``limit`` rows, in the order of seq.

    Where cuts fall follows from counts alone, so the rows between two cuts are plain sums; stretches are put together
    in their order, ``block`` at a time and then blocks, each with the decay that it brings to what was before.  A key of
    any size spreads over tasks; ties of seq go by dx and dy; rows without dx or dy do not count."""
    cuts, again = halvings(limit, factor)

    @F.pandas_udf("long")
    def stretch(rows: pd.Series) -> pd.Series:
        return pd.Series(cuts_until(rows.to_numpy(np.int64), cuts, again))

    rows = numbered(touches.select("key", "seq", F.col("dx").cast("double").alias("dx"), F.col("dy").cast("double").alias("dy")).dropna(subset=["dx", "dy"]), ["key"], ["seq", "dx", "dy"])
    sums = rows.groupBy("key", stretch("pos").alias("stretch")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("dx").alias("mx"), F.avg("dy").alias("my"), F.var_pop("dx").alias("vx"), F.var_pop("dy").alias("vy"), F.covar_pop("dx", "dy").alias("vc"),
    )
    of = F.when(F.col("stretch") > 0, F.lit(factor)).otherwise(1.0)  # the cut at the end of the stretch before
    one = F.struct("stretch", "n", "mx", "my", (F.col("vx") * F.col("n")).alias("sx"), (F.col("vy") * F.col("n")).alias("sy"), (F.col("vc") * F.col("n")).alias("c"), of.alias("decay"))
    blocks = sums.groupBy("key", F.floor(F.col("stretch") / block).alias("block")).agg(_in_order(F.array_sort(F.collect_list(one))).alias("m"), F.sum("n").cast("bigint").alias("rows"))
    whole = blocks.groupBy("key").agg(_in_order(F.transform(F.array_sort(F.collect_list(F.struct("block", "m"))), lambda b: b["m"])).alias("m"), F.sum("rows").alias("rows"))
    cut_last = stretch("rows") > stretch(F.col("rows") - 1)  # a cut that falls on the very last row
    end = F.when(cut_last, F.lit(factor)).otherwise(1.0)
    n = F.col("m.n") * end
    per = F.when(n > 1, n - 1)
    return whole.select("key", n.alias("n"), F.col("m.mx").alias("mean_dx"), F.col("m.my").alias("mean_dy"), *((F.col(f"m.{a}") * end / per).alias(b) for a, b in (("sx", "var_dx"), ("sy", "var_dy"), ("c", "cov"))))


def case_index(words: DataFrame) -> DataFrame:
    """Surfaces folded by lower case: the most frequent surface (the first on a tie), summed counts, any mark."""
    best = F.struct(F.col("count"), F.negative("seq"))
    return words.groupBy(F.lower("word").alias("key")).agg(F.max_by("word", best).alias("surface"), F.sum("count").alias("count"), F.bool_or("explicit").alias("explicit"))


def overlay(snapshot: DataFrame, session: DataFrame) -> DataFrame:
    """Snapshot counts with one more for each word committed in the session."""
    both = snapshot.select("word", "count").unionByName(session.select("word", F.lit(1).cast("bigint").alias("count")))
    return both.groupBy("word").agg(F.sum("count").alias("count"))


def removed(words: DataFrame, pairs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words and pairs without some words, on either side of a pair."""
    left = pairs.join(gone.select(F.col("word").alias("previous")), "previous", "left_anti")
    return words.join(gone.select("word"), "word", "left_anti"), left.join(gone.select("word"), "word", "left_anti")
