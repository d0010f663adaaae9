"""Robust multivariate outliers: minimum covariance determinant estimates per language and source.

Five statistics of each text are transformed to a vector; for each (lang, source) the mean and covariance
of the most concentrated three quarters of the vectors are found by concentration steps from two starts: medians
and quartiles, and the covariance of scores clipped at two robust deviations.  The start that ends at the smaller
determinant counts, the first one on a tie; its estimate is reweighted, and a text is rejected if its squared Mahalanobis distance exceeds a
chi-square quantile.  Everything is DataFrame expressions: a text's statistics come from its own row, and
each step is one aggregation with a row for each group, however many rows a group has.

Groups of fewer than ``min_group`` rows share one estimate; if all of them together are fewer, none of them
is rejected by distance.  Each variance gets a floor, for statistics that are constant in clean text.  A
null text has no words; texts of any length are taken whole; null lang or source make groups of their own, and so
does a table without these columns; a null doc_id is judged like any other; repeated rows each count and are
judged alike; a distance equal to the cut-off is kept; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import SPACE_RUN, WORD, cut

KEYS = ["_lang", "_source"]
FEATURES = ("f_words", "f_word_chars", "f_symbols", "f_dup_lines", "f_repeats")
#: Smallest standard deviation of each feature.
FLOORS = (0.35, 0.06, 0.15, 0.12, 0.12)
P = len(FEATURES)
# Fixed values for 5 degrees of freedom: chi-square quantiles and consistency factors share / F7(quantile).
SHARE, SHARE_FACTOR = 0.75, 1.412
REWEIGHT_QUANTILE, REWEIGHT_FACTOR = 12.833, 1.055
CUTOFF = 30.856  # quantile of 0.99999


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside a 3-word window that is found twice or more among ``words`` (a column, not an expression)."""
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def starts(q: Column) -> Column:
        twice = F.filter(q, lambda e, k: (e["h"] == F.get(q, k - 1)["h"]) | (e["h"] == F.get(q, k + 1)["h"]))
        return F.sort_array(F.transform(twice, lambda e: e["i"]))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        at = let(ordered, starts)
        total = F.aggregate(
            at,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda acc, i: F.struct((acc["n"] + 3 - F.greatest(F.lit(0), acc["end"] - i)).alias("n"), (i + 3).alias("end")),
        )
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(total["n"])

    return F.when(n < 4, 0).otherwise(let(windows, covered))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, group keys, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and features."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = [F.coalesce(F.col(c).cast("string"), F.lit("\0null")) if c in docs.columns else F.lit("\0null") for c in ("lang", "source")]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), key[0].alias("_lang"), key[1].alias("_source"), text.alias("_text"), F.array_remove(F.split(text, SPACE_RUN), "").alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD))
    rows = rows.select(
        "doc_id", "_lang", "_source", F.size("_words").alias("n_words"), F.length(F.array_join("_words", "")).alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct"))).alias("_lines"),
        _repeat_words(F.col("_words")).alias("n_repeat_words"),
    )
    rows = rows.withColumn("n_dup_lines", F.col("_lines.n") - F.col("_lines.distinct"))
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    vector = (
        F.log(words.cast("double")), F.log(chars / words), F.log1p(100.0 * F.col("n_symbols") / chars),
        F.col("n_dup_lines") / F.greatest(F.col("_lines.n"), F.lit(1)), F.col("n_repeat_words") / words,
    )
    counts = [F.col(c).cast("bigint").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words").cast("bigint") > 50 * F.col("n_words").cast("bigint"))
    return rows.select("doc_id", "_lang", "_source", *counts, failed.alias("base_failed"), *(v.cast("double").alias(f) for v, f in zip(vector, FEATURES)))


def _with_factor(moments: DataFrame, factor: float, keys: list[str]) -> DataFrame:
    """Mean m_i and Cholesky factor l_i_j of the scaled covariance with its floors, for each group."""
    out = moments
    for i in range(P):
        for j in range(i + 1):
            value = F.coalesce(F.col(f"c_{i}_{j}"), F.lit(0.0)) * factor
            if i == j:
                value = value + FLOORS[i] ** 2
            for k in range(j):
                value = value - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(value, F.lit(1e-9))) if i == j else value / F.col(f"l_{j}_{j}"))
    return out.select(*keys, *(f"m_{i}" for i in range(P)), *(f"l_{i}_{j}" for i in range(P) for j in range(i + 1)))


def _distances(rows: DataFrame, estimates: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """``rows`` with their squared distance ``d2``; null where the group has no estimate."""
    out = rows.join(estimates, keys, "left")
    for i, f in enumerate(FEATURES):
        value = F.col(f) - F.col(f"m_{i}")
        for k in range(i):
            value = value - F.col(f"l_{i}_{k}") * F.col(f"z_{k}")
        out = out.withColumn(f"z_{i}", value / F.col(f"l_{i}_{i}"))
    d2 = sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(P)), F.lit(0.0))
    return out.select(*rows.columns, d2.alias("d2"))


def _moments(rows: DataFrame, chosen: Column, keys: list[str]) -> DataFrame:
    x = [F.when(chosen, F.col(f)) for f in FEATURES]
    aggregates = [F.avg(x[i]).alias(f"m_{i}") for i in range(P)]
    aggregates += [F.covar_pop(x[i], x[j]).alias(f"c_{i}_{j}") for i in range(P) for j in range(i + 1)]
    return rows.groupBy(*keys).agg(*aggregates)


def _starts(rows: DataFrame) -> DataFrame:
    """Both starts of each group: diagonal from the quartiles, and from scores clipped at two robust deviations."""
    quartiles = cut(rows.groupBy(*KEYS).agg(*(F.percentile_approx(f, [0.25, 0.5, 0.75], 2000).alias(f"q_{i}") for i, f in enumerate(FEATURES))))
    scale = lambda i: (F.get(F.col(f"q_{i}"), 2) - F.get(F.col(f"q_{i}"), 0)) / 1.349
    means = [F.get(F.col(f"q_{i}"), 1).alias(f"m_{i}") for i in range(P)]
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    plain = quartiles.select(*KEYS, *means, *(F.pow(scale(i), F.lit(2.0)).alias(f"c_{i}_{i}") if i == j else F.lit(0.0).alias(f"c_{i}_{j}") for i, j in pairs))
    scored = rows.join(quartiles, KEYS).select(*KEYS, *means, *(F.greatest(scale(i), F.lit(FLOORS[i])).alias(f"s_{i}") for i in range(P)), *FEATURES)
    clipped = [F.least(F.greatest((F.col(f) - F.col(f"m_{i}")) / F.col(f"s_{i}"), F.lit(-2.0)), F.lit(2.0)) * F.col(f"s_{i}") for i, f in enumerate(FEATURES)]
    joint = scored.groupBy(*KEYS).agg(*(F.first(f"m_{i}").alias(f"m_{i}") for i in range(P)), *(F.covar_pop(clipped[i], clipped[j]).alias(f"c_{i}_{j}") for i, j in pairs))
    return plain.withColumn("_start", F.lit(0)).unionByName(joint.withColumn("_start", F.lit(1)))


def fit(rows: DataFrame, steps: int = 3) -> DataFrame:
    """Estimates for each group of ``rows`` (group keys and features; a checkpoint or a table)."""
    keys = [*KEYS, "_start"]
    estimates = cut(_with_factor(_starts(rows), 1.0, keys))
    twice = rows.withColumn("_start", F.explode(F.array(F.lit(0), F.lit(1))))
    for _ in range(steps):
        near = _distances(twice, estimates, keys)
        bound = cut(near.groupBy(*keys).agg(F.percentile_approx("d2", SHARE, 2000).alias("bound")))
        inside = near.join(bound, keys)
        estimates = cut(_with_factor(_moments(inside, F.col("d2") <= F.col("bound"), keys), SHARE_FACTOR, keys))
    spread = sum((F.log(F.col(f"l_{i}_{i}")) for i in range(P)), F.lit(0.0))  # half the log of the determinant
    values = [c for c in estimates.columns if c not in keys]
    best = cut(estimates.groupBy(*KEYS).agg(F.min_by(F.struct(*values), F.struct(F.round(spread, 9), "_start")).alias("_best")).select(*KEYS, "_best.*"))
    return cut(_with_factor(_moments(_distances(rows, best), F.col("d2") <= REWEIGHT_QUANTILE, KEYS), REWEIGHT_FACTOR, KEYS))


def judge(docs: DataFrame, min_group: int = 50, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, the five counts, base_failed, distance (squared; null where nothing is estimated) and kept."""
    rows = cut(statistics(docs))
    sizes = rows.filter(~F.col("base_failed")).groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("_n"))
    large = cut(sizes.filter(F.col("_n") >= min_group).select("_lang", "_source", F.lit(True).alias("_large")))
    pooled = F.lit("\0small")
    rows = rows.join(large, ["_lang", "_source"], "left")
    rows = rows.withColumns({c: F.when(F.col("_large"), F.col(c)).otherwise(pooled) for c in ("_lang", "_source")}).drop("_large")
    learned = rows.filter(~F.col("base_failed")).select("_lang", "_source", *FEATURES)
    estimates = fit(learned)
    enough = learned.filter(F.col("_lang") == pooled).limit(min_group).count() >= min_group
    if not enough:
        estimates = estimates.filter(F.col("_lang") != pooled)
    near = _distances(rows, estimates)
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True))
    return near.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("d2").alias("distance"), kept.alias("kept"))
