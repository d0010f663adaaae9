"""Candidates for a typed word: edits, restorations, doubled letters, splits, completions, and their costs.

Every generator explodes a row into its own variants and joins them with the vocabulary at once; requests are
taken distinct first, so a word that is typed often is expanded once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from lexmill.config import ACUTE, DEFAULT, EDIT_ALPHABET, RESTORATIONS, Config, key_centers, substitution_cost
from lexmill.operators.alignment import channel_costs, rewrite_distances, typing_costs

INSERTION, DELETION, TRANSPOSITION = 4.0, 4.0, 2.0


def substitutions(typed: Column) -> Column:
    """Map from each letter of the alphabet to the cost of typing ``typed`` for it."""
    letters = sorted(set(EDIT_ALPHABET))
    table = F.create_map(*[F.lit(x) for a in letters for x in (a, "|".join(f"{substitution_cost(a, b)}" for b in letters))])
    costs = F.transform(F.split(F.coalesce(F.try_element_at(table, typed), F.lit("|".join(["5.0"] * len(letters)))), "\\|"), lambda c: c.cast("double"))
    return F.map_from_arrays(F.array(*[F.lit(x) for x in letters]), costs)


def edits(requests: DataFrame, typed: str = "typed") -> DataFrame:
    """typed, word and cost of every string one edit away, at its least cost.

    A word has hundreds of these, so the words are dealt out anew first: their own few bytes would leave them to one task.
    The one partition more than usual keeps Spark from dropping that for a grouping of the words just before it."""
    t = F.col(typed)
    n = F.length(t)
    requests = requests.repartition(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1, t)
    alphabet = F.array(*[F.lit(c) for c in EDIT_ALPHABET])
    at = requests.select(t.alias("typed"), F.explode(F.sequence(F.lit(1), n)).alias("i"))
    head, tail = F.left("typed", F.col("i") - 1), F.substr("typed", F.col("i") + 1, n)
    own = F.substr("typed", F.col("i"), F.lit(1))
    after = F.substr("typed", F.col("i") + 1, F.lit(1))
    length = F.length("typed")
    rest = F.substr("typed", F.col("i") + 2, length)
    tail = F.substr("typed", F.col("i") + 1, length)
    deleted = at.select("typed", F.concat(head, tail).alias("word"), F.lit(INSERTION).alias("cost"))
    swapped = at.filter((F.col("i") < length) & (own != after)).select("typed", F.concat(head, after, own, rest).alias("word"), F.lit(TRANSPOSITION).alias("cost"))
    replaced = at.select("typed", head.alias("h"), own.alias("o"), tail.alias("t"), F.explode(substitutions(own)).alias("c", "cost")).filter("c <> o").select("typed", F.concat("h", "c", "t").alias("word"), "cost")
    spots = requests.select(t.alias("typed"), F.explode(F.sequence(F.lit(0), n)).alias("i"))
    inserted = spots.select("typed", "i", F.explode(alphabet).alias("c")).select("typed", F.concat(F.left("typed", F.col("i")), "c", F.substr("typed", F.col("i") + 1, length)).alias("word"), F.lit(DELETION).alias("cost"))
    return deleted.union(swapped).union(replaced).union(inserted).groupBy("typed", "word").agg(F.min("cost").alias("cost"))


def restorations(requests: DataFrame, changes: int = 3, typed: str = "typed") -> DataFrame:
    """typed, word and number of changed letters: accents and special letters restored in up to ``changes`` places."""
    variants = F.create_map(*[F.lit(x) for a, b in RESTORATIONS.items() for x in (a, b)])
    rows = requests.select(F.col(typed).alias("typed"), F.col(typed).alias("word"), F.lit(0).alias("at"), F.lit(0).alias("changed"))
    out = None
    for _ in range(changes):
        step = rows.filter(F.col("at") < F.length("word")).select("*", F.explode(F.sequence(F.col("at") + 1, F.length("word"))).alias("i"))
        step = step.withColumn("v", F.try_element_at(variants, F.substr("word", F.col("i"), F.lit(1)))).filter("v IS NOT NULL")
        step = step.select("*", F.explode(F.split("v", "")).alias("c")).filter("c <> ''")
        word = F.concat(F.left("word", F.col("i") - 1), F.col("c"), F.substr("word", F.col("i") + 1, F.length("word")))
        rows = step.select("typed", word.alias("word"), F.col("i").alias("at"), (F.col("changed") + 1).alias("changed"))
        out = rows if out is None else out.union(rows)
    return out.select("typed", "word", "changed")


def geminations(requests: DataFrame, typed: str = "typed") -> DataFrame:
    """typed and word: a doubled letter made single, or the first of a run of letters doubled."""
    t = F.col(typed)
    at = requests.filter(F.length(t) >= 2).select(t.alias("typed"), F.explode(F.sequence(F.lit(1), F.length(t))).alias("i"))
    own, after, before = (F.substr("typed", F.col("i") + k, F.lit(1)) for k in (0, 1, -1))
    length = F.length("typed")
    single = at.filter((F.col("i") < length) & (own == after)).select("typed", F.concat(F.left("typed", F.col("i")), F.substr("typed", F.col("i") + 2, length)).alias("word"))
    fresh = (F.col("i") == 1) | (own != before)
    double = at.filter(fresh).select("typed", F.concat(F.left("typed", F.col("i")), F.substr("typed", F.col("i"), length)).alias("word"))
    return single.union(double).distinct()


def splits(requests: DataFrame, known: DataFrame, config: Config = DEFAULT, typed: str = "typed") -> DataFrame:
    """typed, left and right of the cuts nearest the middle whose halves are both known."""
    t = F.col(typed)
    cuts = requests.filter(F.length(t) >= config.split_min_length).select(t.alias("typed"), F.explode(F.sequence(F.lit(1), F.length(t) - 1)).alias("i"))
    order = Window.partitionBy("typed").orderBy(F.abs(2 * F.col("i") - F.length("typed")), "i")
    cuts = cuts.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= config.split_positions)
    halves = cuts.select("typed", F.left("typed", F.col("i")).alias("left"), F.substr("typed", F.col("i") + 1, F.length("typed")).alias("right"))
    words = known.select("word").distinct()
    return halves.join(words.withColumnRenamed("word", "left"), "left").join(words.withColumnRenamed("word", "right"), "right").select("typed", "left", "right")


def compounds(requests: DataFrame, modifiers: DataFrame, heads: DataFrame, least: int = 4, most: int = 32, word: str = "word") -> DataFrame:
    """The best cut of each word into one or two modifiers and a head: the longest head, then the fewest parts,
    then the shortest first part."""
    w = F.col(word)
    n = F.length(w)
    fit = requests.filter(n.between(2 * least, most) & w.rlike("^\\p{L}+$")).select(w.alias("word")).distinct()
    cut = fit.select("word", F.explode(F.sequence(F.lit(least), F.length("word") - least)).alias("i")).select("word", "i", F.left("word", F.col("i")).alias("region"), F.substr("word", F.col("i") + 1, F.length("word")).alias("head"))
    cut = cut.join(heads.select(F.col("word").alias("head")).distinct(), "head")
    ok = modifiers.select("word").distinct()
    one = cut.join(ok.withColumnRenamed("word", "region"), "region").select("word", "i", "head", F.array("region").alias("modifiers"), F.lit(0).alias("j"))
    two = cut.filter(F.col("i") >= 2 * least).select("*", F.explode(F.sequence(F.lit(least), F.col("i") - least)).alias("j"))
    two = two.select("word", "i", "head", "j", F.left("region", F.col("j")).alias("a"), F.substr("region", F.col("j") + 1, F.length("region")).alias("b"))
    two = two.join(ok.withColumnRenamed("word", "a"), "a").join(ok.withColumnRenamed("word", "b"), "b").select("word", "i", "head", F.array("a", "b").alias("modifiers"), "j")
    best = one.union(two).groupBy("word").agg(F.min_by(F.struct("modifiers", "head"), F.struct("i", F.size("modifiers").alias("parts"), "j")).alias("_b"))
    return best.select("word", "_b.modifiers", "_b.head")


def _deletes(rows: DataFrame, word: str, most: int) -> DataFrame:
    """The rows with every ``key`` that up to ``most`` deleted letters leave of the word."""
    keys = rows.withColumn("key", F.col(word))
    out = keys
    for _ in range(most):
        at = keys.filter(F.length("key") > 1).withColumn("_i", F.explode(F.sequence(F.lit(1), F.length("key"))))
        keys = at.withColumn("key", F.concat(F.left("key", F.col("_i") - 1), F.substr("key", F.col("_i") + 1, F.length("key")))).drop("_i").distinct()
        out = out.union(keys)
    return out.distinct()


def beam(requests: DataFrame, known: DataFrame, edits: int = 2, most_cost: float = 8.0, margin: float = 5.0, keep: int = 40, typed: str = "typed") -> DataFrame:
    """Known words within ``edits`` edits of each typed word, by typing cost: all of them, where a best-first search
    with a clock would give some.  Both sides meet on what is left after deletions, so it is an equi-join."""
    left = _deletes(requests.select(F.col(typed).alias("typed")).distinct(), "typed", edits)
    longest = F.broadcast(left.agg(F.max(F.length("typed")).alias("_longest")))  # a single row
    fit = known.select("word").distinct().crossJoin(longest).filter(F.length("word") <= F.col("_longest") + edits).select("word")
    right = _deletes(fit, "word", edits)
    pairs = left.join(right, "key").select("typed", "word").distinct().filter(F.levenshtein("typed", "word") <= 2 * edits)
    pairs = pairs.withColumn("cost", typing_cost("typed", "word")).filter(F.col("cost") <= most_cost)
    order = Window.partitionBy("typed").orderBy("cost", "word")
    best = F.min("cost").over(Window.partitionBy("typed"))
    return pairs.withColumn("_best", best).withColumn("rank", F.row_number().over(order)).filter((F.col("cost") <= F.col("_best") + margin) & (F.col("rank") <= keep)).drop("_best")


def decided(rows: DataFrame, margin: float = 1.15, most_cost: float = 6.0, least_length: int = 2, least_z: float = -2.5) -> DataFrame:
    """Whether the winner of each request may replace what was typed: one boolean column for each gate.

    rows: typed, word, cost, z, margin (null if alone), marks (marks preserved)."""
    gates = {
        "long_enough": F.length("typed") >= least_length,
        "cheap": F.col("cost") <= most_cost,
        "marks_kept": F.col("marks"),
        "typical": F.col("z") >= least_z,
        "ahead": F.col("margin").isNull() | (F.col("margin") >= margin),
    }
    out = rows.withColumns(gates)
    ok = None
    for g in gates:
        ok = F.col(g) if ok is None else ok & F.col(g)
    return out.withColumn("apply", ok)


def admitted(candidates: DataFrame, by: str = "typed") -> DataFrame:
    """One row for each candidate word (typed, word, provider, provider_order, cost): the first provider's cost."""
    return candidates.groupBy(by, "word").agg(F.min_by(F.struct("provider", "cost"), F.struct("provider_order", "cost")).alias("_f"), F.array_sort(F.collect_set("provider")).alias("providers")).select(by, "word", "_f.provider", "_f.cost", "providers")


def completion_cost(typed: Column, word: Column, channel: Column, config: Config = DEFAULT) -> Column:
    extra = F.length(word) - F.length(typed)
    return F.when((extra > 0) & word.startswith(typed), F.least(channel, config.completion_char_cost * extra)).otherwise(channel)


def preserved(typed: Column, word: Column, marks: str) -> Column:
    """The word has as many of the marks as were typed."""
    count = lambda x: F.length(x) - F.length(F.translate(x, marks, ""))
    return count(word) >= count(typed)


def fold_price(p: Column, low: float = 0.5, high: float = 0.75) -> Column:
    """Smoothstep weight of a lane by its posterior."""
    t = F.least(F.greatest((p - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return t * t * (3 - 2 * t)


def _complete(*columns: pd.Series) -> np.ndarray:
    """Which rows have no null in any column."""
    out = np.ones(len(columns[0]), bool)
    for c in columns:
        out &= c.notna().to_numpy()
    return out


@F.pandas_udf(DoubleType())
def typing_cost(typed: pd.Series, word: pd.Series) -> pd.Series:
    """Weighted edit distance with neighbouring letters swapped, by key distance; null for null."""
    out, there = pd.Series([None] * len(typed), dtype="float64"), _complete(typed, word)
    out[there] = typing_costs(typed[there].tolist(), word[there].tolist(), INSERTION, DELETION, TRANSPOSITION)
    return out


@F.pandas_udf(IntegerType())
def rewrite_distance(typed: pd.Series, word: pd.Series) -> pd.Series:
    """Edits that are no restoration: restored letters and apostrophes are free; null for null."""
    out, there = pd.Series([None] * len(typed), dtype="Int32"), _complete(typed, word)
    out[there] = rewrite_distances(typed[there].tolist(), word[there].tolist())
    return out


@F.pandas_udf(StructType([StructField("total", DoubleType()), StructField("error_ops", IntegerType()), StructField("restoration_ops", IntegerType())]))
def channel_cost(typed: pd.Series, word: pd.Series, p_primary: pd.Series) -> pd.DataFrame:
    """Typing cost with restorations priced by the lane, and how many errors and restorations it takes;
    among equal costs the one with fewer errors; nulls for null."""
    there = _complete(typed, word, p_primary)
    out = pd.DataFrame({"total": pd.Series([None] * len(typed), dtype="float64"), "error_ops": pd.Series([None] * len(typed), dtype="Int32"), "restoration_ops": pd.Series([None] * len(typed), dtype="Int32")})
    found = channel_costs(typed[there].tolist(), word[there].tolist(), p_primary[there].to_numpy(float), INSERTION, DELETION, TRANSPOSITION)
    for name, values in zip(out.columns, found):
        out.loc[there, name] = values
    return out


def tap_likelihoods(taps: DataFrame, sigma: float = 0.7) -> DataFrame:
    """Posterior of every key for taps (tap_id, x, y): the key table has one row a key and is joined to each tap."""
    keys = taps.sparkSession.createDataFrame([(k, x, y) for k, (x, y) in sorted(key_centers().items()) if k not in ACUTE], "key string, kx double, ky double")
    d2 = F.pow(F.col("x") - F.col("kx"), F.lit(2.0)) + F.pow(F.col("y") - F.col("ky"), F.lit(2.0))
    rows = taps.crossJoin(F.broadcast(keys)).withColumn("nll", d2 / (2 * sigma * sigma))
    w = Window.partitionBy("tap_id")
    return rows.withColumn("posterior", F.exp(-F.col("nll")) / F.sum(F.exp(-F.col("nll"))).over(w)).drop("kx", "ky")


def dedoubled(requests: DataFrame, typed: str = "typed") -> DataFrame:
    """typed and word: one letter of each double letter left out."""
    t = F.col(typed)
    at = requests.filter(F.length(t) >= 2).select(t.alias("typed"), F.explode(F.sequence(F.lit(1), F.length(t) - 1)).alias("i"))
    same = F.substr("typed", F.col("i"), F.lit(1)) == F.substr("typed", F.col("i") + 1, F.lit(1))
    return at.filter(same).select("typed", F.concat(F.left("typed", F.col("i")), F.substr("typed", F.col("i") + 2, F.length("typed"))).alias("word")).distinct()


def dedoubled_restorations(requests: DataFrame, most: int = 2) -> DataFrame:
    """A double letter reduced, then up to ``most`` letters restored."""
    base = dedoubled(requests)
    return base.withColumnRenamed("word", "base").join(restorations(base.select(F.col("word").alias("typed")).distinct(), most).withColumnRenamed("typed", "base"), "base").select("typed", "word").distinct()


def compound_heads(requests: DataFrame, modifiers: DataFrame, least: int = 4) -> DataFrame:
    """typed, modifier and rest, cut behind the longest prefix that may stand first in a compound."""
    n = F.length("typed")
    cut = requests.filter(n >= 2 * least).select("typed", F.explode(F.sequence(F.lit(least), n - least)).alias("i")).withColumn("modifier", F.left("typed", F.col("i")))
    best = cut.join(modifiers.select(F.col("word").alias("modifier")).distinct(), "modifier", "left_semi").groupBy("typed").agg(F.max("i").alias("i"))
    return best.select("typed", F.left("typed", F.col("i")).alias("modifier"), F.substr("typed", F.col("i") + 1, n).alias("rest"))


def compound_repairs(cuts: DataFrame, heads: DataFrame) -> DataFrame:
    """Compounds whose head is one edit from what follows the modifier, at the least cost."""
    near = edits(cuts.select("rest").distinct(), "rest").join(heads.select("word").distinct(), "word", "left_semi").withColumnRenamed("typed", "rest")
    return cuts.join(near, "rest").select("typed", F.concat("modifier", "word").alias("word"), "cost")


def compound_completions(cuts: DataFrame, heads: DataFrame, base: float = 3.0, least: int = 4, config: Config = DEFAULT) -> DataFrame:
    """Compounds whose head starts with what follows the modifier, the most frequent heads first."""
    at = cuts.withColumn("h", F.left("rest", F.lit(least)))
    found = at.join(heads.withColumn("h", F.left("word", F.lit(least))), "h").filter(F.col("word").startswith(F.col("rest")) & (F.length("word") > F.length("rest")))
    order = Window.partitionBy("typed").orderBy(F.col("frequency").desc(), "word")
    found = found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= config.completion_limit)
    return found.select("typed", F.concat("modifier", "word").alias("word"), (base + config.completion_char_cost * (F.length("word") - F.length("rest"))).alias("cost"))


def inserts_linking_letter(typed: Column, word: Column, boundary: Column) -> Column:
    """``word`` is ``typed`` with a linking letter put in at the boundary."""
    letter = F.substr(word, boundary + 1, F.lit(1))
    same = (F.left(word, boundary) == F.left(typed, boundary)) & (F.substr(word, boundary + 2, F.length(word)) == F.substr(typed, boundary + 1, F.length(word)))
    return (F.length(word) == F.length(typed) + 1) & letter.isin("s", "a", "r", "u") & same


def fold_prices(p_primary: Column) -> dict[str, Column]:
    """Prices of writing a letter without its accent, in a session that is in the primary lane with ``p_primary``:
    nothing is cheaper where the lane is uncertain."""
    def weight(p: Column) -> Column:
        x = F.least(F.greatest((p - 0.5) / 0.25, F.lit(0.0)), F.lit(1.0))
        return x * x * (3 - 2 * x)

    own, other = weight(p_primary), weight(1 - p_primary)
    return {
        "weight_primary": own, "weight_secondary": other, "acute": F.greatest(F.lit(0.02), 0.35 * (1 - own)),
        "confusion": 1 - 0.5 * own, "gemination": 1 - 0.35 * own, "apostrophe": F.greatest(F.lit(0.02), F.least(F.lit(4.0), 4.0 * (1 - other))),
    }


def restoration_gates(rows: DataFrame, p_primary: float, config: Config = DEFAULT, least_p: float = 0.65, least_z: float = 1.0, advantage: float = 0.0, guard: float = 0.25) -> DataFrame:
    """Whether a restored word may replace its bare form: one boolean column for each gate.

    rows: typed, word and of both f_ and z_ in both lanes under the prefixes t_ and w_; a restored apostrophe
    speaks for the secondary lane, an accent for the primary one."""
    adds = F.length(F.regexp_replace("word", "[^'’]", "")) > F.length(F.regexp_replace("typed", "[^'’]", ""))
    of = lambda name: F.when(adds, F.col(f"{name}_secondary")).otherwise(F.col(f"{name}_primary"))
    p = F.when(adds, 1 - p_primary).otherwise(F.lit(p_primary))
    lane, other_f = of("w_f"), F.when(adds, F.col("t_f_primary")).otherwise(F.col("t_f_secondary"))
    other_z = F.when(adds, F.col("t_z_primary")).otherwise(F.col("t_z_secondary"))
    dominates = F.when(of("t_f").isNotNull(), lane >= config.twin_dominance * of("t_f")).otherwise(of("w_z") >= least_z)
    gates = {
        "lane": p >= least_p,
        "dominates": lane.isNotNull() & F.coalesce(dominates, F.lit(False)),
        "advantage": of("w_z") - of("t_z") >= advantage,
        "guard": other_f.isNull() | (F.log(p / (1 - p)) + config.temperature * (of("w_z") - other_z) >= guard),
    }
    out = rows.withColumns(gates)
    return out.withColumn("apply", F.col("lane") & F.col("dominates") & F.col("advantage") & F.col("guard"))


def validity(requests: DataFrame, known: DataFrame, personal: DataFrame, tombstones: DataFrame, typed: str = "typed") -> DataFrame:
    """For each request: known in a lexicon, personal, deleted, valid (known or personal, and not deleted), and
    whether all parts of a hyphenated word are valid."""
    parts = requests.select(F.col(typed).alias("typed"), F.explode(F.array_distinct(F.concat(F.array(F.col(typed)), F.split(F.col(typed), "-")))).alias("part")).filter("part <> ''")
    flag = lambda df, name: df.select(F.col("word").alias("part"), F.lit(True).alias(name)).distinct()
    rows = parts.join(flag(known, "k"), "part", "left").join(flag(personal, "p"), "part", "left").join(flag(tombstones, "t"), "part", "left")
    rows = rows.select("typed", "part", *(F.coalesce(c, F.lit(False)).alias(c) for c in "kpt")).withColumn("ok", (F.col("k") | F.col("p")) & ~F.col("t"))
    whole, hyphen = F.col("part") == F.col("typed"), F.contains("typed", F.lit("-"))
    out = rows.groupBy("typed").agg(*(F.bool_or(whole & F.col(c)).alias(c) for c in ("k", "p", "t", "ok")), F.bool_and(F.when(hyphen & ~whole, F.col("ok"))).alias("h"))
    return out.select("typed", F.col("k").alias("known"), F.col("p").alias("personal"), F.col("t").alias("deleted"), F.col("ok").alias("valid"), F.coalesce("h", F.lit(False)).alias("hyphenated"))


def single_letters(rows: DataFrame, p_primary: float, least_z: float = 1.5, offer: float = 0.35, apply: float = 0.65) -> DataFrame:
    """Whether the accented form of a lone letter is offered, and whether it is put in its place.

    rows: f_primary, z_primary and score of the accented form, and the score of the letter as it is (bare)."""
    typical = F.col("f_primary").isNotNull() & (F.col("z_primary") >= least_z)
    share = 1 / (1 + F.exp(F.col("bare") - F.col("score")))
    return rows.withColumns({"offered": typical & F.lit(p_primary >= offer), "auto": typical & F.lit(p_primary >= apply), "confidence": share})
