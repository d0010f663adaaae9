"""Whether the best suggestion for a typed word may replace it: rules, required margins, and one column for each gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.candidates import preserved, tap_likelihoods


@dataclass(frozen=True)
class Limits:
    """Fixed values of the decision."""

    least_length: int = 2
    most_cost: float = 6.0
    margin: float = 1.15
    restoration_margin: float = 0.5
    split_margin: float = 2.5
    split_single_cost: float = 2.5
    least_z: float = -2.5
    far_edits: int = 3
    far_z: float = 0.0
    short_length: int = 2
    short_z: float = 1.5
    context_length: int = 3
    context_z: float = 1.5
    context_lift: float = 0.25
    junk_z: float = -1.0
    junk_scale: float = 3.0
    relief_lift: float = 0.75
    relief_scale: float = 0.7
    tap_baseline: float = 0.5
    tap_strength: float = 6.0
    tap_most: float = 4.0


LIMITS = Limits()


def tap_confidence(taps: DataFrame, sigma: float = 0.7) -> DataFrame:
    """typed and confidence: the mean posterior of the letters that were typed, given where the taps (typed, pos, letter,
    x, y) of a finger that strays by ``sigma`` fell.  Letters without a key of their own do not count."""
    found = tap_likelihoods(taps.select("typed", "letter", F.struct("typed", "pos").alias("tap_id"), "x", "y"), sigma)
    return found.filter("key = letter").groupBy("typed").agg(F.avg("posterior").alias("confidence"))


def tap_factor(confidence: Column, limits: Limits = LIMITS) -> Column:
    """How much larger a margin has to be where the taps say that the letters were meant as they are."""
    over = F.greatest(F.coalesce(confidence, F.lit(0.0)) - limits.tap_baseline, F.lit(0.0))
    return F.least(F.lit(limits.tap_most), 1 + limits.tap_strength * over)


def winners(rows: DataFrame) -> DataFrame:
    """The best row of each typed word (typed, word, cost, score, lift and what else the decision needs), with margin and
    runner_lift of the one behind it, and single_cost, the least cost of a single known word among them."""
    order, group = Window.partitionBy("typed").orderBy(F.col("score").desc(), "word"), Window.partitionBy("typed")
    single = F.min(F.when(~F.contains("word", F.lit(" ")), F.col("cost"))).over(group)
    out = rows.withColumns({"rank": F.row_number().over(order), "margin": F.col("score") - F.lead("score").over(order), "runner_lift": F.lead("lift").over(order), "single_cost": single})
    return out.filter("rank = 1").drop("rank")


def decide(won: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """``won`` with rule, required (the margin asked for), a boolean for each gate, and apply, that all of them are open.

    won: typed, word, cost, margin, z, lift, runner_lift, single_cost, rewrite (edits that are no restoration), context
    (whether a word stands before), valid (typed is a known word or protected), personal (the winner is the user's own),
    capital (a capital inside a sentence), stem_primary and stem_secondary (typed without its last letter is known
    there), confidence of the taps."""
    size, split = F.length("typed"), F.contains("word", F.lit(" "))
    restored = ~split & (F.col("rewrite") == 0)
    rule = F.when(~F.col("valid") & split, "split").when(~F.col("valid") & restored, "restoration").when(~F.col("valid"), "ordinary").when(restored, "restoration of a word").otherwise("none")
    short, far = size <= limits.short_length, F.coalesce(F.col("rewrite"), F.lit(0)) >= limits.far_edits
    lift = F.coalesce("lift", F.lit(float("-inf")))
    unvouched = ~short & (size <= limits.context_length) & ~restored & F.col("context") & (lift < limits.context_lift)
    floor = F.greatest(F.lit(limits.least_z), F.when(far, limits.far_z).otherwise(limits.least_z), F.when(short, limits.short_z).otherwise(limits.least_z), F.when(unvouched, limits.context_z).otherwise(limits.least_z))
    typical = F.when(F.col("personal"), F.lit(True)).otherwise(F.coalesce(F.col("z") >= floor, F.lit(False)))
    junk = ~F.col("personal") & (F.coalesce("z", F.lit(float("-inf"))) < limits.junk_z)
    relief = ~junk & (lift >= limits.relief_lift) & (F.coalesce("runner_lift", F.lit(float("-inf"))) <= 0)
    ordinary = limits.margin * F.when(junk, limits.junk_scale).otherwise(1.0) * F.when(relief, limits.relief_scale).otherwise(1.0)
    asked = F.when(split, limits.split_margin).when(restored, limits.restoration_margin).otherwise(ordinary)
    factor = F.when(restored, 1.0).otherwise(tap_factor(F.col("confidence"), limits))
    possessive = F.col("capital") & ~restored & (size >= 4) & F.col("typed").rlike("^\\p{L}+s$")
    gates = {
        "long_enough": size >= limits.least_length,
        "cheap": F.col("cost") <= limits.most_cost,
        "marks_kept": preserved(F.col("typed"), F.col("word"), "'’") & preserved(F.col("typed"), F.col("word"), "\"„“”«»"),
        "open_rule": F.col("rule") != "none",
        "typical": split | F.col("rule").startswith("restoration of") | typical,
        "ahead": F.col("margin").isNull() | (F.col("margin") >= F.col("required")),
        "no_single_word": ~split | F.col("single_cost").isNull() | (F.col("single_cost") > limits.split_single_cost),
        "no_short_completion": ~(short & (F.length("word") > size) & F.col("word").startswith(F.col("typed"))),
        "no_name": ~possessive | F.col("stem_secondary") | ~F.col("stem_primary"),
    }
    out = won.withColumn("rule", rule).withColumn("required", asked * factor).withColumns(gates)
    apply = F.lit(True)
    for gate in gates:
        apply = apply & F.col(gate)
    return out.withColumn("apply", apply)


GATES = ("long_enough", "cheap", "marks_kept", "open_rule", "typical", "ahead", "no_single_word", "no_short_completion", "no_name")
