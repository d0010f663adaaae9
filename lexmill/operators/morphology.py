"""Morphology tables: forms (form, lemma, pos, gender, bundle), both directions as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the codes in a bundle.
CASES, DEGREES, GENDERS = ("nf", "þf", "þgf", "ef"), ("fst", "mst", "est", "?"), ("kk", "kvk", "hk", "?")


def unpack(bundle: Column) -> dict[str, Column]:
    """Features packed in 16 bits: case, number, noun or adjective, then definiteness or gender, degree, weakness."""
    bit = lambda at, mask: F.shiftright(bundle, at).bitwiseAND(F.lit(mask))
    adjective = bit(3, 1) == 1
    return {
        "case_code": bit(0, 3), "plural": bit(2, 1) == 1, "adjective": adjective, "definite": ~adjective & (bit(4, 1) == 1),
        "gender_code": F.when(adjective, bit(4, 3)), "degree_code": F.when(adjective, bit(6, 3)), "weak": adjective & (bit(8, 1) == 1),
    }


def with_case(bundle: Column, case: int) -> Column:
    return bundle.bitwiseAND(F.lit(0xFFFC)).bitwiseOR(F.lit(case & 3))


def describe(bundle: Column) -> Column:
    f = unpack(bundle)
    name = lambda names, code: F.element_at(F.array(*[F.lit(n) for n in names]), code + 1)
    number = F.when(f["plural"], "ft").otherwise("et")
    noun = F.concat_ws(":", F.lit("no"), name(CASES, f["case_code"]), number, F.when(f["definite"], "gr").otherwise("ngr"))
    adjective = F.concat_ws(":", F.lit("lo"), name(CASES, f["case_code"]), number, name(GENDERS, F.coalesce(f["gender_code"], F.lit(3))), name(DEGREES, F.coalesce(f["degree_code"], F.lit(3))), F.when(f["weak"], "vb").otherwise("sb"))
    return F.when(f["adjective"], adjective).otherwise(noun)


def lemmatize(words: DataFrame, forms: DataFrame, pos: int | None = None) -> DataFrame:
    """word and lemma, each once; unknown words are their own lemma."""
    known = forms if pos is None else forms.filter(F.col("pos") == pos)
    return words.join(known.select(F.col("form").alias("word"), "lemma").distinct(), "word", "left").select("word", F.coalesce("lemma", "word").alias("lemma")).distinct()


def analyses(words: DataFrame, forms: DataFrame) -> DataFrame:
    return words.join(forms.withColumnRenamed("form", "word"), "word")


def siblings(words: DataFrame, forms: DataFrame) -> DataFrame:
    """word and the other forms of its lemmas."""
    lemmas = words.join(forms.select(F.col("form").alias("word"), "lemma").distinct(), "word")
    return lemmas.join(forms.select("lemma", "form").distinct(), "lemma").filter("form <> word").select("word", "form").distinct()


def is_modifier(forms: DataFrame) -> Column:
    """Forms that may stand first in a compound: indefinite genitives, and some bare singulars by gender."""
    f = unpack(F.col("bundle"))
    bare = ~f["plural"] & ((F.col("gender") == 0) & (f["case_code"] == 1) | (F.col("gender") == 1) & (f["case_code"] == 0) | (F.col("gender") == 2) & f["case_code"].isin(0, 1))
    noun = ~f["adjective"] & ~f["definite"] & ((f["case_code"] == 3) | bare)
    adjective = f["adjective"] & (f["degree_code"] == 0) & ~f["weak"] & (f["case_code"] == 3)
    return noun | adjective


def lemma_lift(learned: DataFrame, forms: DataFrame) -> DataFrame:
    """Forms that profit from a learned word: siblings of learned words of one lemma whose every analysis is that
    lemma, without the learned words themselves."""
    one = forms.groupBy("form").agg(F.count_distinct("lemma").alias("n"), F.min("lemma").alias("lemma")).filter("n = 1")
    lemmas = learned.join(one.select(F.col("form").alias("word"), "lemma"), "word").select("lemma").distinct()
    return lemmas.join(one.select("form", "lemma"), "lemma").select(F.col("form").alias("word")).distinct().join(learned.select("word"), "word", "left_anti")


def governor_fit(words: DataFrame, forms: DataFrame, governors: DataFrame, scale: float = 0.6, floor: float = -2.0, least_mass: float = 200.0) -> DataFrame:
    """How well a word's cases fit what the previous word governs (governor, mass, p_case of four)."""
    p = F.element_at("p_case", F.col("bundle").bitwiseAND(F.lit(3)) + 1)
    rows = words.join(governors.filter(F.col("mass") >= least_mass).withColumnRenamed("governor", "previous"), "previous").join(forms.withColumnRenamed("form", "word"), "word")
    return rows.groupBy("previous", "word").agg((scale * F.max(F.greatest(F.log(F.greatest(p, F.lit(1e-12)) / 0.25), F.lit(floor)))).alias("fit"))


def known_forms(words: DataFrame, forms: DataFrame, open_class: int = 2) -> DataFrame:
    """word, whether it is a form, and whether it is one of an open class (part of speech up to ``open_class``)."""
    of = forms.groupBy(F.col("form").alias("word")).agg(F.min("pos").alias("_pos"))
    return words.join(of, "word", "left").select("word", F.col("_pos").isNotNull().alias("known"), F.coalesce(F.col("_pos") <= open_class, F.lit(False)).alias("open_class"))


def cases(words: DataFrame, forms: DataFrame) -> DataFrame:
    """word, the names of the cases it can stand in as a noun or adjective, and its lemmas."""
    name = F.element_at(F.array(*[F.lit(n) for n in CASES]), F.col("bundle").bitwiseAND(F.lit(3)) + 1)
    rows = words.join(forms.filter("pos <= 1").withColumnRenamed("form", "word"), "word")
    return rows.groupBy("word").agg(F.array_sort(F.collect_set(name)).alias("cases"), F.array_sort(F.collect_set("lemma")).alias("lemmas"))


def wrong_case_siblings(words: DataFrame, forms: DataFrame, case: int) -> DataFrame:
    """word and the forms of its lemma that stand in ``case``, for words that cannot stand in it themselves."""
    of = F.col("bundle").bitwiseAND(F.lit(3))
    able = forms.filter(of == case).select(F.col("form").alias("word"))
    rows = words.join(able, "word", "left_anti").join(forms.select(F.col("form").alias("word"), "lemma").distinct(), "word")
    return rows.join(forms.filter(of == case).select("lemma", "form"), "lemma").filter("form <> word").select("word", "form").distinct()


def pair_frequency(pairs: DataFrame, bigram: DataFrame) -> DataFrame:
    """previous, word and how often the pair is attested, 0 if never."""
    of = bigram.groupBy(F.col("w1").alias("previous"), F.col("w2").alias("word")).agg(F.sum("frequency").alias("frequency"))
    return pairs.join(of, ["previous", "word"], "left").select("previous", "word", F.coalesce("frequency", F.lit(0)).alias("frequency"))
