"""Queries over whole tables that have no oracle."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexmill import catalog
from lexmill.operators import candidates, glide
from lexmill.sources import lexicon_tables


def test_governor_fit_pairs(spark, tmp_path):
    text = "la casa la mesa las casas la mano " * 250
    spark.createDataFrame([(1, text, "es", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.previous, r.word): r.fit for r in catalog.QUERIES["governor_fit_pairs"](spark, str(tmp_path)).collect()}
    assert {("la", "casa"), ("la", "mesa"), ("la", "mano"), ("las", "casas")} <= set(got) and ("la", "casas") not in got
    assert got["la", "casa"] == -0.549774 and got["las", "casas"] == 0.282002


def test_code_stems_all(spark, tmp_path):
    rows = [(1, "one", "B"), (150, "high", "D"), (200, "high", "C"), (201, None, "E")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.p_partkey: r.stem for r in catalog.QUERIES["code_stems_all"](spark, str(tmp_path)).collect()}
    assert got == {1: "B", 150: "C", 200: "C", 201: None}


def test_thinned_strokes(spark):
    """Points within a quarter key width of the last kept one go; the first stays."""
    points = "array(" + ", ".join(f"struct({x}D as x, {y}D as y)" for x, y in ((0, 0), (0.1, 0), (0.2, 0), (0.3, 0), (0.3, 0.2), (0.3, 0.3), (1, 1))) + ")"
    df = spark.sql(f"SELECT {points} AS points UNION ALL SELECT array(struct(5D as x, 5D as y))")
    got = sorted([[(p.x, p.y) for p in r.t] for r in df.select(glide.thinned(F.col("points")).alias("t")).collect()])
    assert got == [[(0, 0), (0.3, 0), (0.3, 0.3), (1, 1)], [(5, 5)]]


def test_compound_repair(spark):
    cuts = spark.createDataFrame([("bílskúr", "bíls", "kúr"), ("bílsdyr", "bíls", "dyr")], "typed string, modifier string, rest string")
    heads = spark.createDataFrame([("skúr", 9), ("dyr", 4), ("dyra", 2)], "word string, frequency long")
    got = {(r.typed, r.word): r.cost for r in candidates.compound_repairs(cuts, heads).collect()}
    assert got == {("bílskúr", "bílsskúr"): 4.0, ("bílsdyr", "bílsdyra"): 4.0}


def test_restoration_gates(spark):
    schema = "typed string, word string, t_f_primary long, t_f_secondary long, t_z_primary double, t_z_secondary double, w_f_primary long, w_f_secondary long, w_z_primary double, w_z_secondary double"
    rows = [("a", "á", 1, None, 0.0, -2.0, 20, None, 1.0, -2.0), ("b", "bá", 10, None, 0.0, -2.0, 20, None, 1.0, -2.0), ("c", "cá", None, 5, 0.0, 3.0, 20, None, 1.5, -2.0), ("im", "i'm", None, None, 0.0, 0.0, None, 50, 0.0, 2.0)]
    got = {r.typed: (r.lane, r.dominates, r.advantage, r.guard, r.apply) for r in candidates.restoration_gates(spark.createDataFrame(rows, schema), 0.7).collect()}
    assert got == {"a": (True,) * 5, "b": (True, False, True, True, False), "c": (True, True, True, False, False), "im": (False, True, True, True, False)}


def test_stored_lexicon_is_read_not_counted_again(spark, data):
    """Look-ups scan the stored tables: no plan of theirs reads the documents."""
    for name in ("next_word_topk", "corrections_ranked", "completions_ranked", "lane_posterior", "blended_score", "autocorrect_gates"):
        plan = catalog.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "documents.parquet" not in plan and "lexicon-" in plan, name


WORDS_ALONE = ("fold_pricing", "lane_posterior", "known_forms", "possessives_derived", "lexicon_calibration")


@pytest.mark.parametrize("name", WORDS_ALONE)
def test_words_alone_leave_pairs_uncounted(spark, data, name, monkeypatch):
    """Counting pairs was most of what these queries shuffled, wrote and held."""
    monkeypatch.setattr(lexicon_tables, "_BUILT", {})
    assert catalog.QUERIES[name](spark, data).count() > 0
    assert [built.uncounted is None for _, built in lexicon_tables._BUILT.values()] == [False]


def test_lexicon_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, "uno dos uno", "es"), (2, "one two one", "en"), (3, None, "en"), (4, "eins", "de"), (5, "", None)], "doc_id long, text string, lang string")
    lexicon = lexicon_tables.write_lexicon(docs, f"{tmp_path}/lexicon", ("es", "en"))
    assert sorted(map(tuple, lexicon.unigrams.collect())) == [("dos", 1, "es"), ("one", 2, "en"), ("two", 1, "en"), ("uno", 2, "es")]
    assert sorted(map(tuple, lexicon.bigrams.collect())) == [("dos", "uno", 1, "es"), ("one", "two", 1, "en"), ("two", "one", 1, "en"), ("uno", "dos", 1, "es")]
    assert {r.lane: r.total for r in lexicon.scale.collect()} == {"es": 3, "en": 3}
    plan = lexicon.unigrams.filter("lane = 'es' AND word = 'uno'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(lane" in plan and "EqualTo(word,uno)" in plan


def test_commits_span_batches(spark, tmp_path):
    """A word that ends a text is committed when the session's next text comes in a later batch."""
    from lexmill.streaming import sessions

    schema = "session string, at long, text string"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    for rows in ([("a", 1, "hello wor"), ("b", 1, "one. two ")], [("a", 2, "ld"), ("b", 2, None)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        sessions.commits(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.session, r["at"], r.word, r.previous) for r in spark.read.schema(sessions.COMMITS).parquet(f"{tmp_path}/out").collect())
    assert got == [("a", 1, "hello", None), ("a", 1, "wor", "hello"), ("b", 1, "one", None), ("b", 1, "two", None)]


def _crowd(spark, path):
    """A document in which one word is followed by 20,010 others, the commonest of them last in byte order."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    others = [letters[i // 676 % 26] + letters[i // 26 % 26] + letters[i % 26] + letters[i // 17576] for i in range(20_010)]
    text = " ".join(f"hub {w}" for w in sorted(others)) + " hub zzzz" * 30
    spark.createDataFrame([(1, text, "es", "s", len(text)), (2, "the end", "en", "s", 7)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "hub zzzaz")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_continuations_of_a_word_with_many(spark, tmp_path):
    """All words after a frequent word count, not the first 20,000 in byte order."""
    _crowd(spark, tmp_path)
    rows = catalog.QUERIES["context_continuation"](spark, str(tmp_path)).collect()
    assert ("hub", "zzaz", "zzzz") in {(r.previous, r.typed, r.word) for r in rows}


def test_rare_continuations_count(spark, tmp_path):
    """A word that follows once counts though 520 others follow more often; letter and lengths decide alone."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    often = [f"hub {letters[i // 26]}{letters[i % 26]}q" for i in range(520)] * 2
    once = [f"hub {w}" for w in ("zz", "zzy", "zzyy", "zzyyx", "zzyyxx", "azyy", "zzaz")]
    rows = [(1, " ".join(often + once), "es"), (2, "hub zéyy hub zzyy", "en"), (3, "hub zzby", "de"), (4, "other zzcy", "es"), (5, None, "en")]
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "hub zzzaz"), (2, "hub zézaz"), (3, "hub zzz"), (4, "none zzzaz"), (5, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(tuple(r) for r in catalog.QUERIES["context_continuation"](spark, str(tmp_path)).select("previous", "typed", "word").collect())
    assert got == [("hub", "zzaz", w) for w in ("zzy", "zzyy", "zzyyx", "zéyy")]


def test_fallback_of_a_word_with_many(spark, tmp_path):
    _crowd(spark, tmp_path)
    rows = catalog.QUERIES["next_word_fallback"](spark, str(tmp_path)).collect()
    assert ("hub", "zzzz") in {(r.previous, r.word) for r in rows}


def test_confidence_is_of_the_unrounded_score(spark):
    from lexmill.operators import model

    rows = spark.createDataFrame([("p", "a", 1.4, 1.0), ("p", "b", 0.6, 1.0)], "previous string, word string, score double, by double")
    got = {r.word: r.confidence for r in model.ranked(rows, ["previous"], 5, "by").collect()}
    assert abs(got["a"] - 1 / (1 + 2.718281828459045 ** -0.8)) < 1e-9


def test_next_words_of_a_word_with_many(spark, tmp_path):
    _crowd(spark, tmp_path)
    rows = catalog.QUERIES["next_word_topk"](spark, str(tmp_path)).collect()
    assert ("hub", "zzzz", 1) in {(r.previous, r.word, r["rank"]) for r in rows}


def test_edits_are_dealt_out(spark):
    """Few words have many edits: they do not meet in one task, though their own bytes are few."""
    from lexmill.operators import candidates as C

    words = spark.createDataFrame([(f"word{a}{b}",) for a in "abcdefghij" for b in "abcdefghij"], "typed string").distinct()
    sizes = C.edits(words).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len([n for n in sizes if n]) > 2 and max(sizes) < sum(sizes) / 2


def test_pairs_after_some_words(spark):
    """Only the pairs that are asked for are counted, with the counts that the whole table has."""
    from lexmill.sources.lexicon_tables import write_lexicon
    from lexmill.storage import shared_path

    docs = spark.createDataFrame([(1, "a b a b c a c", "es"), (2, "b a b", "en"), (3, "a b", "de"), (4, None, "es")], "doc_id long, text string, lang string")
    lexicon = write_lexicon(docs, shared_path(spark, "lexicon-test"), ("es", "en"))
    first = spark.createDataFrame([("a",), ("x",)], "w1 string")
    rows = lambda df: sorted(tuple(r) for r in df.select("lane", "w1", "w2", "frequency").collect())
    got = rows(lexicon.bigrams_after(first))
    assert lexicon.uncounted is not None and got == [("en", "a", "b", 1), ("es", "a", "b", 2), ("es", "a", "c", 1)]
    assert rows(lexicon.bigrams.filter("w1 = 'a'")) == got == rows(lexicon.bigrams_after(first))
