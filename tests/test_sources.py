"""JSON tables, combined lists and snapshots."""

from __future__ import annotations

import gzip
import json

from pyspark.sql import functions as F

from lexmill.sources import json_tables as J
from lexmill.sources import text_tables as X


def test_governors(spark, tmp_path):
    data = {"governors": {"til": {"mass": 900.0, "p_case": [0.0, 0.0, 0.1, 0.9], "entropy_ratio": 0.2, "extra": 1}, "bad": {"mass": 1.0, "p_case": [1.0]}}, "more": []}
    with gzip.open(tmp_path / "g.json.gz", "wt") as f:
        json.dump(data, f)
    rows = J.read_governors(spark, str(tmp_path / "g.json.gz")).collect()
    assert [(r.governor, r.mass, r.p_case[3]) for r in rows] == [("til", 900.0, 0.9)]


def test_calibration(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"schema": "v1", "addK": 0.5, "meanLogFrequency": 8.3, "stdLogFrequency": 2.5, "warmupWords": ["a"]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"schema": "v1", "addK": 0.5, "meanLogFrequency": 8.3, "stdLogFrequency": 0.0}))
    assert [(r.mu, r.sigma, r.warmup) for r in J.read_calibration(spark, str(tmp_path)).collect()] == [(8.3, 2.5, ["a"])]


def test_export(spark):
    words = spark.createDataFrame([("b", 2, False), ("a", 1, True)], "word string, count long, explicit boolean")
    pairs = spark.createDataFrame([("a", "z", 1), ("a", "b", 4)], "previous string, word string, count long")
    got = [json.loads(r.value) for r in J.export_personal(words, pairs).collect()]
    assert [g["word"] for g in got] == ["a", "b"] and got[0]["next"] == [{"next": "b", "count": 4}, {"next": "z", "count": 1}] and got[1]["next"] == []


def test_snapshot_is_replaced(spark, tmp_path):
    path = str(tmp_path / "snap")
    J.save_snapshot(spark.range(3), path)
    J.save_snapshot(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["snap"]


def test_combined_list(spark):
    lines = [" w=orð;f=12;l=is", "word=a b;freq=300;l=all", "w=x;f=5;l=null;s=xx", "w=;f=5", "f=5", "w=y;f=abc"]
    got = X.parse_combined(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [tuple(r) for r in got] == [("orð", 12, "is", None), ("x", 5, None, "xx")]


def test_curated_and_import(spark):
    df = spark.createDataFrame(list(enumerate(["# c", "Orð", "", "orð ", "x"])), "line_no long, value string")
    assert sorted(r.word for r in X.curated(df).collect()) == ["Orð", "x"]
    words = X.importable(df).withColumn("k", F.lit(1))
    assert sorted(r.word for r in words.collect()) == ["Orð", "orð", "x"]


def test_lexicon_follows_its_files(spark, tmp_path):
    from lexmill.sources.lexicon_tables import lexicon_of

    path = str(tmp_path / "documents.parquet")

    def words(rows):
        spark.createDataFrame(rows, "doc_id long, text string, lang string").write.mode("overwrite").parquet(path)
        found = lexicon_of(spark.read.parquet(path), path, ("es", "en"))
        assert lexicon_of(spark.read.parquet(path), path, ("es", "en")) is found
        return {(r.lane, r.word): r.frequency for r in found.unigrams.collect()}

    assert words([(1, "uno dos dos", "es")]) == {("es", "uno"): 1, ("es", "dos"): 2}
    assert words([(1, "uno", "es"), (2, "one", "en")]) == {("es", "uno"): 1, ("en", "one"): 1}


def test_pairs_are_counted_when_asked_for(spark, tmp_path):
    from lexmill.sources.lexicon_tables import write_lexicon

    lexicon = write_lexicon(spark.createDataFrame([(1, "uno dos", "es")], "doc_id long, text string, lang string"), str(tmp_path), ("es", "en"))
    assert lexicon.unigrams.count() == 2 and lexicon.scale.count() == 1 and not (tmp_path / "bigrams").exists()
    assert [tuple(r) for r in lexicon.bigrams.collect()] == [("uno", "dos", 1, "es")] and (tmp_path / "bigrams").exists()
    (tmp_path / "bigrams").rename(tmp_path / "elsewhere")
    assert lexicon.uncounted is None  # counted once
