"""Literal pairs and properties of text functions, costs, logs and streams."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.config import EDIT_ALPHABET, key_centers, substitution_cost
from lexmill.functions import text as T
from lexmill.operators import candidates as C
from lexmill.operators import glide as G
from lexmill.operators import learning as A
from lexmill.operators import model as M
from lexmill.operators.alignment import typing_costs
from lexmill.sources import text_tables as X
from lexmill.streaming import sessions as S


def one(spark, values, column):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(column).collect()]


def test_tokens(spark):
    got = one(spark, ["vs. 1.5 við a.b", "end.", "…", "„orð", "www.is x"], T.current_word(F.col("x")))
    assert got == ["a.b", "end.", "…", "orð", "x"]
    assert one(spark, ["a b.c d. e.", None, ""], T.word_tokens(F.col("x"))) == [["a", "b.c", "d", "e."], None, []]


def test_token_classes(spark):
    x = F.col("x")
    assert one(spark, ["/goal", "a@b", "orð", "a.b", "-x"], T.is_verbatim(x)) == [True, True, False, True, True]
    assert one(spark, ["a.hestur", "við", "x/y"], T.trailing_segment(x)) == ["hestur", "við", "y"]
    assert one(spark, ["hus.bill", "mbl.is", "www.x", "a.b.c"], T.dotted_halves(x)) == [["hus", "bill"], None, None, None]
    assert one(spark, ["Jónsson", "Jakobsdóttir", "son", "hestur"], T.is_patronymic(x)) == [True, True, False, False]
    assert one(spark, ["sagði „", "sagði", ""], T.in_quotes(x)) == [True, False, False]


def test_mime(spark):
    x = F.col("x")
    values = ["image/png", "text/plain", "image", None, "image/", "a/b/c"]
    assert one(spark, values, T.mime_matches(x, ["image/*"])) == [True, False, False, False, False, False]
    assert one(spark, values, T.mime_matches(x, ["*/*"])) == [True, True, False, False, False, False]


def test_nfc(spark):
    assert one(spark, ["é", None], T.nfc("x")) == ["é", None]


def test_rewrite_keeps_case(spark):
    assert one(spark, ["xA", "xa", "q"], T.rewrite(F.col("x"), {"a": "á"})) == ["xÁ", "xá", "q"]


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(EDIT_ALPHABET), st.sampled_from(EDIT_ALPHABET))
def test_substitution_cost(a, b):
    assert substitution_cost(a, a) == 0
    assert a == b or substitution_cost(a, b) >= 0.35


@settings(max_examples=60, deadline=None)
@given(st.text("abcdeáð", max_size=7), st.text("abcdeáð", max_size=7))
def test_typing_cost_is_bounded(a, b):
    cost = float(typing_costs([a], [b], C.INSERTION, C.DELETION, C.TRANSPOSITION)[0])
    assert (cost == 0) == (a == b)
    assert cost <= 4 * (len(a) + len(b))


def test_costs(spark):
    df = spark.createDataFrame([("hus", "hús"), ("ab", "ba"), ("abc", "ab"), ("dont", "don't")], "typed string, word string")
    rows = df.select(C.typing_cost("typed", "word").alias("t"), C.rewrite_distance("typed", "word").alias("r"), C.channel_cost("typed", "word", F.lit(0.9)).alias("c")).collect()
    assert [r.t for r in rows] == [0.35, 2.0, 4.0, 4.0]
    assert [r.r for r in rows] == [0, 1, 1, 0]
    assert rows[0].c.total == 0.02 and rows[0].c.error_ops == 0 and rows[0].c.restoration_ops == 1


def test_event_lines_round_trip(spark):
    events = spark.createDataFrame([(1, "wc", "a\tb\\n\n", "prev", "is"), (2, "wt", "x", None, None), (3, "sa", "p", "q", None)], "day int, kind string, a string, b string, c string")
    back = X.parse_events(X.event_lines(events)).orderBy("day").collect()
    assert [(r.day, r.kind, r.a, r.b, r.c, r.ok) for r in back] == [(1, "wc", "a\tb\\n\n", "prev", "is", True), (2, "wt", "x", None, None, True), (3, "sa", "p", "q", None, True)]


def test_bad_event_lines(spark):
    lines = ["#gen\tx", "2\t1\twt\ta", "1\tx\twt\ta", "1\t1\twt", "1\t1\tts\th\t0.1\t-0.1", "1\t1\tts\thh\t0\t0", "1\t1\twc\t\t\tis", ""]
    got = X.parse_events(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r.ok for r in got] == [False, False, False, True, False, False, False]


def test_snapshot_golden(spark):
    """Six events: a learned word, a pair, a deleted word and two touches of one key."""
    log = spark.createDataFrame([(1, 10, "wc", "halló", None, "is"), (2, 11, "wc", "halló", None, "is"), (3, 11, "wc", "heimur", "halló", "is"), (4, 11, "wc", "deleted", None, "un")], "seq long, day int, kind string, word string, previous string, hint string")
    gone = spark.createDataFrame([("deleted",)], "word string")
    commits = A.committed(log, gone)
    words = A.fold_words(commits)
    found = {r.word: r for r in words.withColumn("learned", A.learned(words)).collect()}
    assert found["halló"]["count"] == 2 and found["halló"].learned and not found["heimur"].learned and "deleted" not in found
    assert [tuple(r) for r in A.fold_pairs(commits, gone).select("previous", "word", "count").collect()] == [("halló", "heimur", 1)]
    touch = spark.createDataFrame([("h", 1, 0.1, -0.2), ("h", 2, 0.2, -0.1)], "key string, seq long, dx double, dy double")
    m = A.moments(touch).first()
    assert (m.n, round(m.mean_dx, 9), round(m.mean_dy, 9), round(m.var_dx, 9), round(m.var_dy, 9)) == (2, 0.15, -0.15, 0.005, 0.005)
    d = A.decaying_moments(touch).first()
    assert round(d.var_dx, 9) == 0.005 and round(d.cov, 9) == 0.005


def test_emoji_table(spark):
    lines = ["[smileys]", "😀;grin;happy|smile", "\t😁;x;y", "bad;row", "[food]", "🍎;apple;fruit"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")
    got = [tuple(r) for r in X.emoji_table(df).collect()]
    assert got[0] == ("smileys", "😀", "grin", ["happy", "smile"], "😀") and got[1][2] == "grin" and got[1][4] == "😀" and got[2][0] == "food"


def test_ranks_and_confidence(spark):
    df = spark.createDataFrame([("a", w, s) for w, s in (("x", 1.0), ("y", 1.0), ("z", 0.0))], "g string, word string, score double")
    rows = M.ranked(df, ["g"], 3).orderBy("rank").collect()
    assert [r.word for r in rows] == ["x", "y", "z"] and abs(sum(r.confidence for r in rows) - 1) < 1e-9
    assert M.margins(df, ["g"]).first().margin == 0


def test_glide_finds_its_own_word(spark):
    words = spark.createDataFrame([("hello", 100), ("help", 50), ("jello", 10), ("world", 80)], "word string, frequency long")
    at = key_centers()
    points = [{"x": at[c][0], "y": at[c][1]} for c in "helo"]
    gestures = spark.createDataFrame([("g", points)], "gesture_id string, points array<struct<x:double,y:double>>")
    assert G.classified(gestures, words).filter("rank = 1").first().word == "hello"


def test_stream_matches_batch(spark, tmp_path):
    steps = [("s1", 1, 1.0), ("s1", 2, -0.5), ("s1", 3, None), ("s2", 1, 0.4)]
    schema = "session string, at long, evidence double"
    spark.createDataFrame(steps, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = S.lane_states(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("lanes").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.session: round(r.p_primary, 9) for r in spark.table("lanes").collect()}
    batch = M.lane_posterior(spark.createDataFrame(steps, schema), ["session"], "at").collect()
    assert got == {r.session: round(r.p_primary, 9) for r in batch}


def test_compaction_is_idempotent(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.log").write_text("#gen\tx\n1\t5\twt\tone\n1\t5\twt\ttwo\n")
    fold = lambda b: b.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("count"))
    S.compact(S.event_stream(spark, str(tmp_path / "log")), str(tmp_path / "snap"), str(tmp_path / "cp"), fold, S.add_counts).awaitTermination(120)
    (tmp_path / "log" / "b.log").write_text("1\t6\twt\tone\n")
    S.compact(S.event_stream(spark, str(tmp_path / "log")), str(tmp_path / "snap"), str(tmp_path / "cp"), fold, S.add_counts).awaitTermination(120)
    got = {r.word: r["count"] for r in spark.read.parquet(str(tmp_path / "snap" / "batch=1")).collect()}
    assert got == {"one": 2, "two": 1}


def test_addresses(spark):
    """IPv6 in its short forms, ports up to 65535, quoted local parts; what is none of these is left."""

    cases = [
        (T.IPV6, ["2001:db8::1", "::1", "fe80::", "1:2:3:4:5:6:7:8", "::ffff:10.0.0.1"], ["1:2", "g::h", "1:2:3:4:5:6:7:8:9"]),
        (T.URL, ["https://example.org:65535/a", "10.0.0.1:80/x?y=1", "http://localhost:8080", "example.org"], ["example.org:99999", "localhost"]),
        (T.EMAIL, ["a.b+c@example.org", '"a b"@example.org', "x@10.0.0.1"], ["a..b@example.org", "a@b", '"a"b"@example.org']),
    ]
    for pattern, good, bad in cases:
        rows = spark.createDataFrame([(t,) for t in good + bad], "t string").select("t", F.col("t").rlike(f"^(?:{pattern})$").alias("ok")).collect()
        assert {r.t: r.ok for r in rows} == {t: True for t in good} | {t: False for t in bad}


@pytest.mark.parametrize("n", [0, 7, 10, 19, 99, 100, 255, 409, 65535])
def test_numbers_at_most(n):
    pattern = re.compile(T.at_most(n))
    assert all(bool(pattern.fullmatch(str(k))) == (k <= n) for k in [*range(0, 1200), n - 1, n, n + 1, 10 * n + 9, 65536, 70000, 99999] if k >= 0)
    assert not pattern.fullmatch("01") and not pattern.fullmatch("")


def test_addresses_follow_their_grammars(spark):
    label = "a" * 63
    cases = {
        T.URL: (["http://a.is", f"{label}.org", "https://host/p/a%20b;c=1?q=/x&y#top", "x-y.example.com/ö", "http://[2001:db8::1]:80/", "ab.cd:0"], ["a_b", f"{label}a", "-a", "http://", "a.b1", "ftp"]),
        T.EMAIL: (["a@b.cd", "o'neil+tag@x-y.example.com", '"quoted \\" sign"@example.org', "x@192.168.0.255"], ["a@-b.cd", "a.@b.cd", "a b@c.de", "x@300.1.1.1"]),
        T.PHONE: (["+354 555 1234", "0045-12345678", "(020) 7946 0958", "5551234", "+1 (212) 555-0100"], ["1234", "+", "12 (34", "+0 12345"]),
    }
    for pattern, (good, bad) in cases.items():
        rows = spark.createDataFrame([(x,) for x in good + bad], "x string").select("x", F.col("x").rlike(f"^(?:{pattern})$").alias("ok")).collect()
        assert {r.x: r.ok for r in rows} == {x: True for x in good} | {x: False for x in bad}


def test_emails_in_long_texts(spark):
    """Long quoted texts, labels, escapes and runs do not go deep; the addresses are those of the grammar."""
    x = F.col("x")
    long = ['"' + "ab " * 40_000 + '"@a.bc', '"' + "\\a" * 40_000 + '"@a.bc', "u@" + "a." * 40_000 + "bc", "a" * 200_000 + " b@c.de", "a." * 100_000 + "@ b@c.de"]
    assert [[len(e) for e in r] for r in one(spark, long, T.extract(x, T.EMAIL_SCAN))] == [[120_007], [80_007], [80_004], [6], [6]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='ab1."@\\ -[]:,é', max_size=24), min_size=1, max_size=30))
def test_email_patterns_agree(spark, texts):
    """Both patterns find the same, and the one without loops that go deep is the one that is run."""
    x = F.col("x")
    df = spark.createDataFrame([(t,) for t in texts], "x string").select("x", T.extract(x, T.EMAIL).alias("a"), T.extract(x, T.EMAIL_SCAN).alias("b"))
    assert not df.filter("a <> b").collect()


def test_capitals_are_one_letter(spark):
    x = F.col("x")
    assert one(spark, ["ßie", "ᾳx", "ŉx", "ör", "ǆ", "", None], T.title_case(x)) == ["ẞie", "ᾼx", "ŉx", "Ör", "Ǆ", "", None]
    assert one(spark, ["İX", "ΑΣ", "ẞIE"], T.lower_case(x)) == ["ix", "ασ", "ßie"]


def test_pair_counts_keep_sharp_s_apart(spark, tmp_path):
    from lexmill import catalog

    rows = [(1, 0, "user", "die ßie die SSie die SSie die ẞie")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.previous, r.word): r["count"] for r in catalog.QUERIES["pair_count_case_variants"](spark, str(tmp_path)).collect()}
    assert got["die", "ßie"] == 1


def test_last_sentence(spark, tmp_path):
    from lexmill import catalog

    texts = ["One. Two", "One. Two.  ", "a.b!\nc", "x" * 300, "end." + " " * 300, "...", "", "a. b.\u2028", None, "a. b\r", "a.\x0b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.shown for r in catalog.QUERIES["document_window"](spark, str(tmp_path)).collect()}
    assert [got[k] for k in range(11)] == [" Two", " Two.  ", " c", "x" * 200, " " * 200, ".", "", "\u2028", None, " b\r", "\x0b"]
