"""The session state machine: literal traces, restarts between micro-batches, and random replays."""

from __future__ import annotations

import random

import pytest

from lexmill.storage import shared_path
from lexmill.streaming import ledger
from lexmill.streaming.ledger import Ledger


def test_ledger_traces():
    book = Ledger()
    assert book.judge("a", None) == "none"
    book.note("a", "ab", "a")
    book.note("ab", "abc", "a")
    assert book.judge("a", "a") == "stale" and book.judge("abc", "a") == "matched" and book.notes == []
    book.note("abc", "abcd", "abc")
    assert book.judge("xyz", "abc") == "foreign" and book.notes == []
    book.note("else", "other", "abc")  # does not start from what was seen
    assert book.broken and book.judge("abc", "abc") == "foreign" and not book.broken
    book.note("ab", "abc", "abc")  # was seen before it was noted
    assert not book.broken and book.notes == []


def test_ledger_gives_up():
    book = Ledger()
    for k in range(ledger.CAPACITY):
        book.note("x" * k, "x" * (k + 1), "")
    assert len(book.notes) == ledger.CAPACITY
    book.note("x" * ledger.CAPACITY, "y", "")
    assert book.broken
    book = Ledger([["a", "b", 0]])
    assert [book.judge("a", "a") for _ in range(4)] == ["stale", "stale", "stale", "none"]


def actions(script):
    """(kind, fields) in order as rows of one session."""
    base = dict.fromkeys("session seq kind window before after word correction offers key dx dy".split())
    return [tuple((base | {"session": "s", "seq": k, "kind": kind} | fields).values()) for k, (kind, fields) in enumerate(script)]


def typed(before, word, offers=(), correction=None, committed=None, taps=True):
    after = f"{before}{word}"
    end = f"{before}{committed or word} "
    keys = [("tap", {"key": c, "dx": 0.1, "dy": -0.1}) for c in word] if taps else []
    return [*keys, ("edit", {"before": before, "after": after}), ("see", {"window": after, "offers": list(offers), "correction": correction}), ("edit", {"before": after, "after": end}), ("see", {"window": end})], end


def script():
    out, at = [("see", {"window": ""})], ""
    for kw in ({"word": "halló"}, {"word": "heimr", "offers": ["heimur"], "correction": "heimur", "committed": "heimur"}):
        steps, at = typed(at, **kw)
        out += steps
    out += [("revert", {}), ("edit", {"before": at, "after": "halló heimr "}), ("see", {"window": "halló heimr "}), ("revert", {})]
    steps, at = typed("halló heimr ", "svo", taps=False)
    out += [("choose", {"word": "svo"}), ("choose", {"word": "svo"}), *steps, ("see", {"window": "pasted text. "})]
    steps, at = typed("pasted text. ", "nú", taps=False)
    return out + steps


EXPECTED = [("wc", "halló", None)] + [("ts", c, None) for c in "halló"] + [("sa", "heimr", "heimur"), ("cr", "heimr", "heimur"), ("wt", "svo", None), ("wc", "nú", None)]


def run(spark, batches, kind):
    """The stream's rows after each list of actions came as one file, the stream starting anew for each."""
    spark.conf.set(ledger.PROVIDER, ledger.ROCKSDB)
    at = shared_path(spark, "ledger-test")
    try:
        for rows in batches:
            spark.createDataFrame(rows, ledger.ACTIONS).coalesce(1).write.mode("append").parquet(f"{at}/in")
            stream = kind(spark.readStream.schema(ledger.ACTIONS).parquet(f"{at}/in"))
            stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(ledger.PROVIDER)
    return spark.read.parquet(f"{at}/out").collect()


def found(rows):
    return [(r.kind, r.a, r.b) for r in sorted(rows, key=lambda r: (r.seq, r.pos))]


def test_events_of_a_session(spark):
    assert found(run(spark, [actions(script())], ledger.learning_events)) == EXPECTED


def test_restarts_and_repeats_change_nothing(spark):
    """The stream stops between any two actions and goes on from its state; a file that comes again is left out."""
    rows = actions(script())
    assert found(run(spark, [rows[:9], rows[5:9], rows[9:17], rows[17:]], ledger.learning_events)) == EXPECTED


def test_verdicts_in_several_batches(spark):
    rng, rows = random.Random(3), {}
    for session in "pq":
        text, script = "", [("see", {"window": ""})]
        for _ in range(60):
            kind = rng.random()
            if kind < 0.6:
                new = (text + rng.choice("abc "))[-12:]
                script.append(("edit", {"before": text, "after": new}))
                text = new
            elif kind < 0.9:
                script.append(("see", {"window": text if rng.random() < 0.7 else rng.choice(["elsewhere", text[:-1]])}))
                text = script[-1][1]["window"]
            else:
                script.append(("edit", {"before": "unknown", "after": "too"}))
        rows[session] = [(session, *r[1:]) for r in actions(script)]
    want = []
    for session, own in rows.items():
        state = ledger.Session()
        for r in own:
            row = type("Row", (), dict(zip("session seq kind window before after word correction offers key dx dy".split(), r)))
            verdict, _ = state.step(row)
            if verdict:
                want.append((session, row.seq, verdict))
    got = run(spark, [[r for own in rows.values() for r in own[a : a + 20]] for a in (0, 20, 40, 60)], ledger.verdicts)
    assert sorted((r.session, r.seq, r.verdict) for r in got) == sorted(want)
    assert len({v for *_, v in want}) == 4


def test_rows_without_session_or_seq(spark):
    good = actions(script())
    bad = [(None, *good[0][1:]), ("s", None, *good[0][2:])]
    assert found(run(spark, [bad + good], ledger.learning_events)) == EXPECTED


@pytest.mark.parametrize("window,word", [("", ""), ("a ", ""), ("one two", "two"), ("don't", "don't"), ("x.", "")])
def test_word_at_end(window, word):
    assert ledger._word_at_end(window) == word


def test_sessions_of_a_bucket(spark):
    """Sessions that share a stateful group keep apart, over restarts; the state has a row for each bucket, not each session."""
    names = [f"s{k}" for k in range(40)]
    rows = [(name, *r[1:]) for name in names for r in actions(script())]
    spark.conf.set(ledger.PROVIDER, ledger.ROCKSDB)
    at, states = shared_path(spark, "ledger-test"), 0
    try:
        for part in (0, 1):
            spark.createDataFrame([r for r in rows if (r[1] > 8) == part], ledger.ACTIONS).coalesce(1).write.mode("append").parquet(f"{at}/in")
            stream = ledger.learning_events(spark.readStream.schema(ledger.ACTIONS).parquet(f"{at}/in"), buckets=3)
            query = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start()
            query.awaitTermination()
            states = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        spark.conf.unset(ledger.PROVIDER)
    got = spark.read.parquet(f"{at}/out").collect()
    assert all(found([r for r in got if r.session == name]) == EXPECTED for name in names) and len(got) == len(names) * len(EXPECTED)
    assert states == 3


def test_a_word_does_not_carry_its_turn(spark, data):
    from lexmill.plans.typing import _words

    words = _words(spark, data, ("user", "assistant"))
    assert set(words.columns) == {"session", "n", "i", "w", "last"}
    assert words.filter((words.i == 1) != words.last.isNull()).count() == 0
