"""Queries over typing sessions: a turn of a conversation stands for a session, its words for what is typed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.plans.registry import query, table
from lexmill.storage import shared_path
from lexmill.streaming import ledger, sessions

_STEP = 100_000  # numbers of actions for each word


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """Within this block streams that start keep their state in RocksDB, so that it need not fit into memory."""
    before = spark.conf.get(ledger.PROVIDER, None)
    spark.conf.set(ledger.PROVIDER, ledger.ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(ledger.PROVIDER) if before is None else spark.conf.set(ledger.PROVIDER, before)


def _words(s: SparkSession, d: str, roles: tuple[str, ...]) -> DataFrame:
    """session, i (from 1), n and w, the words of each turn, and last, the word before.

    A word's row has no more of its turn than that, so that rows grow with the words and not with their square."""
    talk = table(s, d, "conversations").filter(F.col("role").isin(*roles)).select(F.concat_ws("/", "conv_id", "turn").alias("session"), F.regexp_extract_all("text", F.lit("\\p{L}+"), 0).alias("ws"))
    pairs = F.transform("ws", lambda w, k: F.struct(w.alias("w"), F.get("ws", k - 1).alias("last")))
    return talk.select("session", F.size("ws").alias("n"), F.posexplode(pairs).alias("p", "x")).select("session", "n", "x.w", "x.last", (F.col("p") + 1).alias("i"))


def _action(kind: str, seq: Column | int, **fields: Column) -> Column:
    """An action of a word at a place among its numbers."""
    names = {"window": "string", "before": "string", "after": "string", "word": "string", "correction": "string", "offers": "array<string>", "key": "string", "dx": "double", "dy": "double"}
    at = (F.col("i").cast("bigint") * _STEP + seq).alias("seq")
    return F.struct(at, F.lit(kind).alias("kind"), *(fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in names.items()))


def _streamed(s: SparkSession, actions: DataFrame, run: Callable[[DataFrame], DataFrame], schema: str, parts: int = 3) -> DataFrame:
    """What a stream makes of ``actions`` (with i and n) that come in parts, the stream starting anew for each."""
    at = shared_path(s, "typing")
    part = F.least(F.lit(parts - 1), F.floor((F.col("i") - 1) * parts / F.col("n")))
    for k in range(parts):
        actions.filter(part == k).drop("i", "n").write.mode("append").parquet(f"{at}/actions")
        stream = run(s.readStream.schema(ledger.ACTIONS).parquet(f"{at}/actions"))
        with _rocksdb(s):
            stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(schema).parquet(f"{at}/out")


_ALL_WORDS = "w AS (SELECT session, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, ws FROM (SELECT conv_id || '/' || turn AS session, regexp_extract_all(text, '\\p{L}+') AS ws FROM conversations WHERE role IN (%s)))"


@query(
    f"""WITH RECURSIVE {_ALL_WORDS % "'user', 'assistant'"},
act AS (SELECT session, i * 10 AS seq, 'edit' AS kind, CASE WHEN i > 1 THEN ws[i - 1] ELSE '' END AS before, w AS after, NULL AS win FROM w
UNION ALL SELECT session, i * 10 + k, 'see', NULL, NULL, CASE WHEN i > 1 THEN ws[i - 1] ELSE '' END FROM w, range(1, 4) t(k) WHERE i % 7 = 0 AND k <= i % 3 + 1
UNION ALL SELECT session, i * 10 + 5, 'see', NULL, NULL, w FROM w WHERE i % 5 <> 0 AND i % 100 < 60
UNION ALL SELECT session, i * 10 + 6, 'see', NULL, NULL, 'elsewhere' FROM w WHERE i % 13 = 0),
a AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS rn FROM act),
r AS (SELECT session, 0::BIGINT AS rn, []::STRUCT(b VARCHAR, a VARCHAR, n INTEGER)[] AS notes, false AS broken, NULL::VARCHAR AS seen, 0::BIGINT AS seq, NULL::VARCHAR AS verdict FROM (SELECT DISTINCT session FROM a)
UNION ALL SELECT session, rn,
 CASE WHEN how = 'add' THEN list_append(notes, {{'b': before, 'a': after, 'n': 0}}) WHEN how IN ('break', 'foreign', 'none') THEN [] WHEN how IN ('matched', 'stale') THEN CASE WHEN len(rest) > 0 AND rest[1].n >= 3 THEN [] ELSE rest END ELSE notes END,
 CASE WHEN how = 'break' THEN true WHEN kind = 'see' THEN false ELSE broken END, CASE WHEN kind = 'see' THEN win ELSE seen END, seq, CASE WHEN kind = 'see' THEN how END
FROM (SELECT *, list_transform(trimmed[upto + 1 :], lambda x: {{'b': x.b, 'a': x.a, 'n': x.n + 1}}) AS rest,
 CASE WHEN kind = 'edit' THEN CASE WHEN before = after OR broken THEN 'keep' WHEN start IS NOT NULL AND before <> start THEN CASE WHEN len(notes) > 0 OR after IS DISTINCT FROM seen THEN 'break' ELSE 'keep' END WHEN len(notes) >= 32 THEN 'break' ELSE 'add' END
 WHEN broken THEN 'foreign' WHEN len(trimmed) = 0 THEN 'none' WHEN seen IS NOT NULL AND trimmed[1].b <> seen OR upto = 0 AND trimmed[1].b <> win THEN 'foreign' WHEN upto > 0 THEN 'matched' ELSE 'stale' END AS how
FROM (SELECT *, coalesce(list_max(list_transform(range(1, len(trimmed) + 1), lambda k: CASE WHEN trimmed[k].a = win THEN k END)), 0) AS upto
FROM (SELECT r.session, a.rn, a.seq, a.kind, a.before, a.after, a.win, r.notes, r.broken, r.seen, coalesce(r.notes[-1].a, r.seen) AS start,
 CASE WHEN a.kind = 'see' AND r.seen IS NOT NULL THEN r.notes[coalesce(list_position(list_transform(r.notes, lambda x: x.a <> r.seen), true), len(r.notes) + 1) :] ELSE r.notes END AS trimmed
FROM r JOIN a ON a.session = r.session AND a.rn = r.rn + 1) x) y) z)
SELECT session, seq, verdict FROM r WHERE verdict IS NOT NULL"""
)
def session_ledger(s, d):
    """What each sight of a text field is held to be: words follow each other as edits, some of them are seen late,
    several times or not at all, and at times the field shows something else."""
    words = _words(s, d, ("user", "assistant"))
    i, w = F.col("i"), F.col("w")
    before = F.coalesce("last", F.lit(""))
    at = lambda kind, k, **f: _action(kind, F.lit(k), **f)
    late = [F.when((i % 7 == 0) & (F.lit(k) <= i % 3 + 1), at("see", k, window=before)) for k in (1, 2, 3)]
    steps = F.array(at("edit", 0, before=before, after=w), *late, F.when((i % 5 != 0) & (i % 100 < 60), at("see", 5, window=w)), F.when(i % 13 == 0, at("see", 6, window=F.lit("elsewhere"))))
    actions = words.select("session", "i", "n", F.inline(F.filter(steps, lambda x: x.isNotNull())))
    found = _streamed(s, actions, ledger.verdicts, ledger.VERDICTS)
    return found.select("session", (F.floor(F.col("seq") / _STEP) * 10 + F.col("seq") % _STEP).alias("seq"), "verdict")


def _typed_actions(s: SparkSession, d: str) -> DataFrame:
    """The user's turns typed word by word.  Every eleventh word is chosen as it stands, every fifth loses its last letter
    and is corrected, every second of these is reverted; every third word has taps; after every seventeenth
    the field shows something else."""
    words = _words(s, d, ("user",))
    i, w = F.col("i"), F.col("w")
    corrected = lambda k, x: (k % 11 != 0) & (k % 5 == 0) & (F.length(x) >= 3)
    cut = lambda x: F.left(x, F.length(x) - 1)
    last = F.col("last")
    context = F.when(i == 1, "").when((i - 1) % 17 == 0, "elsewhere. ").otherwise(F.concat(F.when(corrected(i - 1, last) & ((i - 1) % 10 == 0), cut(last)).otherwise(last), F.lit(" ")))
    fixed = corrected(i, w)
    words = words.withColumn("typed", F.when(fixed, cut(w)).otherwise(w)).withColumn("context", context)
    typed, end, shown = F.col("typed"), F.concat("w", F.lit(" ")), F.concat("context", "typed")
    back = F.concat("typed", F.lit(" "))
    taps = F.transform(F.sequence(F.lit(1), F.length("typed")), lambda j: _action("tap", 10 + j, key=F.substr("typed", j, F.lit(1)), dx=((i * 7 + j * 3) % 11 - 5) / 10, dy=((i * 5 + j) % 7 - 3) / 10))
    one = lambda when, kind, seq, **f: F.when(when, _action(kind, F.lit(seq), **f))
    yes, reverted = F.lit(True), fixed & (i % 10 == 0)
    steps = F.array(
        one(i == 1, "see", 0, window=F.lit("")), one(i % 11 == 0, "choose", 1, word=w), one(yes, "edit", 99_001, before=F.col("context"), after=shown),
        one(yes, "see", 99_002, window=shown, correction=F.when(fixed, w), offers=F.when(fixed, F.array("w"))), one(yes, "edit", 99_003, before=shown, after=end), one(yes, "see", 99_004, window=end),
        one(reverted, "revert", 99_005), one(reverted, "edit", 99_006, before=end, after=back), one(reverted, "see", 99_007, window=back), one(i % 17 == 0, "see", 99_008, window=F.lit("elsewhere. ")),
    )
    all_steps = F.concat(F.filter(steps, lambda x: x.isNotNull()), F.when(i % 3 == 1, taps).otherwise(F.filter(taps, lambda _: F.lit(False))))
    return words.select("session", "i", "n", F.inline(all_steps))


_TYPED = f"""{_ALL_WORDS % "'user'"},
k AS (SELECT *, i % 11 = 0 AS chosen, i % 11 <> 0 AND i % 5 = 0 AND length(w) >= 3 AS fixed, w[: -2] AS cut FROM w),
f AS (SELECT session, i, CASE WHEN fixed AND i % 10 = 0 THEN cut ELSE w END AS final FROM k),
event AS (SELECT k.session, k.i, 'wc' AS kind, w AS a, CASE WHEN (k.i - 1) % 17 <> 0 THEN f.final END AS b, NULL::DOUBLE AS dx, NULL::DOUBLE AS dy FROM k LEFT JOIN f ON f.session = k.session AND f.i = k.i - 1 WHERE NOT chosen AND NOT fixed
UNION ALL SELECT session, i, 'wt', w, NULL, NULL, NULL FROM k WHERE chosen
UNION ALL SELECT session, i, 'sa', cut, w, NULL, NULL FROM k WHERE fixed
UNION ALL SELECT session, i, 'cr', cut, w, NULL, NULL FROM k WHERE fixed AND i % 10 = 0
UNION ALL SELECT session, i, 'ts', lower(w[j]), NULL, ((i * 7 + j * 3) % 11 - 5) / 10.0, ((i * 5 + j) % 7 - 3) / 10.0 FROM (SELECT *, unnest(range(1, length(w) + 1)) AS j FROM k WHERE i % 3 = 1 AND NOT fixed))"""


@query(f"WITH {_TYPED} SELECT session, i::BIGINT AS word_no, kind, a, b, dx::DOUBLE AS dx, dy::DOUBLE AS dy FROM event")
def session_events(s, d):
    """What typed sessions teach: commits, accepted and reverted corrections, chosen words and taps."""
    found = _streamed(s, _typed_actions(s, d), ledger.learning_events, ledger.EVENTS)
    return found.select("session", F.floor(F.col("seq") / _STEP).alias("word_no"), "kind", "a", "b", "dx", "dy")


@query(f"WITH {_TYPED} SELECT CASE WHEN kind = 'sa' THEN b ELSE a END AS word, count(*) AS count FROM event WHERE kind <> 'ts' GROUP BY ALL")
def session_word_snapshot(s, d):
    """The events' stream as a log whose parts are folded into a snapshot of word counts, each part once."""
    at = shared_path(s, "typing-snapshot")
    found = _streamed(s, _typed_actions(s, d), ledger.learning_events, ledger.EVENTS)
    part = F.pmod(F.xxhash64("session"), F.lit(2))
    fold = lambda batch: batch.filter("kind <> 'ts'").groupBy(F.when(F.col("kind") == "sa", F.col("b")).otherwise(F.col("a")).alias("word")).agg(F.count(F.lit(1)).alias("count"))
    for k in (0, 1):
        found.filter(part == k).write.mode("append").parquet(f"{at}/log")
        log = s.readStream.schema(ledger.EVENTS).parquet(f"{at}/log")
        sessions.compact(log, f"{at}/snapshot", f"{at}/checkpoint", fold, sessions.add_counts).awaitTermination()
    return s.read.parquet(f"{at}/snapshot/batch=1")
