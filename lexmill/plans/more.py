"""Queries over personal views, decisions, joins of code tables, style rules and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import candidates as C
from lexmill.operators import learning as A
from lexmill.operators import lexicon as L
from lexmill.operators import model as M
from lexmill.operators import morphology as P
from lexmill.plans.correction import _EDITS, _SUBST, FORMS, KNOWN, LOG, TYPED, _forms, _gone, _known, _log, _typed, _words
from lexmill.plans.language import BI, CAL, REQ, TOK, _bi, _evidence, _request_pairs, _requests, _scored, _stored, _uni, blend_sql, scored_sql
from lexmill.plans.registry import ORACLE_SQL, query, table
from lexmill.sources import event_logs as E
from lexmill.sources import morphology_files as B
from lexmill.sources import text_tables as X
from lexmill.storage import shared_path
from lexmill.streaming import sessions


@query(f"WITH {LOG}, learned AS (SELECT word, count FROM words WHERE explicit OR n_days >= 2) SELECT word, '' AS previous, count FROM learned UNION ALL SELECT word, previous, count FROM pairs WHERE word IN (SELECT word FROM learned)")
def personal_lexicon(s, d):
    """The personal vocabulary as a lexicon: learned words, and pairs that end in one."""
    words = _words(s, d)
    learned = words.filter(A.learned(words)).select("word", "count")
    pairs = A.fold_pairs(A.committed(_log(s, d), _gone(s)), _gone(s))
    return learned.select("word", F.lit("").alias("previous"), "count").unionByName(pairs.join(learned.select("word"), "word", "left_semi").select("word", "previous", "count"))


@query(f"WITH {LOG}, p AS (SELECT word, max(count) AS pair FROM pairs GROUP BY word) SELECT w.word, round(least(6.0, 2 + 0.75 * ln(1 + w.count)) + least(6.0, 2 * ln(1 + coalesce(p.pair, 0))), 6)::DOUBLE AS boost FROM words w LEFT JOIN p USING (word) WHERE explicit OR n_days >= 2")
def personal_boost(s, d):
    words = _words(s, d)
    best = A.fold_pairs(A.committed(_log(s, d), _gone(s)), _gone(s)).groupBy("word").agg(F.max("count").alias("pair"))
    own = F.least(F.lit(6.0), 2 + 0.75 * F.log1p(F.col("count").cast("double")))
    pair = F.least(F.lit(6.0), 2 * F.log1p(F.coalesce("pair", F.lit(0)).cast("double")))
    return words.filter(A.learned(words)).join(best, "word", "left").select("word", F.round(own + pair, 6).alias("boost"))


@query(f"WITH {TOK}, {CAL}, {REQ}, a AS ({scored_sql('(SELECT DISTINCT previous AS word FROM reqpair)', '1 AS one')}), b AS ({scored_sql('(SELECT DISTINCT word FROM reqpair)', '1 AS one')}) SELECT p.previous AS left, p.word AS right, round({blend_sql('(a.z1 + b.z1)', '(a.z2 + b.z2)')}, 6) AS score FROM reqpair p JOIN a ON a.word = p.previous JOIN b ON b.word = p.word")
def pair_score(s, d):
    """Both words of a split together: their z summed in each lane before the lanes are mixed."""
    pairs = _request_pairs(s, d)
    z = _scored(s, d, _requests(s, d)).select("word", "z_primary", "z_secondary")
    rows = pairs.join(z, "word").join(z.toDF("previous", "zl_primary", "zl_secondary"), "previous")
    score = M.blend(F.col("zl_primary") + F.col("z_primary"), F.col("zl_secondary") + F.col("z_secondary"), F.lit(0.5))
    return rows.select(F.col("previous").alias("left"), F.col("word").alias("right"), F.round(score, 6).alias("score"))


@query(f"WITH {TOK}, {REQ}, {TYPED}, {KNOWN} SELECT typed, substr(typed, 1, length(typed) - 1) || '''s' AS word FROM typed WHERE length(typed) >= 4 AND regexp_full_match(typed, '\\p{{L}}+') AND ends_with(typed, 's') AND substr(typed, 1, length(typed) - 1) IN (SELECT word FROM uni WHERE lane = 'en') AND NOT ends_with(substr(typed, 1, length(typed) - 1), 's')")
def possessive_restoration(s, d):
    """names -> name's, where the base is a known word."""
    base = F.left("typed", F.length("typed") - 1)
    rows = _typed(s, d).filter((F.length("typed") >= 4) & F.col("typed").rlike("^\\p{L}+$") & F.col("typed").endswith("s")).withColumn("base", base).filter(~F.col("base").endswith("s"))
    known = _uni(s, d).filter("lane = 'en'").select(F.col("word").alias("base"))
    return rows.join(known, "base", "left_semi").select("typed", F.concat("base", F.lit("'s")).alias("word"))


@query(f"WITH {TOK}, {BI}, {REQ}, t AS (SELECT DISTINCT previous, substr(word, 1, 1) || substr(word, 3) AS typed FROM reqpair WHERE length(word) >= 4) SELECT DISTINCT previous, typed, w2 AS word FROM t JOIN bi ON w1 = previous WHERE w2 <> typed AND abs(length(w2) - length(typed)) <= 1 AND substr(w2, 1, 1) = substr(typed, 1, 1)")
def context_continuation(s, d):
    """Words that follow the previous word and look like what was typed: about as long, with the same first letter.

    All of them, however rare.  Pairs are told by the first letter and the length of their second word before they are shuffled."""
    typed = _request_pairs(s, d).filter(F.length("word") >= 4).select("previous", F.concat(F.left("word", F.lit(1)), F.substr("word", F.lit(3), F.length("word"))).alias("typed")).distinct()
    near = typed.select("previous", "typed", F.left("typed", F.lit(1)).alias("initial"), F.explode(F.array(*[F.length("typed") + k for k in (-1, 0, 1)])).alias("letters"))
    pool = _stored(s, d).bigrams_after(near.select(F.col("previous").alias("w1")).distinct()).select(F.col("w1").alias("previous"), F.col("w2").alias("word")).distinct()
    pool = pool.withColumns({"initial": F.left("word", F.lit(1)), "letters": F.length("word")})
    by = ["previous", "initial", "letters"]
    pool = pool.join(near.select(*by).distinct(), by, "left_semi")
    return near.join(pool, by).filter(F.col("word") != F.col("typed")).select("previous", "typed", "word")


@query(f"WITH {TOK}, piece AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS w FROM documents), dot AS (SELECT DISTINCT unnest(regexp_extract_all(w, '\\p{{L}}+\\.\\p{{L}}+')) AS token FROM piece WHERE contains(w, '.')), h AS (SELECT token, split_part(token, '.', 1) AS first_half, split_part(token, '.', 2) AS second_half FROM dot), lanes AS (SELECT word, bit_or(CASE lane WHEN 'es' THEN 1 ELSE 2 END) AS bits FROM uni GROUP BY word) SELECT token, first_half, second_half FROM h JOIN lanes a ON a.word = first_half JOIN lanes b ON b.word = second_half WHERE a.bits & b.bits <> 0 AND first_half <> 'www' AND second_half NOT IN ({', '.join(repr(x) for x in T.DOMAINS)})")
def dot_split(s, d):
    """Dotted tokens that are two words of one lane."""
    tokens = table(s, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("\\p{L}+\\.\\p{L}+"), F.lit(0))).alias("token")).distinct()
    halves = tokens.withColumn("h", T.dotted_halves(F.col("token"))).filter("h IS NOT NULL").select("token", F.get("h", 0).alias("first_half"), F.get("h", 1).alias("second_half"))
    uni = _uni(s, d).select("lane", "word")
    return halves.join(uni.toDF("lane", "first_half"), "first_half").join(uni.toDF("lane", "second_half"), ["lane", "second_half"]).select("token", "first_half", "second_half").distinct()


_DECIDE = f"""{_SUBST}, {_EDITS}, cand AS (SELECT typed, word, cost FROM edits SEMI JOIN known USING (word)), x AS ({scored_sql('cand', 'q.typed, q.cost')}),
sc AS (SELECT typed, word, cost, greatest(z1, z2) AS z, round(-cost + {blend_sql('z1', 'z2')}, 9) AS score FROM x), k AS (SELECT *, row_number() OVER (PARTITION BY typed ORDER BY score DESC, word) AS r, score - lead(score) OVER (PARTITION BY typed ORDER BY score DESC, word) AS margin FROM sc)"""


@query(
    f"""WITH {TOK}, {CAL}, {REQ}, {TYPED}, {KNOWN}, {_DECIDE}, g AS (SELECT typed, word, length(typed) >= 2 AS long_enough, cost <= 6.0 AS cheap, length(replace(replace(word, '''', ''), '’', '')) - length(word) <= length(replace(replace(typed, '''', ''), '’', '')) - length(typed) AS marks_kept, z >= -2.5 AS typical, margin IS NULL OR margin >= 1.15 AS ahead FROM k WHERE r = 1)
SELECT *, long_enough AND cheap AND marks_kept AND typical AND ahead AS apply FROM g"""
)
def autocorrect_gates(s, d):
    """The winner of each request and every gate of the decision to apply it."""
    pool = C.edits(_typed(s, d)).join(_known(s, d).select("word"), "word", "left_semi")
    rows = _scored(s, d, pool).withColumn("score", F.round(-F.col("cost") + M.blend(F.col("z_primary"), F.col("z_secondary"), F.lit(0.5)), 9))
    won = M.margins(rows.select("typed", "word", "cost", F.greatest("z_primary", "z_secondary").alias("z"), "score"), ["typed"])
    won = won.withColumn("marks", C.preserved(F.col("typed"), F.col("word"), "'’"))
    return C.decided(won).select("typed", "word", "long_enough", "cheap", "marks_kept", "typical", "ahead", "apply")


@query()
def beam_decode(s, d):
    """Known words within two edits, by typing cost."""
    return C.beam(_typed(s, d), _known(s, d))


_GOVERNED = f"WITH {TOK}, {BI}, {FORMS}, gov(previous, p1, p2, p3, p4) AS (SELECT word, 0.1, 0.2, 0.3, 0.4 FROM uni WHERE lane = 'es' AND frequency >= 200), q AS (SELECT g.previous, f.form AS word, CASE f.bundle & 3 WHEN 0 THEN p1 WHEN 1 THEN p2 WHEN 2 THEN p3 ELSE p4 END AS p FROM gov g JOIN (SELECT DISTINCT w1, w2 FROM bi WHERE lane = 'es') b ON b.w1 = g.previous JOIN forms f ON f.form = b.w2) SELECT previous, word, round(0.6 * max(greatest(ln(p::DOUBLE / 0.25), -2.0)), 6) AS fit FROM q GROUP BY previous, word"


@query(_GOVERNED)
def governor_fit(s, d):
    """How forms fit the cases that the frequent words before them govern, for all pairs of the corpus."""
    return governor_fit_pairs(s, d)


@query("SELECT a.p_partkey, a.p_name AS text, min(b.p_type) AS stem FROM part a LEFT JOIN part b ON b.p_name = a.p_name GROUP BY ALL")
def code_stems(s, d):
    """Entries of a code table with the stem of their text, if it has one."""
    return code_stems_all(s, d)


@query(_GOVERNED)
def governor_fit_pairs(s, d):
    """How forms of any length fit the frequent words that they follow in the corpus."""
    frequent = _uni(s, d).filter("lane = 'es' AND frequency >= 200")
    governors = frequent.select(F.col("word").alias("governor"), F.col("frequency").cast("double").alias("mass"), F.array(*[F.lit(x) for x in (0.1, 0.2, 0.3, 0.4)]).alias("p_case"))
    asked = _bi(s, d).filter("lane = 'es'").select(F.col("w1").alias("previous"), F.col("w2").alias("word")).distinct()
    return P.governor_fit(asked, _forms(s, d), governors).select("previous", "word", F.round("fit", 6).alias("fit"))


@query(ORACLE_SQL["code_stems"])
def code_stems_all(s, d):
    """Entries of a code table with the stem of their text, from the whole table."""
    part = table(s, d, "part")
    return part.join(part.groupBy("p_name").agg(F.min("p_type").alias("stem")), "p_name", "left").select("p_partkey", F.col("p_name").alias("text"), "stem")


@query("WITH r AS (SELECT p_type AS element, p_brand AS property, p_size AS specificity, p_partkey AS position, p_name AS value FROM part) SELECT element, property, max_by(value, specificity * 1000000 + position) AS value FROM r GROUP BY element, property")
def style_rules(s, d):
    """The value of each property: the most specific rule wins, the later one on a tie."""
    rows = table(s, d, "part").select(F.col("p_type").alias("element"), F.col("p_brand").alias("property"), F.col("p_size").alias("specificity"), F.col("p_partkey").alias("position"), F.col("p_name").alias("value"))
    return rows.groupBy("element", "property").agg(F.max_by("value", F.struct("specificity", "position")).alias("value"))


@query("SELECT doc_id, right(regexp_extract(replace(text, chr(10), ' '), '([^.!?]*[.!?]?\\s*)$', 1), 200) AS shown FROM documents")
def document_window(s, d):
    """The last sentence of a text, 200 characters at most."""
    return table(s, d, "documents").select("doc_id", T.last_sentence(F.right("text", F.lit(200))).alias("shown"))  # no more can show, and what is shown of a sentence is its end


@query("SELECT doc_id, regexp_extract(text, '[a-z]*$', 0) AS composing FROM documents")
def composing_range(s, d):
    """The longest run of composing letters at the end of a text."""
    return table(s, d, "documents").select("doc_id", F.regexp_extract("text", "[a-z]*\\z", 0).alias("composing"))


@query(ORACLE_SQL["lane_posterior"])
def stream_lane_posterior(s, d):
    """The lane filter as a stream over conversations with one number of state a session."""
    talk = table(s, d, "conversations")
    words = talk.select(F.explode(L.word_array(F.col("text"))).alias("word")).distinct()
    evidence = _evidence(_scored(s, d, words)).select("word", "evidence")
    stream = s.readStream.schema(talk.schema).parquet(f"{d}/conversations.parquet*").select(F.col("conv_id").cast("string").alias("session"), "turn", L.word_array(F.col("text")).alias("ws"))
    marked = F.concat(F.transform("ws", lambda w, i: F.struct(i.alias("pos"), w.alias("word"))), F.array(F.struct(F.lit(1_000_000).alias("pos"), F.lit(None).cast("string").alias("word"))))
    steps = stream.select("session", "turn", F.inline(marked)).join(evidence, "word", "left")
    out = shared_path(s, "stream")
    states = sessions.lane_states(steps.select("session", (F.col("turn") * 10_000_000 + F.col("pos")).alias("at"), "evidence"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/states/batch={number}")

    states.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = s.read.parquet(f"{out}/states").groupBy("session").agg(F.max_by("p_primary", "steps").alias("p"))
    return last.select(F.col("session").cast("bigint").alias("conv_id"), F.round("p", 6).alias("p_primary"))


@query("SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END, ts DESC, event_id DESC) AS position FROM events QUALIFY position <= 5")
def pinned_first(s, d):
    """Items of each user, pinned ones first, then the newest."""
    order = Window.partitionBy("user_id").orderBy(F.when(F.col("event_type") == "purchase", 0).otherwise(1), F.col("ts").desc(), F.col("event_id").desc())
    return table(s, d, "events").withColumn("position", F.row_number().over(order)).filter("position <= 5").select("user_id", "event_id", "event_type", "position")


@query(
    """WITH t AS (SELECT conv_id, turn, replace(lower(text), '’', '''') AS text, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT NULL AS more FROM conversations), k AS (SELECT conv_id, turn, text, more, regexp_extract_all(text, '[\\p{L}'']+|[.!?]') AS ts FROM t),
w AS (SELECT conv_id, turn, i - 1 AS pos, ts[i] AS word, CASE WHEN i > 1 THEN ts[i - 1] END AS p, i = len(ts) AND ends_with(text, ts[i]) AS open, more FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM k))
SELECT conv_id, turn, pos, word, CASE WHEN p IN ('.', '!', '?') THEN NULL ELSE p END AS previous FROM w WHERE word NOT IN ('.', '!', '?') AND (more OR NOT open)"""
)
def stream_commits(s, d):
    """The words that conversations commit, as a stream with one pending word of state a session."""
    schema = table(s, d, "conversations").schema
    stream = s.readStream.schema(schema).parquet(f"{d}/conversations.parquet*").select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("at"), "text")
    out = shared_path(s, "commits")
    sessions.commits(stream).writeStream.format("parquet").option("path", f"{out}/events").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(sessions.COMMITS).parquet(f"{out}/events").select(F.col("session").cast("bigint").alias("conv_id"), F.col("at").alias("turn"), F.col("pos").cast("bigint").alias("pos"), "word", "previous")


@query("SELECT user_id, count(*) AS items, max(event_id) AS newest FROM events GROUP BY user_id")
def stream_live_counts(s, d):
    """A live view: the whole result again after every change of its table."""
    schema = table(s, d, "events").schema
    view = s.readStream.schema(schema).parquet(f"{d}/events.parquet*").groupBy("user_id").agg(F.count(F.lit(1)).alias("items"), F.max("event_id").alias("newest"))
    out = shared_path(s, "live")

    def show(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/view")  # complete mode: every emission replaces the one before

    view.writeStream.foreachBatch(show).outputMode("complete").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{out}/view")


@query(f"WITH {LOG} SELECT day, kind, count(*) AS events FROM log WHERE kind IN ('wc', 'wt') AND day > (SELECT min(day) FROM log) GROUP BY ALL")
def event_log_truncate(s, d):
    """Events appended to a log in two goes, and the log's next generation without its first day."""
    log = _log(s, d).filter("kind IN ('wc', 'wt')").select("seq", "day", "kind", F.col("word").alias("a"), F.col("previous").alias("b"), F.col("hint").alias("c"))
    path = shared_path(s, "event-log")
    for half in (0, 1):
        X.append_events(log.filter(F.col("seq") % 2 == half), f"{path}/generation=1")
    first = _log(s, d).agg(F.min("day")).first()[0]
    X.truncated(s.read.text(f"{path}/generation=1"), first).write.text(f"{path}/generation=2")
    return X.parse_events(s.read.text(f"{path}/generation=2")).groupBy("day", "kind").agg(F.count(F.lit(1)).alias("events"))


@query(f"WITH {LOG} SELECT seq % 3 AS log, day, kind, count(*) AS events FROM log WHERE kind IN ('wc', 'wt') GROUP BY ALL")
def event_log_stream(s, d):
    """Three logs read as a stream that stops, while writers append and start generations without what was folded."""
    s.dataSource.register(E.EventLogs)
    log = _log(s, d).filter("kind IN ('wc', 'wt')").select(F.concat(F.lit("log-"), (F.col("seq") % 3).cast("string")).alias("log"), "seq", "day", "kind", F.col("word").alias("a"), F.col("previous").alias("b"), F.col("hint").alias("c"))
    lines = X.event_lines(log, "log", "seq")
    path, out = shared_path(s, "event-logs"), shared_path(s, "event-stream")
    for part, folded in ((0, None), (1, 0.5), (2, 0.9)):
        E.write_generation(lines.filter(F.floor(F.col("seq") / 3) % 3 == part), path, part + 1, folded)
        stream = s.readStream.format("event_logs").load(path)
        stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    read = s.read.schema(E.SCHEMA).parquet(f"{out}/rows")
    return X.parse_events(read, keep=("log",)).groupBy(F.substring("log", 5, 9).cast("bigint").alias("log"), "day", "kind").agg(F.count(F.lit(1)).alias("events"))


@query(f"WITH {TOK}, {FORMS} SELECT form, lemma, 'no' AS pos, ['nf', 'þf', 'þgf', 'ef'][(bundle & 3) + 1] AS \"case\", ['kk', 'kvk'][gender + 1] AS gender, CASE WHEN (bundle >> 2) & 1 = 1 THEN 'ft' ELSE 'et' END AS number FROM forms")
def morphology_scan(s, d):
    """Forms written as binary morphology files and scanned by ranges of words."""
    s.dataSource.register(B.MorphologyFiles)
    f = P.unpack(F.col("bundle"))
    named = lambda names, code: F.element_at(F.array(*[F.lit(n) for n in names]), code + 1)
    forms = _forms(s, d).select("form", "lemma", F.lit("no").alias("pos"), named(P.CASES, f["case_code"]).alias("case"), named(("kk", "kvk"), F.col("gender")).alias("gender"), F.when(f["plural"], "ft").otherwise("et").alias("number"))
    path = shared_path(s, "forms")
    B.write_forms(forms, path)
    return s.read.format("morphology_files").option("rangeRecords", 2000).load(path)


@query(f"WITH {TOK}, {BI} SELECT w1, w2, sum(frequency)::BIGINT AS frequency FROM bi GROUP BY ALL")
def word_pair_scan(s, d):
    """Word pairs of both lanes written as sections of binary files and scanned by ranges."""
    s.dataSource.register(B.MorphologyFiles)
    path = shared_path(s, "word-pairs")
    B.write_pairs(_bi(s, d).groupBy("w1", "w2").agg(F.sum("frequency").alias("frequency")), path)
    return s.read.format("morphology_files").option("section", "pairs").load(path)


@query(f"WITH {TOK}, {FORMS} SELECT lemma, pos, gender, form, bundle FROM forms")
def paradigm_scan(s, d):
    """Paradigms written as binary files with an index by form, scanned by ranges of entries."""
    s.dataSource.register(B.ParadigmFiles)
    path = shared_path(s, "paradigms")
    B.write_paradigms(_forms(s, d), path)
    return s.read.format("paradigm_files").option("rangeRecords", 2000).load(path)
