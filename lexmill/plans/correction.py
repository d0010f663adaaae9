"""Queries over candidates, learning, morphology, text functions and gestures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.config import CONFUSIONS, DEFAULT, EDIT_ALPHABET, LANE_CONFUSIONS, RESTORATIONS, key_centers
from lexmill.functions import text as T
from lexmill.operators import candidates as C
from lexmill.operators import glide as G
from lexmill.operators import learning as A
from lexmill.operators import lexicon as L
from lexmill.operators import model as M
from lexmill.operators import morphology as P
from lexmill.plans.language import CAL, REQ, TOK, _requests, _scored, _uni, blend_sql, scored_sql
from lexmill.plans.registry import query, table
from lexmill.sources import text_tables as X

# requests: every distinct benchmark word of 4 to 12 letters without its third letter
TYPED = "typed AS (SELECT DISTINCT substr(word, 1, 2) || substr(word, 4) AS typed FROM req WHERE length(word) BETWEEN 4 AND 12)"
KNOWN = "known AS (SELECT word, sum(frequency)::BIGINT AS frequency FROM uni GROUP BY word)"
_Q = lambda s: s.replace("'", "''")
_KEYS = "keys(k, x, y) AS (VALUES " + ", ".join(f"('{k}', {x}::DOUBLE, {y}::DOUBLE)" for k, (x, y) in sorted(key_centers().items())) + ")"
_ALPHA = "alpha AS (SELECT unnest(string_split('" + _Q("|".join(EDIT_ALPHABET)) + "', '|')) AS c)"
_CONF = "conf AS (SELECT unnest(string_split('" + "|".join(CONFUSIONS) + "', '|')) AS pair)"
_SUBST = f"""{_KEYS}, {_ALPHA}, {_CONF}, subst AS (SELECT a.c AS typed_c, b.c AS c, CASE WHEN a.c || b.c IN (SELECT pair FROM conf) THEN 1.5 WHEN ka.k IS NULL OR kb.k IS NULL THEN 5.0 ELSE least(greatest((pow(ka.x - kb.x, 2) + pow(ka.y - kb.y, 2)) / 0.98, 0.35), 8.0) END AS cost
FROM alpha a JOIN alpha b ON a.c <> b.c LEFT JOIN keys ka ON ka.k = a.c LEFT JOIN keys kb ON kb.k = b.c)"""
_EDITS = """spots AS (SELECT typed, unnest(range(1, length(typed) + 1)) AS i FROM typed), gaps AS (SELECT typed, unnest(range(0, length(typed) + 1)) AS i FROM typed),
alledits AS (SELECT typed, substr(typed, 1, i - 1) || substr(typed, i + 1) AS word, 4.0 AS cost FROM spots
 UNION ALL SELECT typed, substr(typed, 1, i - 1) || substr(typed, i + 1, 1) || substr(typed, i, 1) || substr(typed, i + 2), 2.0 FROM spots WHERE i < length(typed) AND substr(typed, i, 1) <> substr(typed, i + 1, 1)
 UNION ALL SELECT typed, substr(typed, 1, i - 1) || alpha.c || substr(typed, i + 1), coalesce(subst.cost, 5.0) FROM spots JOIN alpha ON alpha.c <> substr(typed, i, 1) LEFT JOIN subst ON subst.typed_c = substr(typed, i, 1) AND subst.c = alpha.c
 UNION ALL SELECT typed, substr(typed, 1, i) || alpha.c || substr(typed, i + 1), 4.0 FROM gaps, alpha),
edits AS (SELECT typed, word, min(cost) AS cost FROM alledits GROUP BY ALL)"""


def _typed(s: SparkSession, d: str) -> DataFrame:
    words = _requests(s, d).filter(F.length("word").between(4, 12))
    return words.select(F.concat(F.left("word", F.lit(2)), F.substr("word", F.lit(4), F.length("word"))).alias("typed")).distinct()


def _known(s: SparkSession, d: str) -> DataFrame:
    return _uni(s, d).groupBy("word").agg(F.sum("frequency").alias("frequency"))


@query(f"WITH {TOK}, {REQ}, {TYPED}, {KNOWN}, {_SUBST}, {_EDITS} SELECT typed, word, round(cost, 6)::DOUBLE AS cost FROM edits SEMI JOIN known USING (word)")
def edit1_candidates(s, d):
    return C.edits(_typed(s, d)).join(_known(s, d).select("word"), "word", "left_semi").select("typed", "word", F.round("cost", 6).alias("cost"))


@query(
    f"""WITH {TOK}, {CAL}, {REQ}, {TYPED}, {KNOWN}, {_SUBST}, {_EDITS}, cand AS (SELECT typed, word, cost FROM edits SEMI JOIN known USING (word)), x AS ({scored_sql('cand', 'q.typed, q.cost')}),
s AS (SELECT typed, word, -cost + {blend_sql('z1', 'z2')} AS score FROM x), k AS (SELECT *, row_number() OVER (PARTITION BY typed ORDER BY round(score, 9) DESC, word) AS rank FROM s),
e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY typed)) AS e FROM k WHERE rank <= 8) SELECT typed, word, rank, round(score, 6) AS score, round(e / sum(e) OVER (PARTITION BY typed), 6) AS confidence FROM e QUALIFY rank <= 5"""
)
def corrections_ranked(s, d):
    """One-edit candidates by channel cost and language score, with softmax confidence."""
    pool = C.edits(_typed(s, d)).join(_known(s, d).select("word"), "word", "left_semi")
    rows = _scored(s, d, pool).withColumn("score", -F.col("cost") + DEFAULT.language_weight * M.blend(F.col("z_primary"), F.col("z_secondary"), F.lit(0.5))).withColumn("by", F.round("score", 9))
    ranked = M.ranked(rows.select("typed", "word", "score", "by"), ["typed"], 5, "by")
    return ranked.select("typed", "word", "rank", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"))


_RESTORE = "rest(a, b) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, bs in RESTORATIONS.items() for b in bs) + ")"


@query(
    f"""WITH RECURSIVE {TOK}, {REQ}, {TYPED}, {_RESTORE}, v AS (SELECT typed, typed AS word, 0::BIGINT AS at, 0 AS changed FROM typed
UNION ALL SELECT v.typed, substr(v.word, 1, p.i - 1) || rest.b || substr(v.word, p.i + 1), p.i, v.changed + 1 FROM v, LATERAL (SELECT unnest(range(v.at + 1, length(v.word) + 1)) AS i) p JOIN rest ON rest.a = substr(v.word, p.i, 1) WHERE v.changed < 2)
SELECT typed, word, changed FROM v WHERE changed > 0"""
)
def diacritic_variants(s, d):
    return C.restorations(_typed(s, d), 2)


@query(
    f"""WITH {TOK}, {REQ}, {TYPED}, p AS (SELECT typed, unnest(range(1, length(typed) + 1)) AS i FROM typed WHERE length(typed) >= 2)
SELECT typed, substr(typed, 1, i) || substr(typed, i + 2) AS word FROM p WHERE i < length(typed) AND substr(typed, i, 1) = substr(typed, i + 1, 1)
UNION SELECT typed, substr(typed, 1, i) || substr(typed, i) FROM p WHERE i = 1 OR substr(typed, i, 1) <> substr(typed, i - 1, 1)"""
)
def gemination_variants(s, d):
    return C.geminations(_typed(s, d))


@query(
    f"""WITH {TOK}, {REQ}, {KNOWN}, j AS (SELECT DISTINCT a.word || b.word AS typed FROM (SELECT word FROM req WHERE length(word) BETWEEN 3 AND 5) a JOIN (SELECT word FROM req WHERE length(word) BETWEEN 3 AND 5) b ON substr(a.word, 1, 1) = substr(b.word, 1, 1)),
c AS (SELECT typed, unnest(range(1, length(typed))) AS i FROM j WHERE length(typed) >= 5), r AS (SELECT *, row_number() OVER (PARTITION BY typed ORDER BY abs(2 * i - length(typed)), i) AS n FROM c)
SELECT typed, substr(typed, 1, i) AS left, substr(typed, i + 1) AS right FROM r WHERE n <= 12 AND substr(typed, 1, i) IN (SELECT word FROM known) AND substr(typed, i + 1) IN (SELECT word FROM known)"""
)
def space_split(s, d):
    short = _requests(s, d).filter(F.length("word").between(3, 5)).withColumn("h", F.left("word", F.lit(1)))
    joined = short.alias("a").join(short.alias("b"), "h").select(F.concat("a.word", "b.word").alias("typed")).distinct()
    return C.splits(joined, _known(s, d))


@query(f"WITH {TOK}, {REQ}, {TYPED}, p AS (SELECT typed, unnest(range(greatest(3, length(typed) - 4), length(typed))) AS n FROM typed WHERE length(typed) >= 5), m AS (SELECT typed, lane, substr(typed, 1, n) AS prefix, word, row_number() OVER (PARTITION BY typed, n, lane ORDER BY frequency DESC, word) AS r FROM p JOIN uni ON substr(word, 1, 3) = substr(typed, 1, 3) AND starts_with(word, substr(typed, 1, n))) SELECT DISTINCT typed, word FROM m WHERE r <= 8")
def shorter_prefix(s, d):
    typed = _typed(s, d).filter(F.length("typed") >= 5)
    prefixes = typed.select("typed", F.explode(F.sequence(F.greatest(F.lit(3), F.length("typed") - 4), F.length("typed") - 1)).alias("n")).select("typed", F.left("typed", F.col("n")).alias("prefix"))
    found = L.completions(prefixes.select("prefix").distinct(), _uni(s, d), DEFAULT.completion_limit, scan_limit=False).select("prefix", "word")
    return prefixes.join(found, "prefix").select("typed", "word").distinct()


@query(
    f"""WITH {TOK}, {REQ}, {TYPED}, {KNOWN}, t AS (SELECT typed, typed IN (SELECT word FROM known) AS valid FROM typed), c AS (SELECT typed, count(*) AS suggestions FROM typed JOIN known ON substr(word, 1, 3) = substr(typed, 1, 3) AND starts_with(word, typed) GROUP BY typed)
SELECT typed, CASE WHEN valid THEN 'valid' WHEN suggestions > 0 THEN 'typo' ELSE 'unspecified' END AS verdict, CASE WHEN valid THEN 0 ELSE least(coalesce(suggestions, 0), 8) END AS suggestions FROM t LEFT JOIN c USING (typed)"""
)
def spell_check(s, d):
    typed, known = _typed(s, d), _known(s, d)
    valid = typed.join(known.select(F.col("word").alias("typed"), F.lit(True).alias("valid")), "typed", "left")
    more = L.completions(typed.filter(F.length("typed") >= 3).select(F.col("typed").alias("prefix")), known.withColumn("lane", F.lit("any")), DEFAULT.completion_limit, scan_limit=False).groupBy(F.col("prefix").alias("typed")).agg(F.count(F.lit(1)).alias("n"))
    verdict = F.when(F.col("valid"), "valid").when(F.col("n") > 0, "typo").otherwise("unspecified")
    return valid.join(more, "typed", "left").select("typed", verdict.alias("verdict"), F.when(F.col("valid"), 0).otherwise(F.coalesce("n", F.lit(0))).cast("bigint").alias("suggestions"))


@query(
    f"""WITH {TOK}, {REQ}, {TYPED}, {KNOWN}, {_SUBST}, {_EDITS}, u AS (SELECT typed, word, 'edits' AS provider, 1 AS o, cost FROM edits SEMI JOIN known USING (word)
UNION ALL SELECT typed, word, 'completion', 2, 0.5 * (length(word) - length(typed)) FROM (SELECT typed, word, row_number() OVER (PARTITION BY typed ORDER BY frequency DESC, word) AS r FROM typed JOIN known ON substr(word, 1, 3) = substr(typed, 1, 3) AND starts_with(word, typed) WHERE length(typed) >= 3) WHERE r <= 8)
SELECT typed, word, min_by(provider, o) AS provider, round(min_by(cost, o), 6)::DOUBLE AS cost, array_to_string(list_sort(list_distinct(list(provider))), ',') AS providers FROM u GROUP BY typed, word"""
)
def first_wins_admission(s, d):
    """A candidate that several providers find keeps the cost of the first."""
    typed, known = _typed(s, d), _known(s, d)
    edits = C.edits(typed).join(known.select("word"), "word", "left_semi").select("typed", "word", F.lit("edits").alias("provider"), F.lit(1).alias("provider_order"), "cost")
    more = L.completions(typed.filter(F.length("typed") >= 3).select(F.col("typed").alias("prefix")), known.withColumn("lane", F.lit("any")), DEFAULT.completion_limit, scan_limit=False)
    more = more.select(F.col("prefix").alias("typed"), "word", F.lit("completion").alias("provider"), F.lit(2).alias("provider_order"), (DEFAULT.completion_char_cost * (F.length("word") - F.length("prefix"))).alias("cost"))
    return C.admitted(edits.unionByName(more)).select("typed", "word", "provider", F.round("cost", 6).alias("cost"), F.array_join("providers", ",").alias("providers"))


@query(f"WITH {TOK}, {REQ}, {TYPED}, {KNOWN}, {_SUBST}, {_EDITS}, c AS (SELECT typed, word, cost FROM edits SEMI JOIN known USING (word)) SELECT provider, count(*) AS candidates FROM (SELECT CASE WHEN cost = 2.0 THEN 'transposition' WHEN cost = 4.0 THEN 'indel' ELSE 'substitution' END AS provider FROM c) GROUP BY provider")
def provider_summary(s, d):
    rows = C.edits(_typed(s, d)).join(_known(s, d).select("word"), "word", "left_semi")
    return rows.groupBy(F.when(F.col("cost") == 2.0, "transposition").when(F.col("cost") == 4.0, "indel").otherwise("substitution").alias("provider")).agg(F.count(F.lit(1)).alias("candidates"))


_FREE = "(SELECT a || b FROM rest WHERE b IN ('á', 'é', 'í', 'ó', 'ú', 'ý') UNION SELECT b || a FROM rest WHERE b IN ('á', 'é', 'í', 'ó', 'ú', 'ý') UNION SELECT unnest(['" + "', '".join(CONFUSIONS) + "']))"
_ACUTES = "(SELECT a || b FROM rest WHERE b IN ('á', 'é', 'í', 'ó', 'ú', 'ý'))"
_LANES = "('" + "', '".join(LANE_CONFUSIONS) + "')"


@query(
    f"""WITH {TOK}, {REQ}, {TYPED}, {KNOWN}, {_SUBST}, {_EDITS}, {_RESTORE}, c AS (SELECT typed, word, cost FROM edits SEMI JOIN known USING (word)), sub AS (SELECT typed_c || c AS p, cost FROM subst),
same AS (SELECT typed, word, unnest(range(1, length(typed) + 1)) AS i FROM c WHERE length(typed) = length(word)),
one AS (SELECT typed, word, substr(typed, i, 1) || substr(word, i, 1) AS p FROM same WHERE substr(typed, i, 1) <> substr(word, i, 1)),
price AS (SELECT o.*, coalesce(sub.cost, 5.0) AS plain, o.p IN {_ACUTES} AS acute, o.p IN {_LANES} AS lane, o.p IN {_FREE} AS free FROM one o LEFT JOIN sub USING (p)),
both_ AS (SELECT typed, word, count(*) AS n, sum(plain) AS plain, sum(CASE WHEN acute THEN 0.35 * (1 - 0.896) WHEN lane THEN 1.5 * (1 - 0.5 * 0.896) ELSE plain END) AS priced, count(*) FILTER (acute OR lane) AS restored, count(*) FILTER (NOT free) AS edits FROM price GROUP BY ALL),
mark AS (SELECT typed, word, length(word) = length(typed) + 1 AND contains(word, '''') AND replace(word, '''', '') = replace(typed, '''', '') AS mark FROM c)
SELECT typed, word, round(cost, 6)::DOUBLE AS cost, round(CASE WHEN n IS NULL THEN 4.0 WHEN n = 2 THEN least(2.0, plain) ELSE plain END, 6)::DOUBLE AS typing, CASE WHEN n IS NULL THEN CASE WHEN mark THEN 0 ELSE 1 END ELSE least(edits, 1) END::BIGINT AS rewrite,
 round(CASE WHEN n IS NULL THEN 4.0 WHEN n = 2 THEN least(2.0, priced) ELSE priced END, 6)::DOUBLE AS total, CASE WHEN n IS NULL THEN CASE WHEN mark THEN 0 ELSE 1 END WHEN n = 2 AND priced >= 2.0 THEN 1 ELSE n - restored END::BIGINT AS error_ops, CASE WHEN n IS NULL THEN CASE WHEN mark THEN 1 ELSE 0 END WHEN n = 2 AND priced >= 2.0 THEN 0 ELSE restored END::BIGINT AS restoration_ops
FROM c LEFT JOIN both_ USING (typed, word) LEFT JOIN mark USING (typed, word)"""
)
def channel_costs(s, d):
    """Typing cost, rewrite distance and lane-priced channel cost of each one-edit candidate."""
    rows = C.edits(_typed(s, d)).join(_known(s, d).select("word"), "word", "left_semi")
    rows = rows.withColumn("c", C.channel_cost("typed", "word", F.lit(0.7)))
    costs = [F.round(c, 6).alias(n) for n, c in (("cost", F.col("cost")), ("typing", C.typing_cost("typed", "word")), ("total", F.col("c.total")))]
    return rows.select("typed", "word", *costs, C.rewrite_distance("typed", "word").cast("bigint").alias("rewrite"), *(F.col(f"c.{n}").cast("bigint").alias(n) for n in ("error_ops", "restoration_ops")))


@query(
    f"""WITH {_KEYS}, t AS (SELECT event_id AS tap_id, (event_id % 100) / 10.0::DOUBLE AS x, (event_id % 30) / 10.0::DOUBLE AS y FROM events), n AS (SELECT tap_id, k AS key, (pow(t.x - keys.x, 2) + pow(t.y - keys.y, 2)) / 0.98 AS nll FROM t, keys WHERE k NOT IN ('á', 'é', 'í', 'ó', 'ú', 'ý')),
p AS (SELECT tap_id, key, nll, exp(-nll) / sum(exp(-nll)) OVER (PARTITION BY tap_id) AS posterior FROM n), k AS (SELECT *, row_number() OVER (PARTITION BY tap_id ORDER BY round(posterior, 9) DESC, key) AS r FROM p) SELECT tap_id, key, round(posterior, 6) AS posterior FROM k WHERE r = 1"""
)
def tap_confidence(s, d):
    """The likeliest key of each tap and its posterior over all keys."""
    taps = table(s, d, "events").select(F.col("event_id").alias("tap_id"), ((F.col("event_id") % 100) / 10.0).cast("double").alias("x"), ((F.col("event_id") % 30) / 10.0).cast("double").alias("y"))
    best = C.tap_likelihoods(taps).groupBy("tap_id").agg(F.max_by(F.struct("key", "posterior"), F.struct(F.round("posterior", 9), F.negative(F.ascii("key")))).alias("b"))
    return best.select("tap_id", "b.key", F.round("b.posterior", 6).alias("posterior"))


# ---- learning: the events table as a log
LOG = """log AS (SELECT event_id AS seq, floor(epoch_us(ts) / 86400000000)::INT AS day, CASE event_type WHEN 'view' THEN 'wc' WHEN 'click' THEN 'sa' WHEN 'purchase' THEN 'wt' WHEN 'signup' THEN 'cr' ELSE 'ts' END AS kind, 'w' || (user_id % 40) AS word, 'w' || (event_id % 25) AS previous, CASE event_id % 3 WHEN 0 THEN 'is' WHEN 1 THEN 'en' ELSE 'un' END AS hint, value / 100 - 0.5 AS dx, (event_id % 7) / 10.0::DOUBLE AS dy FROM events),
gone(word) AS (VALUES ('w3'), ('w7')),
com AS (SELECT seq, day, kind, word, CASE WHEN kind = 'wc' THEN previous END AS previous, CASE WHEN kind = 'wc' THEN hint ELSE 'un' END AS hint FROM log WHERE kind <> 'ts' AND word NOT IN (SELECT word FROM gone)),
byday AS (SELECT word, day, count(*) AS n, min(seq) AS first, bool_or(kind = 'wt' AND seq % 50 = 0) AS explicit, count(*) FILTER (hint = 'is') AS is_, count(*) FILTER (hint = 'en') AS en_, count(*) FILTER (hint = 'un') AS un_ FROM com GROUP BY ALL),
words AS (SELECT word, sum(n)::BIGINT AS count, sum(is_)::BIGINT AS count_is, sum(en_)::BIGINT AS count_en, sum(un_)::BIGINT AS count_un, bool_or(explicit) AS explicit, array_to_string(list_sort(list(day) FILTER (pos <= 8)), ',') AS days, count(*) FILTER (pos <= 8) AS n_days FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY first) AS pos FROM byday) GROUP BY word),
pairs AS (SELECT previous, word, count(*) AS count FROM com WHERE previous IS NOT NULL AND previous NOT IN (SELECT word FROM gone) GROUP BY ALL)"""


def _log(s: SparkSession, d: str) -> DataFrame:
    from lexmill.plans.stores import us

    e = table(s, d, "events")
    kind = F.when(F.col("event_type") == "view", "wc").when(F.col("event_type") == "click", "sa").when(F.col("event_type") == "purchase", "wt").when(F.col("event_type") == "signup", "cr").otherwise("ts")
    name = lambda x: F.concat(F.lit("w"), x.cast("string"))
    return e.select(
        F.col("event_id").alias("seq"), F.floor(us("ts") / 86_400_000_000).cast("int").alias("day"), kind.alias("kind"), name(F.col("user_id") % 40).alias("word"), name(F.col("event_id") % 25).alias("previous"),
        F.element_at(F.array(F.lit("is"), F.lit("en"), F.lit("un")), (F.col("event_id") % 3 + 1).cast("int")).alias("hint"), (F.col("value") / 100 - 0.5).alias("dx"), ((F.col("event_id") % 7) / 10.0).cast("double").alias("dy"),
    )


def _gone(s: SparkSession) -> DataFrame:
    return s.createDataFrame([("w3",), ("w7",)], "word string")


def _words(s: SparkSession, d: str) -> DataFrame:
    # every fiftieth tap counts as a mark, the others as plain commits
    log = _log(s, d).withColumn("kind", F.when((F.col("kind") == "wt") & (F.col("seq") % 50 != 0), "sa").otherwise(F.col("kind")))
    return A.fold_words(A.committed(log, _gone(s)))


@query(f"WITH {LOG} SELECT word, count, count_is, count_en, count_un, explicit, days FROM words")
def personal_word_fold(s, d):
    return _words(s, d).withColumn("days", F.array_join(F.transform("days", lambda x: x.cast("string")), ","))


@query(f"WITH {LOG} SELECT previous, word, count FROM pairs")
def personal_bigram_fold(s, d):
    return A.fold_pairs(A.committed(_log(s, d), _gone(s)), _gone(s)).select("previous", "word", "count")


@query(f"WITH {LOG} SELECT word, explicit OR n_days >= 2 AS learned FROM words")
def learned_words(s, d):
    words = _words(s, d)
    return words.select("word", A.learned(words).alias("learned"))


@query(f"WITH {LOG}, dec AS (SELECT word, explicit, CASE WHEN (SELECT sum(count) FROM words) > 2000 THEN floor(count * 0.5)::BIGINT ELSE count END AS count FROM words) SELECT word, count FROM (SELECT *, row_number() OVER (ORDER BY explicit DESC, count DESC, word DESC) AS r FROM dec WHERE count > 0 OR explicit) WHERE r <= 20 OR explicit")
def decay_and_caps(s, d):
    return A.capped_words(A.decayed(_words(s, d), 2000), 20).select("word", "count")


@query(f"WITH {LOG} SELECT previous, word, count FROM pairs ORDER BY count DESC, previous, word LIMIT 200")
def capped_bigrams(s, d):
    return A.capped_pairs(A.fold_pairs(A.committed(_log(s, d), _gone(s)), _gone(s)), 200).select("previous", "word", "count")


@query(f"WITH {LOG} SELECT word AS key, count(*) AS n, round(avg(dx), 6) AS mean_dx, round(avg(dy), 6) AS mean_dy, round(var_samp(dx), 6) AS var_dx, round(var_samp(dy), 6) AS var_dy, round(covar_samp(dx, dy), 6) AS cov FROM log GROUP BY word")
def touch_moments(s, d):
    m = A.moments(_log(s, d).withColumnRenamed("word", "key"))
    return m.select("key", "n", *(F.round(c, 6).alias(c) for c in ("mean_dx", "mean_dy", "var_dx", "var_dy", "cov")))


@query(f"""WITH {LOG}, m AS (SELECT word AS key, count(*) AS n, avg(dx) AS mx, var_samp(dx) AS vx, var_samp(dy) AS vy, covar_samp(dx, dy) AS cov FROM log GROUP BY word), w AS (SELECT *, n / (n + 50.0::DOUBLE) AS w FROM m),
s AS (SELECT *, sqrt(greatest(w * vx + (1 - w) * 0.49, 0.0064)) AS sx, sqrt(greatest(w * vy + (1 - w) * 0.49, 0.0064)) AS sy FROM w) SELECT key, round(CASE WHEN n >= 30 THEN w * mx END, 6) AS shift_x, round(CASE WHEN n >= 30 THEN sx END, 6) AS sigma_x, round(CASE WHEN n >= 30 THEN sy END, 6) AS sigma_y, round(CASE WHEN n >= 30 THEN least(greatest(w * cov / (sx * sy), -0.9), 0.9) END, 6) AS rho FROM s""")
def shrinkage_blend(s, d):
    m = A.shrunk(A.moments(_log(s, d).withColumnRenamed("word", "key")))
    return m.select("key", *(F.round(c, 6).alias(c) for c in ("shift_x", "sigma_x", "sigma_y", "rho")))


@query(
    f"""WITH RECURSIVE {LOG}, r AS (SELECT word AS key, row_number() OVER (PARTITION BY word ORDER BY seq) AS i, dx, dy FROM log),
f AS (SELECT key, 0::BIGINT AS i, 0::DOUBLE AS n, 0::DOUBLE AS mx, 0::DOUBLE AS my, 0::DOUBLE AS sx, 0::DOUBLE AS sy, 0::DOUBLE AS c FROM (SELECT DISTINCT key FROM r)
UNION ALL SELECT key, i, CASE WHEN n > 200 THEN n / 2 ELSE n END, mx, my, CASE WHEN n > 200 THEN sx / 2 ELSE sx END, CASE WHEN n > 200 THEN sy / 2 ELSE sy END, CASE WHEN n > 200 THEN c / 2 ELSE c END
FROM (SELECT key, i, n, nx AS mx, ny AS my, sx + ox * (dx - nx) AS sx, sy + oy * (dy - ny) AS sy, c + ox * (dy - ny) AS c
FROM (SELECT r.key, r.i, r.dx, r.dy, f.n + 1 AS n, f.sx, f.sy, f.c, r.dx - f.mx AS ox, r.dy - f.my AS oy, f.mx + (r.dx - f.mx) / (f.n + 1) AS nx, f.my + (r.dy - f.my) / (f.n + 1) AS ny FROM f JOIN r ON r.key = f.key AND r.i = f.i + 1) x) y)
SELECT key, round(n, 6) AS n, round(mx, 6) AS mean_dx, round(my, 6) AS mean_dy, round(sx / (n - 1), 6) AS var_dx, round(sy / (n - 1), 6) AS var_dy, round(c / (n - 1), 6) AS cov FROM f WHERE i = (SELECT count(*) FROM r WHERE r.key = f.key)"""
)
def decaying_touch_moments(s, d):
    """Moments of each word's touches, of which weight is halved whenever there are more than 200."""
    found = A.decaying_moments(_log(s, d).select(F.col("word").alias("key"), "seq", "dx", "dy"), limit=200)
    return found.select("key", *(F.round(c, 6).alias(c) for c in ("n", "mean_dx", "mean_dy", "var_dx", "var_dy", "cov")))


_SURFACES = f"raw AS (SELECT unnest(regexp_extract_all(replace(text, '’', ''''), '[\\p{{L}}'']+')) AS word, doc_id FROM documents), surf AS (SELECT word, count(*) AS count, min(doc_id) AS seq FROM raw GROUP BY word)"


@query(f"WITH {_SURFACES} SELECT lower(word) AS key, max_by(word, (count, -seq, word)) AS surface, sum(count)::BIGINT AS count FROM surf GROUP BY lower(word)")
def case_fold_index(s, d):
    """Surfaces of each word in all documents: the most frequent one, the earliest on a tie."""
    raw = table(s, d, "documents").select(F.explode(F.regexp_extract_all(F.replace("text", F.lit("’"), F.lit("'")), F.lit(L.WORD_PATTERN), F.lit(0))).alias("word"), "doc_id")
    surfaces = raw.groupBy("word").agg(F.count(F.lit(1)).alias("count"), F.min("doc_id").alias("seq"))
    best = F.struct("count", F.negative("seq"), "word")
    return surfaces.groupBy(F.lower("word").alias("key")).agg(F.max_by("word", best).alias("surface"), F.sum("count").alias("count"))


@query(f"WITH {LOG}, sess AS (SELECT word FROM com WHERE day = (SELECT max(day) FROM com)) SELECT word, sum(count)::BIGINT AS count FROM (SELECT word, count FROM words UNION ALL SELECT word, 1 FROM sess) GROUP BY word")
def session_overlay(s, d):
    commits = A.committed(_log(s, d), _gone(s))
    last = commits.join(F.broadcast(commits.agg(F.max("day").alias("day"))), "day")
    return A.overlay(_words(s, d), last)


@query(f"WITH {LOG}, fresh AS (SELECT DISTINCT 'w' || (event_id % 60) AS word FROM events WHERE ('w' || (event_id % 60)) NOT IN (SELECT word FROM gone)) SELECT word, greatest(coalesce(w.count, 0), CASE WHEN f.word IS NOT NULL THEN 3 ELSE 0 END)::BIGINT AS count, coalesce(w.explicit, false) OR f.word IS NOT NULL AS explicit FROM words w FULL JOIN fresh f USING (word)")
def import_merge(s, d):
    lines = table(s, d, "events").select(F.concat(F.lit("w"), (F.col("event_id") % 60).cast("string")).alias("value"))
    return X.merge_import(_words(s, d), X.importable(lines), _gone(s))


@query("SELECT word, 8 AS frequency FROM (SELECT lower(trim(word)) AS k, min_by(trim(word), line_no) AS word FROM (SELECT p_partkey AS line_no, CASE WHEN p_partkey % 5 = 0 THEN '# note' WHEN p_partkey % 2 = 0 THEN upper(p_name) || ' ' ELSE p_name END AS word FROM part) WHERE trim(word) <> '' AND NOT starts_with(trim(word), '#') GROUP BY 1)")
def curated_vocabulary(s, d):
    value = F.when(F.col("p_partkey") % 5 == 0, "# note").when(F.col("p_partkey") % 2 == 0, F.concat(F.upper("p_name"), F.lit(" "))).otherwise(F.col("p_name"))
    return X.curated(table(s, d, "part").select(value.alias("value"), F.col("p_partkey").alias("line_no")))


@query(f"WITH {LOG} SELECT seq, day, kind, word AS a FROM log WHERE kind IN ('wc', 'wt')")
def event_log_round_trip(s, d):
    """Events written as log lines and parsed again."""
    log = _log(s, d).filter("kind IN ('wc', 'wt')")
    lines = X.event_lines(log.select("day", "kind", F.concat("word", F.lit("\t\\"), F.col("seq").cast("string")).alias("a"), F.col("previous").alias("b"), F.col("hint").alias("c")))
    back = X.parse_events(lines).filter("ok")
    return back.select(F.substring_index("a", "\\", -1).cast("bigint").alias("seq"), "day", "kind", F.substring_index("a", "\t", 1).alias("a"))


# ---- morphology over a synthetic paradigm: every Spanish-lane word that ends in o or a, with four suffixed forms
FORMS = """lem AS (SELECT word AS lemma, CASE WHEN ends_with(word, 'o') THEN 0 ELSE 1 END AS gender FROM uni WHERE lane = 'es' AND length(word) >= 4 AND (ends_with(word, 'o') OR ends_with(word, 'a'))),
rule(suffix, bundle) AS (VALUES ('', 0), ('n', 1), ('num', 6), ('s', 3), ('r', 20)),
forms AS (SELECT lemma || suffix AS form, lemma, 0 AS pos, gender, bundle FROM lem, rule)"""


def _forms(s: SparkSession, d: str) -> DataFrame:
    lemmas = _uni(s, d).filter((F.col("lane") == "es") & (F.length("word") >= 4) & F.col("word").rlike("[oa]$"))
    rules = F.array(*[F.struct(F.lit(a).alias("suffix"), F.lit(b).alias("bundle")) for a, b in (("", 0), ("n", 1), ("num", 6), ("s", 3), ("r", 20))])
    rows = lemmas.select(F.col("word").alias("lemma"), F.when(F.col("word").endswith("o"), 0).otherwise(1).alias("gender"), F.explode(rules).alias("r"))
    return rows.select(F.concat("lemma", "r.suffix").alias("form"), "lemma", F.lit(0).alias("pos"), "gender", "r.bundle")


@query(f"WITH {TOK}, {FORMS}, q AS (SELECT DISTINCT word FROM uni WHERE lane = 'es') SELECT DISTINCT word, coalesce(lemma, word) AS lemma FROM q LEFT JOIN forms ON form = word")
def lemmatize(s, d):
    return P.lemmatize(_uni(s, d).filter("lane = 'es'").select("word").distinct(), _forms(s, d))


@query(f"WITH {TOK}, {FORMS} SELECT form, lemma, bundle & 3 AS case_code, (bundle >> 2) & 1 = 1 AS plural, (bundle >> 3) & 1 = 0 AND (bundle >> 4) & 1 = 1 AS definite, 'no:' || ['nf', 'þf', 'þgf', 'ef'][(bundle & 3) + 1] || ':' || CASE WHEN (bundle >> 2) & 1 = 1 THEN 'ft' ELSE 'et' END || ':' || CASE WHEN (bundle >> 4) & 1 = 1 THEN 'gr' ELSE 'ngr' END AS described, (bundle & 65532) | 3 AS genitive FROM forms")
def bundle_unpack(s, d):
    f = P.unpack(F.col("bundle"))
    return _forms(s, d).select("form", "lemma", f["case_code"].alias("case_code"), f["plural"].alias("plural"), f["definite"].alias("definite"), P.describe(F.col("bundle")).alias("described"), P.with_case(F.col("bundle"), 3).alias("genitive"))


@query(f"WITH {TOK}, {FORMS}, q AS (SELECT DISTINCT word FROM uni WHERE lane = 'es') SELECT DISTINCT q.word, b.form FROM q JOIN forms a ON a.form = q.word JOIN forms b ON b.lemma = a.lemma WHERE b.form <> q.word")
def sibling_forms(s, d):
    return P.siblings(_uni(s, d).filter("lane = 'es'").select("word").distinct(), _forms(s, d))


@query(f"WITH {TOK}, {FORMS}, one AS (SELECT form, min(lemma) AS lemma FROM forms GROUP BY form HAVING count(DISTINCT lemma) = 1), lea AS (SELECT DISTINCT word FROM uni WHERE lane = 'es' AND frequency >= 3) SELECT DISTINCT b.form AS word FROM lea JOIN one a ON a.form = lea.word JOIN one b ON b.lemma = a.lemma WHERE b.form NOT IN (SELECT word FROM lea)")
def lemma_lift(s, d):
    return P.lemma_lift(_uni(s, d).filter("lane = 'es' AND frequency >= 3").select("word").distinct(), _forms(s, d))


@query(
    f"""WITH {TOK}, {FORMS}, hd AS (SELECT DISTINCT lemma AS head FROM lem WHERE length(lemma) <= 7), md AS (SELECT DISTINCT form AS part FROM forms WHERE ((bundle & 3) = 3 OR ((bundle >> 2) & 1 = 0 AND ((gender = 0 AND (bundle & 3) = 1) OR (gender = 1 AND (bundle & 3) = 0)))) AND (bundle >> 4) & 1 = 0),
q AS (SELECT DISTINCT form AS word FROM forms WHERE length(form) BETWEEN 8 AND 32 UNION SELECT DISTINCT part || head FROM (SELECT part FROM md WHERE length(part) BETWEEN 4 AND 5) JOIN (SELECT head FROM hd WHERE length(head) BETWEEN 4 AND 5) ON substr(part, 1, 2) = substr(head, 1, 2)),
c AS (SELECT word, i, substr(word, 1, i) AS region, substr(word, i + 1) AS head FROM (SELECT word, unnest(range(4, length(word) - 3)) AS i FROM q)), ch AS (SELECT * FROM c WHERE head IN (SELECT head FROM hd)),
o AS (SELECT word, i, head, region AS modifiers, 1 AS parts, 0::BIGINT AS j FROM ch WHERE region IN (SELECT part FROM md)
 UNION ALL SELECT word, i, head, substr(region, 1, j) || '+' || substr(region, j + 1), 2, j FROM (SELECT *, unnest(range(4, i - 3)) AS j FROM ch WHERE i >= 8) WHERE substr(region, 1, j) IN (SELECT part FROM md) AND substr(region, j + 1) IN (SELECT part FROM md))
SELECT word, modifiers, head FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY i, parts, j) AS r FROM o) WHERE r = 1"""
)
def compound_split(s, d):
    forms = _forms(s, d)
    heads = forms.filter(F.length("lemma") <= 7).select(F.col("lemma").alias("word")).distinct()
    mods = forms.filter(P.is_modifier(forms)).select(F.col("form").alias("word")).distinct()
    made = mods.filter(F.length("word").between(4, 5)).withColumn("h", F.left("word", F.lit(2))).alias("a").join(heads.filter(F.length("word").between(4, 5)).withColumn("h", F.left("word", F.lit(2))).alias("b"), "h").select(F.concat("a.word", "b.word").alias("word"))
    asked = forms.select(F.col("form").alias("word")).filter(F.length("word").between(8, 32)).union(made).distinct()
    return C.compounds(asked, mods, heads).select("word", F.array_join("modifiers", "+").alias("modifiers"), "head")


# ---- text functions
_D = "\\s\\p{Z}.,:;!¡?¿()\\[\\]{}<>«»་།​\"„“”"
_JOIN = "regexp_replace(regexp_replace(regexp_replace(text, '([\\p{L}\\p{Nd}])\\.([\\p{L}\\p{Nd}])', '\\1\ue000\\2', 'g'), '([\\p{L}\\p{Nd}])\\.([\\p{L}\\p{Nd}])', '\\1\ue000\\2', 'g'), '([\\p{L}\\p{Nd}])\\.$', '\\1\ue000')"
_TOKENS = f"toks AS (SELECT doc_id, list_transform(regexp_extract_all({_JOIN}, '[^{_D}]+'), lambda t: replace(t, '\ue000', '.')) AS ws FROM documents)"


@query(f"WITH {_TOKENS} SELECT doc_id, len(ws) AS n, list_sum(list_transform(ws, lambda t: length(t)))::BIGINT AS chars, ws[1] AS first, ws[-1] AS last FROM toks")
def word_tokens(s, d):
    rows = table(s, d, "documents").select("doc_id", T.word_tokens(F.col("text")).alias("ws"))
    chars = F.aggregate(F.transform("ws", lambda w: F.length(w).cast("bigint")), F.lit(0).cast("bigint"), lambda a, n: a + n)
    return rows.select("doc_id", F.size("ws").cast("bigint").alias("n"), F.when(F.size("ws") > 0, chars).alias("chars"), F.get("ws", 0).alias("first"), F.get("ws", F.size("ws") - 1).alias("last"))


@query(f"WITH {_TOKENS}, t AS (SELECT DISTINCT unnest(ws) AS token FROM toks) SELECT token, regexp_extract(token, '([\\p{{L}}\\p{{Nd}}]*)$', 1) AS segment FROM t WHERE regexp_matches(token, '^[^\\p{{L}}\\p{{Nd}}]') OR regexp_matches(token, '[\\p{{L}}\\p{{Nd}}][.@][\\p{{L}}\\p{{Nd}}]')")
def verbatim_tokens(s, d):
    tokens = table(s, d, "documents").select(F.explode(T.word_tokens(F.col("text"))).alias("token")).distinct()
    return tokens.filter(T.is_verbatim(F.col("token"))).select("token", T.trailing_segment(F.col("token")).alias("segment"))


@query(f"WITH {TOK} SELECT DISTINCT word, length(word) >= 6 AND (ends_with(word, 'sson') OR ends_with(word, 'dóttir')) AS patronymic FROM uni")
def patronymic(s, d):
    return _uni(s, d).select("word", T.is_patronymic(F.col("word")).alias("patronymic")).distinct()


@query(f"WITH {_TOKENS}, t AS (SELECT DISTINCT unnest(ws) AS token FROM toks) SELECT token, regexp_matches(token, '\\p{{L}}') AND length(token) BETWEEN 1 AND 64 AS learnable FROM t")
def learnable_filter(s, d):
    tokens = table(s, d, "documents").select(F.explode(T.word_tokens(F.col("text"))).alias("token")).distinct()
    return tokens.select("token", X.learnable(F.col("token")).alias("learnable"))


@query("SELECT doc_id, regexp_matches(rtrim(text), '[.!?]$') AS ends_sentence, right(text, 1) IN ('„', '\"', '“') AS in_quotes FROM documents")
def sentence_boundary(s, d):
    return table(s, d, "documents").select("doc_id", T.ends_sentence(F.col("text")).alias("ends_sentence"), T.in_quotes(F.col("text")).alias("in_quotes"))


def _pattern(p: str) -> str:
    return p.replace("'", "''")


@query(f"SELECT doc_id, unnest(regexp_extract_all(text, '{_pattern(T.EMAIL)}')) AS email FROM documents")
def extract_emails(s, d):
    return table(s, d, "documents").select("doc_id", F.explode(T.extract(F.col("text"), T.EMAIL_SCAN)).alias("email"))


@query(f"SELECT page_id, unnest(regexp_extract_all(url, '{_pattern(T.URL)}')) AS found FROM pages")
def extract_urls(s, d):
    return table(s, d, "pages").select("page_id", F.explode(T.extract(F.col("url"), T.URL)).alias("found"))


@query()
def extract_phones(s, d):
    """Phone-like digit groups; the borders need look-around, which DuckDB's patterns do not have."""
    bounded = f"(?<![0-9+-])(?<![0-9][ .-]){T.PHONE}(?![ .-]?[0-9]|-)"
    return table(s, d, "documents").select("doc_id", F.explode(T.extract(F.col("text"), bounded)).alias("phone"))


_MIME = "m AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'image/' || event_type WHEN 1 THEN 'text/plain' WHEN 2 THEN 'video' WHEN 3 THEN NULL ELSE 'text/' || event_type END AS mime FROM events)"


@query(f"WITH {_MIME}, x AS (SELECT event_id, coalesce(regexp_full_match(mime, 'image/[^\\s]+|text/v[^\\s]+') AND regexp_full_match(mime, '[^/]+/[^/]+'), false) AS a, mime IS NOT DISTINCT FROM 'text/plain' AS b FROM m) SELECT event_id, a AS matches, a OR b AS any_of, a AND NOT b OR b AND NOT a AS one_of FROM x")
def mime_filter(s, d):
    e, k = table(s, d, "events"), F.col("event_id") % 5
    mime = F.when(k == 0, F.concat(F.lit("image/"), "event_type")).when(k == 1, "text/plain").when(k == 2, "video").when(k == 4, F.concat(F.lit("text/"), "event_type"))
    rows = e.select("event_id", mime.alias("mime"))
    wide = ["image/*", "text/v*", "text/plain"]
    both = F.array(F.col("mime"), F.lit("x/y"))
    return rows.select("event_id", T.mime_matches(F.col("mime"), wide[:2]).alias("matches"), T.mime_any(both, wide).alias("any_of"), T.mime_one(both, wide).alias("one_of"))


@query(f"WITH {TOK} SELECT DISTINCT word, CASE WHEN ends_with(word, 'tion') THEN substr(word, 1, length(word) - 4) || 'ción' WHEN ends_with(word, 'on') THEN substr(word, 1, length(word) - 2) || 'ón' WHEN ends_with(word, 'n') THEN substr(word, 1, length(word) - 1) || 'ñ' ELSE word END AS rewritten FROM uni")
def rule_rewrite(s, d):
    return _uni(s, d).select("word", T.rewrite(F.col("word"), {"tion": "ción", "on": "ón", "n": "ñ"}).alias("rewritten")).distinct()


@query("SELECT p_partkey, round(0.7 * CASE WHEN contains(lower(p_name), 'ring') THEN 4.0 / length(p_name) ELSE 0 END + 0.3 * CASE WHEN contains(lower(p_type), 'ring') THEN 4.0 / length(p_type) WHEN contains(lower(p_brand), 'ring') THEN 4.0 / length(p_brand) ELSE 0 END, 6)::DOUBLE AS score FROM part WHERE contains(lower(p_name), 'ring')")
def emoji_search(s, d):
    rows = table(s, d, "part").withColumn("score", T.weighted_contains(F.col("p_name"), F.array("p_type", "p_brand"), "ring"))
    return rows.filter("score > 0").select("p_partkey", F.round("score", 6).alias("score"))


# ---- gestures: every benchmark word of 3 to 10 letters drawn through its keys, shifted a little
def _gestures(s: SparkSession, d: str) -> DataFrame:
    words = _requests(s, d).filter(F.length("word").between(3, 10)).withColumn("path", G.ideal_path(F.col("word"))).filter(F.col("path").isNotNull() & (F.size("path") > 1))
    drawn = F.transform("path", lambda p, i: F.struct((p["x"] + (i % 3) * 0.1).alias("x"), (p["y"] + (i % 2) * 0.1).alias("y")))
    return words.select(F.col("word").alias("gesture_id"), drawn.alias("points"))


@query()
def glide_prune(s, d):
    return G.pruned(_gestures(s, d), _known(s, d)).select("gesture_id", "word", F.round("drawn", 6).alias("drawn"), F.round("ideal", 6).alias("ideal"))


@query()
def glide_rank(s, d):
    return G.classified(_gestures(s, d), _known(s, d))
