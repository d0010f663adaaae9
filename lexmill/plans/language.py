"""Queries over lexicons and the language model: documents are the corpus, the benchmark's words the requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.config import DEFAULT, FIRST_LETTERS, SECOND_LETTERS
from lexmill.operators import lexicon as L
from lexmill.operators import model as M
from lexmill.plans.registry import query, table
from lexmill.sources.lexicon_tables import Lexicon, lexicon_of

LANES = (DEFAULT.primary, DEFAULT.secondary)

# ---- the same in DuckDB, as common table expressions
W = "regexp_extract_all(replace(lower(text), '’', ''''), '[\\p{L}'']+')"
TOK = f"""docs AS (SELECT doc_id, lang AS lane, {W} AS ws FROM documents WHERE lang IN ('es', 'en')),
tok AS (SELECT doc_id, lane, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM docs),
uni AS (SELECT lane, word, count(*) AS frequency FROM tok GROUP BY ALL),
tot AS (SELECT lane, sum(frequency)::BIGINT AS total FROM uni GROUP BY lane)"""
BI = """bi AS (SELECT lane, p.a AS w1, p.b AS w2, count(*) AS frequency FROM (SELECT lane, unnest(list_transform(range(1, len(ws)), lambda i: {'a': ws[i], 'b': ws[i + 1]})) AS p FROM docs WHERE len(ws) > 1) GROUP BY ALL)"""
REQ = f"""reqtok AS (SELECT item_id, {W} AS ws FROM benchmark),
req AS (SELECT DISTINCT unnest(ws) AS word FROM reqtok),
reqpair AS (SELECT DISTINCT p.a AS previous, p.b AS word FROM (SELECT unnest(list_transform(range(1, len(ws)), lambda i: {{'a': ws[i], 'b': ws[i + 1]}})) AS p FROM reqtok WHERE len(ws) > 1))"""
CAL = f"""calrank AS (SELECT lane, ln(frequency + 0.5) AS x, row_number() OVER (PARTITION BY lane, substr(word, 1, 2) ORDER BY frequency DESC, word) AS r FROM uni WHERE contains('{FIRST_LETTERS}', substr(word, 1, 1)) AND length(word) > 1 AND contains('{SECOND_LETTERS}', substr(word, 2, 1))),
cal AS (SELECT lane, CASE WHEN count(*) < 4 THEN 0.0 ELSE avg(x) END AS mu, CASE WHEN count(*) < 4 THEN 1.0 ELSE greatest(stddev_pop(x), 0.25) END AS sigma, count(*) AS samples FROM calrank WHERE r <= 12 GROUP BY lane)"""


def _lane(name: str, lane: str) -> str:
    return f"(SELECT word, frequency FROM uni WHERE lane = '{lane}') f{name} USING (word), (SELECT mu, sigma, total FROM cal JOIN tot USING (lane) WHERE lane = '{lane}') c{name}"


def _z(p: str, c: str) -> str:
    return f"((ln({p}) - ({c}.mu - ln({c}.total + 50000.0))) / {c}.sigma)"


def scored_sql(source: str, keys: str) -> str:
    """keys, word, f1, f2, z1, z2 of the words of ``source``."""
    p = lambda f, c: f"((coalesce({f}.frequency, 0) + 0.5) / ({c}.total + 50000.0))"
    return f"""SELECT {keys}, q.word, fa.frequency AS f1, fb.frequency AS f2, {p("fa", "ca")} AS p1, {p("fb", "cb")} AS p2, {_z(p("fa", "ca"), "ca")} AS z1, {_z(p("fb", "cb"), "cb")} AS z2,
 ca.total AS n1, ca.mu AS mu1, ca.sigma AS s1, cb.total AS n2, cb.mu AS mu2, cb.sigma AS s2
FROM {source} q LEFT JOIN (SELECT word, frequency FROM uni WHERE lane = 'es') fa ON fa.word = q.word LEFT JOIN (SELECT word, frequency FROM uni WHERE lane = 'en') fb ON fb.word = q.word,
(SELECT mu, sigma, total FROM cal JOIN tot USING (lane) WHERE lane = 'es') ca, (SELECT mu, sigma, total FROM cal JOIN tot USING (lane) WHERE lane = 'en') cb"""


def blend_sql(a: str, b: str, p: str = "0.5") -> str:
    x, y = f"(ln({p}) + {a})", f"(ln(1 - {p}) + {b})"
    return f"(greatest({x}, {y}) + ln(exp({x} - greatest({x}, {y})) + exp({y} - greatest({x}, {y}))))"


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def _stored(s: SparkSession, d: str) -> Lexicon:
    """The lexicon of the documents, counted once in a session; all lookups read its tables."""
    return lexicon_of(_docs(s, d), f"{d}/documents.parquet", LANES)


def _uni(s: SparkSession, d: str) -> DataFrame:
    return _stored(s, d).unigrams


def _bi(s: SparkSession, d: str) -> DataFrame:
    return _stored(s, d).bigrams


def _requests(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "benchmark").select(F.explode(L.word_array(F.col("text"))).alias("word")).distinct()


def _request_pairs(s: SparkSession, d: str) -> DataFrame:
    w = table(s, d, "benchmark").select(L.word_array(F.col("text")).alias("w")).filter(F.size("w") > 1)
    pairs = w.select(F.explode(F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("a"), F.slice("w", 2, F.size("w") - 1).alias("b"))).alias("p"))
    return pairs.select(F.col("p.a").alias("previous"), F.col("p.b").alias("word")).distinct()


def _scored(s: SparkSession, d: str, words: DataFrame) -> DataFrame:
    return M.with_scores(words, _uni(s, d), _stored(s, d).scale)


def _r(column: str, name: str | None = None, digits: int = 6):
    return F.round(F.col(column), digits).alias(name or column)


@query(f"WITH {TOK} SELECT lane, word, frequency FROM uni")
def unigram_build(s, d):
    return L.unigrams(L.tokens(_docs(s, d), LANES))


@query(f"WITH {TOK}, {BI} SELECT lane, w1, w2, frequency FROM bi")
def bigram_build(s, d):
    return L.bigrams(_docs(s, d), LANES)


@query(f"WITH {TOK}, {BI} SELECT lane, word AS w1, '' AS w2, frequency FROM uni UNION ALL SELECT lane, w1, w2, frequency FROM bi")
def lexicon_scan(s, d):
    """Both tables of the stored lexicon, read back."""
    singles = _uni(s, d).select("lane", F.col("word").alias("w1"), F.lit("").alias("w2"), "frequency")
    return singles.unionByName(_bi(s, d).select("lane", "w1", "w2", "frequency"))


@query(f"WITH {TOK}, {CAL} SELECT lane, round(mu, 6) AS mu, round(sigma, 6) AS sigma, samples, total FROM cal JOIN tot USING (lane)")
def lexicon_scale(s, d):
    return _stored(s, d).scale.select("lane", _r("mu"), _r("sigma"), "samples", "total")


@query(f"WITH {TOK}, {REQ} SELECT word, lane, frequency FROM req LEFT JOIN uni USING (word)")
def unigram_lookup(s, d):
    return L.lookup(_requests(s, d), _uni(s, d)).select("word", "lane", "frequency")


@query(f"WITH {TOK}, {BI}, {REQ} SELECT previous AS w1, word AS w2, lane, frequency FROM reqpair LEFT JOIN bi ON w1 = previous AND w2 = word")
def bigram_lookup(s, d):
    return L.lookup_pairs(_request_pairs(s, d).toDF("w1", "w2"), _bi(s, d)).select("w1", "w2", "lane", "frequency")


@query(
    f"""WITH {TOK}, {REQ}, pre AS (SELECT DISTINCT substr(word, 1, 3) AS prefix FROM req WHERE length(word) >= 3),
m AS (SELECT prefix, lane, word, frequency, row_number() OVER (PARTITION BY prefix, lane ORDER BY word) AS scan FROM pre JOIN uni ON substr(word, 1, 3) = prefix)
SELECT prefix, lane, word, frequency, rank FROM (SELECT *, row_number() OVER (PARTITION BY prefix, lane ORDER BY frequency DESC, word) AS rank FROM m WHERE scan <= 20000) WHERE rank <= 8"""
)
def prefix_completion_topk(s, d):
    prefixes = _requests(s, d).filter(F.length("word") >= 3).select(F.substring("word", 1, 3).alias("prefix")).distinct()
    return L.completions(prefixes, _uni(s, d), DEFAULT.completion_limit).select("prefix", "lane", "word", "frequency", "rank")


@query(
    f"""WITH {TOK}, {BI}, {REQ}, m AS (SELECT w1, lane, w2 AS word, frequency, row_number() OVER (PARTITION BY w1, lane ORDER BY w2) AS scan FROM (SELECT DISTINCT word AS w1 FROM req) JOIN bi USING (w1))
SELECT w1, lane, word, frequency, rank FROM (SELECT *, row_number() OVER (PARTITION BY w1, lane ORDER BY frequency DESC, word) AS rank FROM m WHERE scan <= 20000) WHERE rank <= 24"""
)
def continuation_topk(s, d):
    return L.continuations(_requests(s, d).toDF("w1"), _bi(s, d), DEFAULT.continuation_limit).select("w1", "lane", "word", "frequency", "rank")


@query(f"WITH {TOK} SELECT lane, substr(word, 1, 2) AS prefix, substr(word, 3, 1) AS child, count(*) AS words, sum(frequency)::BIGINT AS tokens FROM uni WHERE length(word) >= 2 GROUP BY ALL")
def trie_children(s, d):
    return L.children(_uni(s, d), 2)


@query(f"WITH {TOK} SELECT lane, total FROM tot")
def lexicon_total(s, d):
    return L.totals(_uni(s, d))


@query(f"WITH {TOK} SELECT lane, word, frequency, rank FROM (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY frequency DESC, word) AS rank FROM uni) WHERE rank <= 50")
def dictionary_empty_prefix(s, d):
    """The dictionary-backed lexicon: an empty prefix matches every word."""
    return L.top(_uni(s, d), ["lane"], DEFAULT.unigram_limit).select("lane", "word", "frequency", "rank")


@query(f"WITH {TOK}, {CAL} SELECT lane, round(mu, 6) AS mu, round(sigma, 6) AS sigma, samples FROM cal")
def lexicon_calibration(s, d):
    return L.calibration(_uni(s, d)).select("lane", _r("mu"), _r("sigma"), "samples")


@query(f"WITH {TOK} SELECT lane, word, round(frequency / total, 9) AS relative FROM uni JOIN tot USING (lane)")
def relative_frequency(s, d):
    return _uni(s, d).join(F.broadcast(_stored(s, d).scale), "lane").select("lane", "word", F.round(F.col("frequency") / F.col("total"), 9).alias("relative"))


@query(
    f"""WITH {TOK}, b AS (SELECT word, substr(word, 1, length(word) - 2) AS base FROM uni WHERE lane = 'en' AND length(word) >= 4 AND ends_with(word, '''s'))
SELECT b.word, base, greatest(1, round(0.1 * u.frequency))::BIGINT AS derived FROM b JOIN uni u ON u.word = b.base AND u.lane = 'en' WHERE length(base) >= 2 AND NOT ends_with(base, 's')"""
)
def possessive_base(s, d):
    """Words in 's whose base is a known word that does not end in s, with the frequency they get from it."""
    uni = _uni(s, d).filter(F.col("lane") == DEFAULT.secondary).select("word", "frequency")
    word = uni.select("word").filter((F.length("word") >= 4) & F.col("word").endswith("'s")).withColumn("base", F.expr("substr(word, 1, length(word) - 2)"))
    word = word.filter((F.length("base") >= 2) & ~F.col("base").endswith("s"))
    found = word.join(uni.toDF("base", "frequency"), "base")
    return found.select("word", "base", F.greatest(F.lit(1), F.round(0.1 * F.col("frequency"))).cast("bigint").alias("derived"))


@query(
    f"""WITH {TOK}, {REQ}, own AS (SELECT q.word, e.frequency AS f FROM req q LEFT JOIN uni e ON e.word = q.word AND e.lane = 'en'),
b AS (SELECT word, f, CASE WHEN length(word) >= 4 AND ends_with(word, '''s') AND NOT ends_with(substr(word, 1, length(word) - 2), 's') THEN substr(word, 1, length(word) - 2) END AS base FROM own)
SELECT b.word, coalesce(greatest(b.f, CASE WHEN u.frequency IS NOT NULL THEN greatest(1, round(0.1 * u.frequency)) END), 0)::BIGINT AS effective FROM b LEFT JOIN uni u ON u.word = b.base AND u.lane = 'en'"""
)
def effective_frequency(s, d):
    uni = _uni(s, d).filter(F.col("lane") == DEFAULT.secondary).select("word", "frequency")
    stem = F.expr("substr(word, 1, length(word) - 2)")
    base = F.when((F.length("word") >= 4) & F.col("word").endswith("'s") & ~stem.endswith("s"), stem)
    rows = _requests(s, d).join(uni, "word", "left").withColumn("base", base).join(uni.toDF("base", "fb"), "base", "left")
    return rows.select("word", F.coalesce(F.greatest("frequency", F.when(F.col("fb").isNotNull(), F.greatest(F.lit(1), F.round(0.1 * F.col("fb"))))), F.lit(0)).cast("bigint").alias("effective"))


@query(f"WITH {TOK}, {CAL}, {REQ}, x AS ({scored_sql('req', '1 AS one')}) SELECT word, round(z1, 6) AS z_primary, round(z2, 6) AS z_secondary FROM x")
def calibrated_z(s, d):
    return _scored(s, d, _requests(s, d)).select("word", _r("z_primary"), _r("z_secondary"))


@query(f"WITH {TOK}, {CAL}, {REQ}, x AS ({scored_sql('req', '1 AS one')}) SELECT word, round({blend_sql('z1', 'z2', '0.3')}, 6) AS score FROM x")
def blended_score(s, d):
    return _scored(s, d, _requests(s, d)).select("word", F.round(M.blend(F.col("z_primary"), F.col("z_secondary"), F.lit(0.3)), 6).alias("score"))


_EVIDENCE = """greatest(least(CASE WHEN abs(m) <= 1.0 THEN 0.0 ELSE sign(m) * (abs(m) - 1.0) END, 1.1), -1.1)"""
_MARGIN = "(CASE WHEN f1 IS NOT NULL THEN z1 ELSE greatest(z1, -1.25) END - CASE WHEN f2 IS NOT NULL THEN z2 ELSE greatest(z2, -1.25) END)"


def _evidence(rows: DataFrame) -> DataFrame:
    e = M.lane_evidence(F.col("z_primary"), F.col("z_secondary"), F.col("f_primary").isNotNull(), F.col("f_secondary").isNotNull())
    return rows.withColumn("evidence", e)


@query(f"WITH {TOK}, {CAL}, {REQ}, x AS ({scored_sql('req', '1 AS one')}), y AS (SELECT word, {_MARGIN} AS m FROM x) SELECT word, round({_EVIDENCE}, 6) AS evidence FROM y")
def lane_evidence(s, d):
    return _evidence(_scored(s, d, _requests(s, d))).select("word", _r("evidence"))


@query(
    f"""WITH {TOK}, {CAL}, talk AS (SELECT conv_id, turn, {W} AS ws FROM conversations), said AS (SELECT conv_id, turn, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM talk), cw AS (SELECT DISTINCT word FROM said),
x AS ({scored_sql('cw', '1 AS one')}), y AS (SELECT word, {_MARGIN} AS m FROM x), ev AS (SELECT word, {_EVIDENCE} AS evidence FROM y),
steps AS (SELECT conv_id, turn, pos, evidence FROM said JOIN ev USING (word) UNION ALL SELECT DISTINCT conv_id, turn, 1000000, NULL FROM talk),
seq AS (SELECT conv_id, list(evidence ORDER BY turn, pos) AS es FROM steps GROUP BY conv_id)
SELECT conv_id, round(list_reduce(list_prepend(0.5::DOUBLE, list_transform(es, lambda e: coalesce(e, 1e9)::DOUBLE)), lambda p, e: CASE WHEN e > 1e8 THEN 0.5 + (p - 0.5) * 0.8 ELSE least(greatest(((0.92 * p + 0.08 * (1 - p)) / (1 - (0.92 * p + 0.08 * (1 - p))) * exp(e)) / (1 + (0.92 * p + 0.08 * (1 - p)) / (1 - (0.92 * p + 0.08 * (1 - p))) * exp(e)), 0.1), 0.9) END), 6) AS p_primary FROM seq"""
)
def lane_posterior(s, d):
    """The lane filter over each conversation: its words in order, a sentence boundary after each turn."""
    talk = table(s, d, "conversations").select("conv_id", "turn", L.word_array(F.col("text")).alias("ws"))
    said = talk.select("conv_id", "turn", F.posexplode("ws").alias("pos", "word"))
    evidence = _evidence(_scored(s, d, said.select("word").distinct())).select("word", "evidence")
    steps = said.join(evidence, "word").select("conv_id", F.struct("turn", "pos").alias("at"), "evidence")
    ends = talk.select("conv_id", "turn").distinct().select("conv_id", F.struct("turn", F.lit(1_000_000).alias("pos")).alias("at"), F.lit(None).cast("double").alias("evidence"))
    return M.lane_posterior(steps.union(ends), ["conv_id"], "at").select("conv_id", _r("p_primary"))


_PAIRED = f"""x AS ({scored_sql('reqpair', 'q.previous')}),
y AS (SELECT x.*, u1.frequency AS c1, u2.frequency AS c2, b1.frequency AS b1, b2.frequency AS b2 FROM x LEFT JOIN uni u1 ON u1.word = previous AND u1.lane = 'es' LEFT JOIN uni u2 ON u2.word = previous AND u2.lane = 'en'
 LEFT JOIN bi b1 ON b1.w1 = previous AND b1.w2 = x.word AND b1.lane = 'es' LEFT JOIN bi b2 ON b2.w1 = previous AND b2.w2 = x.word AND b2.lane = 'en'),
zz AS (SELECT *, (ln(CASE WHEN c1 > 0 THEN 0.6 * coalesce(b1, 0) / c1 + 0.4 * p1 ELSE p1 END) - (mu1 - ln(n1 + 50000.0))) / s1 AS zp1, (ln(CASE WHEN c2 > 0 THEN 0.6 * coalesce(b2, 0) / c2 + 0.4 * p2 ELSE p2 END) - (mu2 - ln(n2 + 50000.0))) / s2 AS zp2 FROM y)"""


def _paired(s: SparkSession, d: str) -> DataFrame:
    uni = _uni(s, d)
    return M.with_pair_scores(_scored(s, d, _request_pairs(s, d)), uni, _bi(s, d))


@query(f"WITH {TOK}, {BI}, {CAL}, {REQ}, {_PAIRED} SELECT previous, word, round({blend_sql('zp1', 'zp2')}, 6) AS score FROM zz")
def interpolated_bigram_score(s, d):
    return _paired(s, d).select("previous", "word", F.round(M.blend(F.col("zp_primary"), F.col("zp_secondary"), F.lit(0.5)), 6).alias("score"))


@query(f"WITH {TOK}, {BI}, {CAL}, {REQ}, {_PAIRED} SELECT previous, word, round(CASE WHEN b1 IS NOT NULL THEN zp1 - z1 END, 6) AS lift_primary, round(CASE WHEN b2 IS NOT NULL THEN zp2 - z2 END, 6) AS lift_secondary FROM zz")
def contextual_lift(s, d):
    """How much a previous word raises a word's z; null where the pair is not attested."""
    lift = lambda n: F.round(F.when(F.col(f"pair_{n}").isNotNull(), F.col(f"zp_{n}") - F.col(f"z_{n}")), 6).alias(f"lift_{n}")
    return _paired(s, d).select("previous", "word", lift("primary"), lift("secondary"))


@query(
    f"""WITH {TOK}, {BI}, {CAL}, {REQ}, cont AS (SELECT w1 AS previous, lane, w2 AS word, row_number() OVER (PARTITION BY w1, lane ORDER BY frequency DESC, w2) AS r FROM bi WHERE w1 IN (SELECT word FROM req)),
pool AS (SELECT DISTINCT previous, word FROM cont WHERE r <= 24), reqpair2 AS (SELECT previous, word FROM pool),
{_PAIRED.replace('reqpair', 'reqpair2')},
r AS (SELECT previous, word, {blend_sql('zp1', 'zp2')} AS score FROM zz), k AS (SELECT *, row_number() OVER (PARTITION BY previous ORDER BY round(score, 9) DESC, word) AS rank FROM r),
e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY previous)) AS e FROM k WHERE rank <= 8)
SELECT previous, word, rank, round(score, 6) AS score, round(e / sum(e) OVER (PARTITION BY previous), 6) AS confidence FROM e QUALIFY rank <= 5"""
)
def next_word_topk(s, d):
    """Next-word prediction: continuations of both lanes, scored by the blended model, five for each word."""
    uni, bi = _uni(s, d), _bi(s, d)
    pool = L.continuations(_requests(s, d).toDF("w1"), bi, DEFAULT.continuation_limit, scan_limit=False).select(F.col("w1").alias("previous"), "word").distinct()
    rows = M.with_pair_scores(_scored(s, d, pool), uni, bi)
    rows = rows.withColumn("score", M.blend(F.col("zp_primary"), F.col("zp_secondary"), F.lit(0.5))).withColumn("by", F.round("score", 9))
    ranked = M.ranked(rows.select("previous", "word", "score", "by"), ["previous"], 5, "by")
    return ranked.select("previous", "word", "rank", _r("score"), _r("confidence"))


_COMPLETED = f"""pre AS (SELECT DISTINCT substr(word, 1, 4) AS prefix FROM req WHERE length(word) >= 4), c AS (SELECT prefix, lane, word, row_number() OVER (PARTITION BY prefix, lane ORDER BY frequency DESC, word) AS r FROM pre JOIN uni ON substr(word, 1, 4) = prefix),
cand AS (SELECT DISTINCT prefix, word FROM c WHERE r <= 50), x AS ({scored_sql('cand', 'q.prefix')}), sc AS (SELECT prefix, word, {blend_sql('z1', 'z2')} AS score FROM x), k AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY round(score, 9) DESC, word) AS rank FROM sc)"""


def _completed(s: SparkSession, d: str) -> DataFrame:
    uni = _uni(s, d)
    prefixes = _requests(s, d).filter(F.length("word") >= 4).select(F.substring("word", 1, 4).alias("prefix")).distinct()
    pool = L.completions(prefixes, uni, DEFAULT.unigram_limit, length=4, scan_limit=False).select("prefix", "word").distinct()
    rows = _scored(s, d, pool)
    return rows.withColumn("score", M.blend(F.col("z_primary"), F.col("z_secondary"), F.lit(0.5))).withColumn("by", F.round("score", 9))


@query(f"WITH {TOK}, {CAL}, {REQ}, {_COMPLETED} SELECT prefix, word, rank, round(score, 6) AS score FROM k WHERE rank <= 5")
def completions_ranked(s, d):
    return M.ranked(_completed(s, d), ["prefix"], 5, "by").select("prefix", "word", "rank", _r("score"))


@query(f"WITH {TOK}, {CAL}, {REQ}, {_COMPLETED}, e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY prefix)) AS e FROM k WHERE rank <= 8) SELECT prefix, word, round(e / sum(e) OVER (PARTITION BY prefix), 6) AS confidence FROM e QUALIFY rank <= 3")
def softmax_confidence(s, d):
    return M.ranked(_completed(s, d), ["prefix"], 3, "by").select("prefix", "word", _r("confidence"))


@query(f"WITH {TOK}, {CAL}, {REQ}, {_COMPLETED} SELECT a.prefix, a.word, round(round(a.score, 9) - round(b.score, 9), 6) AS margin FROM k a LEFT JOIN k b ON a.prefix = b.prefix AND b.rank = 2 WHERE a.rank = 1")
def margin_runner_up(s, d):
    return M.margins(_completed(s, d), ["prefix"], "by").select("prefix", "word", _r("margin"))


@query(
    f"""WITH {TOK}, es AS (SELECT word, frequency, translate(word, 'áéíóúý', 'aeiouy') AS fold FROM uni WHERE lane = 'es'), acute AS (SELECT fold, word AS twin, frequency AS f FROM es WHERE word <> fold),
m AS (SELECT b.word, twin, f, row_number() OVER (PARTITION BY b.word ORDER BY f DESC, twin) AS r FROM (SELECT DISTINCT word, frequency FROM uni WHERE lane = 'es' AND word = translate(word, 'áéíóúý', 'aeiouy')) b JOIN acute ON fold = b.word WHERE f >= 10 * b.frequency)
SELECT word, twin, f AS frequency FROM m WHERE r = 1"""
)
def acute_fold_twin(s, d):
    """For each bare form, its most frequent accented twin that is ten times as frequent."""
    es = _uni(s, d).filter(F.col("lane") == DEFAULT.primary).withColumn("fold", F.translate("word", "áéíóúý", "aeiouy"))
    bare = es.filter(F.col("word") == F.col("fold")).select("word", F.col("frequency").alias("own"))
    twins = es.filter(F.col("word") != F.col("fold")).select(F.col("fold").alias("word"), F.col("word").alias("twin"), "frequency")
    best = F.row_number().over(Window.partitionBy("word").orderBy(F.col("frequency").desc(), "twin"))
    return bare.join(twins, "word").filter(F.col("frequency") >= DEFAULT.twin_dominance * F.col("own")).withColumn("r", best).filter("r = 1").select("word", "twin", "frequency")
