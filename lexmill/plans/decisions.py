"""Queries over decisions on candidates, morphology predicates, item histories, files and small text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.config import ACUTE, DEFAULT, key_centers
from lexmill.functions import text as T
from lexmill.operators import candidates as C
from lexmill.operators import decision as D
from lexmill.operators import lexicon as L
from lexmill.operators import model as M
from lexmill.operators import morphology as P
from lexmill.operators import stores as S
from lexmill.plans.correction import _EDITS, _RESTORE, _SUBST, FORMS, KNOWN, LOG, TYPED, _forms, _gone, _known, _log, _typed, _words
from lexmill.plans.language import BI, CAL, REQ, TOK, _bi, _request_pairs, _requests, _scored, _stored, _uni, blend_sql, lane_posterior, scored_sql
from lexmill.plans.more import autocorrect_gates
from lexmill.plans.registry import ORACLE_SQL, query, table
from lexmill.plans.stores import us

# ---- channel
_POSTERIOR = ORACLE_SQL["lane_posterior"]
_SMOOTH = lambda p: f"(pow(least(greatest(({p} - 0.5) / 0.25, 0), 1), 2) * (3 - 2 * least(greatest(({p} - 0.5) / 0.25, 0), 1)))"


@query(
    f"""WITH p AS ({_POSTERIOR}), w AS (SELECT conv_id, {_SMOOTH('p_primary')} AS a, {_SMOOTH('(1 - p_primary)')} AS b FROM p)
SELECT conv_id, round(a, 5) AS weight_primary, round(b, 5) AS weight_secondary, round(greatest(0.02, 0.35 * (1 - a)), 5) AS acute, round(1 - 0.5 * a, 5) AS confusion, round(1 - 0.35 * a, 5) AS gemination, round(greatest(0.02, least(4.0, 4 * (1 - b))), 5) AS apostrophe FROM w"""
)
def fold_pricing(s, d):
    """What leaving out accents and apostrophes costs at the end of each conversation."""
    prices = C.fold_prices(F.col("p_primary"))
    return lane_posterior(s, d).select("conv_id", *(F.round(c, 5).alias(name) for name, c in prices.items()))


@query(f"WITH {TOK}, {REQ}, {TYPED}, {KNOWN} SELECT typed, word, 0.5::DOUBLE * (length(word) - length(typed)) AS cost FROM typed JOIN known ON substr(word, 1, 3) = substr(typed, 1, 3) AND starts_with(word, typed) AND word <> typed")
def completion_costs(s, d):
    """Known words that go on where a request ends: the cheaper of typing cost and half a point a letter."""
    pairs = _typed(s, d).withColumn("h", F.left("typed", F.lit(3))).join(_known(s, d).withColumn("h", F.left("word", F.lit(3))), "h").filter(F.col("word").startswith(F.col("typed")) & (F.col("word") != F.col("typed")))
    extra = DEFAULT.completion_char_cost * (F.length("word") - F.length("typed"))
    return pairs.select("typed", "word", F.least(C.typing_cost("typed", "word"), extra).alias("cost"))


_PAIRS = "SELECT a || b AS p FROM rest UNION SELECT b || a FROM rest WHERE b IN ('á', 'é', 'í', 'ó', 'ú', 'ý') UNION SELECT unnest(['dð', 'ðd', 'oö', 'öo', 'ðþ', 'þð', 'tþ', 'þt', 'vð'])"


@query(
    f"""WITH {TOK}, {REQ}, {TYPED}, {KNOWN}, {_SUBST}, {_EDITS}, {_RESTORE}, pairs AS ({_PAIRS}), c AS (SELECT DISTINCT typed, word FROM edits SEMI JOIN known USING (word)),
same AS (SELECT typed, word, unnest(range(1, length(typed) + 1)) AS i FROM c WHERE length(typed) = length(word)), diff AS (SELECT typed, word, count(*) AS n, min(substr(typed, i, 1) || substr(word, i, 1)) AS p FROM same WHERE substr(typed, i, 1) <> substr(word, i, 1) GROUP BY ALL)
SELECT c.typed, c.word, CASE WHEN n = 1 AND p IN (SELECT p FROM pairs) THEN 0 WHEN length(c.word) = length(c.typed) + 1 AND contains(c.word, '''') AND replace(c.word, '''', '') = replace(c.typed, '''', '') THEN 0 ELSE 1 END::BIGINT AS distance FROM c LEFT JOIN diff USING (typed, word)"""
)
def rewrite_distances(s, d):
    """Letters of each one-edit candidate that are neither restored nor an apostrophe."""
    rows = C.edits(_typed(s, d)).join(_known(s, d).select("word"), "word", "left_semi").select("typed", "word").distinct()
    return rows.select("typed", "word", C.rewrite_distance("typed", "word").cast("bigint").alias("distance"))


@query(
    f"""WITH RECURSIVE {TOK}, {REQ}, {TYPED}, {_RESTORE}, g AS (SELECT DISTINCT typed, substr(typed, 1, i) || substr(typed, i + 2) AS base FROM (SELECT typed, unnest(range(1, length(typed))) AS i FROM typed) WHERE substr(typed, i, 1) = substr(typed, i + 1, 1)),
v AS (SELECT typed, base AS word, 0::BIGINT AS at, 0 AS changed FROM g UNION ALL SELECT v.typed, substr(v.word, 1, p.i - 1) || rest.b || substr(v.word, p.i + 1), p.i, v.changed + 1 FROM v, LATERAL (SELECT unnest(range(v.at + 1, length(v.word) + 1)) AS i) p JOIN rest ON rest.a = substr(v.word, p.i, 1) WHERE v.changed < 2)
SELECT DISTINCT typed, word FROM v WHERE changed > 0"""
)
def gemination_restorations(s, d):
    return C.dedoubled_restorations(_typed(s, d))


# ---- compounds: a modifier, and the first letters of a head or the head with one letter too few
_PARTS = """md AS (SELECT DISTINCT form AS part FROM forms WHERE (bundle & 3) = 3 AND length(form) BETWEEN 4 AND 7), hd AS (SELECT lemma AS word, sum(frequency)::BIGINT AS frequency FROM lem JOIN uni ON uni.word = lemma AND lane = 'es' GROUP BY lemma),
asked AS (SELECT DISTINCT part || substr(word, 1, 4) AS typed FROM md JOIN hd ON substr(part, 1, 2) = substr(word, 1, 2) WHERE length(word) BETWEEN 5 AND 6),
cutting AS (SELECT typed, max(i) AS i FROM (SELECT typed, unnest(range(4, length(typed) - 3)) AS i FROM asked) WHERE substr(typed, 1, i) IN (SELECT part FROM md) GROUP BY typed), cuts AS (SELECT typed, substr(typed, 1, i) AS modifier, substr(typed, i + 1) AS rest FROM cutting)"""


def _parts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    forms = _forms(s, d)
    genitive = F.col("bundle").bitwiseAND(F.lit(3)) == 3
    mods = forms.filter(genitive & F.length("form").between(4, 7)).select(F.col("form").alias("word")).distinct()
    heads = forms.select(F.col("lemma").alias("word")).distinct().join(_uni(s, d).filter("lane = 'es'").groupBy("word").agg(F.sum("frequency").alias("frequency")), "word")
    two = lambda df: df.withColumn("h", F.left("word", F.lit(2)))
    asked = two(mods).alias("a").join(two(heads.filter(F.length("word").between(5, 6))).alias("b"), "h").select(F.concat("a.word", F.left("b.word", F.lit(4))).alias("typed")).distinct()
    return C.compound_heads(asked, mods), mods, heads


@query(
    f"""WITH {TOK}, {FORMS}, {_PARTS}, f AS (SELECT typed, modifier || word AS word, 3 + 0.5::DOUBLE * (length(word) - length(rest)) AS cost, row_number() OVER (PARTITION BY typed ORDER BY frequency DESC, word) AS r FROM cuts JOIN hd ON starts_with(word, rest) AND length(word) > length(rest))
SELECT typed, word, cost FROM f WHERE r <= 8"""
)
def compound_completion(s, d):
    """Compounds begun: the longest modifier, and the most frequent heads that go on with the rest."""
    cuts, _, heads = _parts(s, d)
    return C.compound_completions(cuts, heads)


@query()
def compound_repair(s, d):
    """Compounds whose head is one edit off."""
    cuts, _, heads = _parts(s, d)
    return C.compound_repairs(cuts, heads)


@query(f"WITH {TOK}, {FORMS}, {_PARTS}, l AS (SELECT typed, modifier, rest, unnest(['s', 'a', 'r', 'u', 'n']) AS c FROM cuts) SELECT typed, modifier || c || rest AS word, c <> 'n' OR EXISTS (SELECT 1 WHERE false) AS linking FROM l")
def linking_letters(s, d):
    """Whether a letter put in between modifier and head is a linking letter."""
    cuts, _, _ = _parts(s, d)
    rows = cuts.withColumn("c", F.explode(F.array(*[F.lit(c) for c in "sarun"]))).withColumn("word", F.concat("modifier", "c", "rest"))
    return rows.select("typed", "word", C.inserts_linking_letter(F.col("typed"), F.col("word"), F.length("modifier")).alias("linking"))


# ---- restoring: the lexicon with an accented twin of each Spanish word with an o, and an English 's for each longer word
_TWINS = """uni2 AS (SELECT lane, word, frequency FROM uni UNION ALL SELECT lane, regexp_replace(word, 'o', 'ó') AS word, CASE WHEN length(word) % 2 = 1 THEN 12 ELSE 2 END * frequency AS frequency FROM uni WHERE lane = 'es' AND length(word) >= 4 AND contains(word, 'o')),
bare AS (SELECT DISTINCT word AS typed, regexp_replace(word, 'o', 'ó') AS word FROM uni WHERE lane = 'es' AND length(word) >= 4 AND contains(word, 'o'))"""


def _twins(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    uni = _uni(s, d)
    accented = F.concat(F.substring_index("word", "o", 1), F.lit("ó"), F.expr("substr(word, locate('o', word) + 1)"))
    own = uni.filter((F.col("lane") == "es") & (F.length("word") >= 4) & F.contains("word", F.lit("o")))
    times = F.when(F.length("word") % 2 == 1, 12).otherwise(2)
    more = own.select("lane", accented.alias("word"), (times * F.col("frequency")).alias("frequency"))
    return uni.select("lane", "word", "frequency").unionByName(more), own.select(F.col("word").alias("typed"), accented.alias("word")).distinct()


def _both_scored(s: SparkSession, d: str) -> DataFrame:
    from lexmill.plans.language import _stored

    lexicon, pairs = _twins(s, d)
    keep = [f"{x}_{lane}" for x in ("f", "z") for lane in ("primary", "secondary")]
    score = lambda column, prefix: M.with_scores(pairs.select(F.col(column).alias("word")).distinct(), lexicon, _stored(s, d).scale).select(F.col("word").alias(column), *(F.col(c).alias(f"{prefix}_{c}") for c in keep))
    return pairs.join(score("typed", "t"), "typed").join(score("word", "w"), "word")


_TWIN_Z = "(ln((coalesce({f}, 0) + 0.5) / (n{k} + 50000.0)) - (mu{k} - ln(n{k} + 50000.0))) / s{k}"
_TWIN_SCORES = f"""{_TWINS}, lex AS MATERIALIZED (SELECT word, max(frequency) FILTER (lane = 'es') AS f1, max(frequency) FILTER (lane = 'en') AS f2 FROM uni2 GROUP BY word),
one AS MATERIALIZED (SELECT {", ".join(f"max(mu) FILTER (lane = '{lane}') AS mu{k}, max(sigma) FILTER (lane = '{lane}') AS s{k}, max(total) FILTER (lane = '{lane}') AS n{k}" for k, lane in ((1, "es"), (2, "en")))} FROM cal JOIN tot USING (lane)),
both_ AS MATERIALIZED (SELECT typed, bare.word, t.f1 AS tf1, t.f2 AS tf2, w.f1 AS wf1, w.f2 AS wf2, {_TWIN_Z.format(f="t.f1", k=1)} AS tz1, {_TWIN_Z.format(f="t.f2", k=2)} AS tz2, {_TWIN_Z.format(f="w.f1", k=1)} AS wz1, {_TWIN_Z.format(f="w.f2", k=2)} AS wz2
FROM bare LEFT JOIN lex t ON t.word = typed LEFT JOIN lex w ON w.word = bare.word CROSS JOIN one)"""


@query(
    f"""WITH {TOK}, {CAL}, {_TWIN_SCORES}, g AS (SELECT typed, word, true AS lane, wf1 IS NOT NULL AND coalesce(CASE WHEN tf1 IS NOT NULL THEN wf1 >= 10 * tf1 ELSE wz1 >= 1.0 END, false) AS dominates, wz1 - tz1 >= 0 AS advantage, tf2 IS NULL OR ln(0.7 / (1 - 0.7)) + wz1 - tz2 >= 0.25 AS guard FROM both_)
SELECT *, lane AND dominates AND advantage AND guard AS apply FROM g"""
)
def restoration_gates(s, d):
    """The gates of replacing a bare form by its accented twin, in a session that leans to the primary lane."""
    return C.restoration_gates(_both_scored(s, d), 0.7).select("typed", "word", "lane", "dominates", "advantage", "guard", "apply")


@query(f"WITH {TOK}, {CAL}, {_TWIN_SCORES} SELECT typed, word, round(wz1, 6) AS z FROM both_ WHERE wf1 >= 10 * tf1 AND wz1 >= -0.5 AND (tf2 IS NULL OR wz1 > tz2)")
def restorable_twins(s, d):
    """Accented twins that stand for a bare form: ten times as frequent, typical, and ahead of the other lane's reading."""
    rows = _both_scored(s, d).filter((F.col("w_f_primary") >= DEFAULT.twin_dominance * F.col("t_f_primary")) & (F.col("w_z_primary") >= DEFAULT.boosted_z))
    return rows.filter("t_f_secondary IS NULL OR w_z_primary > t_z_secondary").select("typed", "word", F.round("w_z_primary", 6).alias("z"))


@query(f"WITH {TOK}, own AS (SELECT word, frequency FROM uni WHERE lane = 'en' AND length(word) >= 3 AND NOT ends_with(word, 's') AND regexp_full_match(word, '\\p{{L}}+')) SELECT word || '''s' AS word, word AS base, greatest(1, round(0.1 * frequency))::BIGINT AS derived FROM own")
def possessives_derived(s, d):
    """The possessive of every English word that can take one, with the frequency it gets from its base."""
    own = _uni(s, d).filter((F.col("lane") == "en") & (F.length("word") >= 3) & ~F.col("word").endswith("s") & F.col("word").rlike("^\\p{L}+$"))
    return own.select(F.concat("word", F.lit("'s")).alias("word"), F.col("word").alias("base"), F.greatest(F.lit(1), F.round(0.1 * F.col("frequency"))).cast("bigint").alias("derived"))


@query(
    f"""WITH {TOK}, {REQ}, {KNOWN}, {LOG}, own AS (SELECT word FROM words WHERE explicit OR n_days >= 2), q AS (SELECT word AS typed FROM req UNION SELECT previous || '-' || word FROM reqpair UNION SELECT word FROM words UNION SELECT word FROM gone),
ok AS (SELECT word FROM (SELECT word FROM known UNION SELECT word FROM own) WHERE word NOT IN (SELECT word FROM gone)), h AS (SELECT typed, bool_and(part IN (SELECT word FROM ok)) AS h FROM (SELECT typed, unnest(string_split(typed, '-')) AS part FROM q WHERE contains(typed, '-')) WHERE part <> '' GROUP BY typed)
SELECT typed, typed IN (SELECT word FROM known) AS known, typed IN (SELECT word FROM own) AS personal, typed IN (SELECT word FROM gone) AS deleted, typed IN (SELECT word FROM ok) AS valid, coalesce(h, false) AS hyphenated FROM q LEFT JOIN h USING (typed)"""
)
def validity_predicates(s, d):
    """Requests, hyphenated pairs and personal words: what makes each valid."""
    from lexmill.operators import learning as A

    words = _words(s, d)
    joined = _request_pairs(s, d).select(F.concat_ws("-", "previous", "word").alias("typed"))
    asked = _requests(s, d).toDF("typed").union(joined).union(words.select("word")).union(_gone(s)).distinct()
    return C.validity(asked, _known(s, d), words.filter(A.learned(words)), _gone(s))


# ---- reports
@query(
    f"""WITH {TOK}, {REQ}, {TYPED}, {KNOWN}, {_SUBST}, {_EDITS}, u AS (SELECT typed, word, 1 AS bit FROM edits SEMI JOIN known USING (word) UNION ALL SELECT typed, word, 2 FROM typed JOIN known ON substr(word, 1, 3) = substr(typed, 1, 3) AND starts_with(word, typed) AND word <> typed),
m AS (SELECT unnest(range(0, 4)) AS disabled) SELECT disabled::BIGINT AS disabled, count(DISTINCT typed || '/' || word) AS candidates FROM m LEFT JOIN u ON u.bit & disabled = 0 GROUP BY disabled"""
)
def provider_ablation(s, d):
    """How many candidates are left with each set of providers turned off."""
    edits = C.edits(_typed(s, d)).join(_known(s, d).select("word"), "word", "left_semi").select("typed", "word", F.lit(1).alias("bit"))
    found = edits.unionByName(completion_costs(s, d).select("typed", "word", F.lit(2).alias("bit"))).groupBy("typed", "word").agg(F.bit_or("bit").alias("bits"))
    sums = found.groupBy("bits").agg(F.count(F.lit(1)).alias("n"))
    masks = s.range(4).select(F.col("id").alias("disabled"))
    left = masks.join(F.broadcast(sums), F.col("bits").bitwiseAND(F.bitwise_not("disabled")) != 0, "left")  # four rows by three
    return left.groupBy("disabled").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("candidates"))


_RIGHT = f"""meant AS (SELECT DISTINCT substr(word, 1, 2) || substr(word, 4) AS typed, word FROM req WHERE length(word) BETWEEN 4 AND 12),
scn AS (SELECT m.typed, m.word, (r.word IS NOT NULL) AS passed FROM meant m LEFT JOIN ({ORACLE_SQL['corrections_ranked']}) r ON r.typed = m.typed AND r.word = m.word)"""


@query(f"WITH {TOK}, {REQ}, {_RIGHT} SELECT count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed FROM scn")
def scenario_report(s, d):
    """Of all words typed without their third letter, how many are among the first five suggestions."""
    from lexmill.plans.correction import corrections_ranked

    meant = _requests(s, d).filter(F.length("word").between(4, 12)).select(F.concat(F.left("word", F.lit(2)), F.substr("word", F.lit(4), F.length("word"))).alias("typed"), "word").distinct()
    rows = meant.join(corrections_ranked(s, d).select("typed", "word", F.lit(True).alias("hit")), ["typed", "word"], "left")
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("hit").isNotNull()).alias("passed"), F.count_if(F.col("hit").isNull()).alias("failed"))


@query(
    f"""WITH {TOK}, {CAL}, {REQ}, {FORMS}, x AS ({scored_sql('req', '1 AS one')}) SELECT word, coalesce(f1, 0)::BIGINT AS frequency_primary, coalesce(f2, 0)::BIGINT AS frequency_secondary, round(z1, 6) AS z_primary, round(z2, 6) AS z_secondary, greatest(z1, z2) >= -1.0 AS cap_artifact, word IN (SELECT form FROM forms) AS form, round({blend_sql('z1', 'z2')}, 6) AS score FROM x"""
)
def word_diagnostics(s, d):
    """What the model knows of each request; a capital at the start of a sentence is an artifact if the word is
    typical in either lane."""
    rows = _scored(s, d, _requests(s, d)).join(_forms(s, d).select(F.col("form").alias("word"), F.lit(True).alias("form")).distinct(), "word", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(
        "word", zero("f_primary").alias("frequency_primary"), zero("f_secondary").alias("frequency_secondary"), F.round("z_primary", 6).alias("z_primary"), F.round("z_secondary", 6).alias("z_secondary"),
        (F.greatest("z_primary", "z_secondary") >= -1.0).alias("cap_artifact"), F.coalesce("form", F.lit(False)).alias("form"), F.round(M.blend(F.col("z_primary"), F.col("z_secondary"), F.lit(0.5)), 6).alias("score"),
    )


@query(f"WITH {LOG} SELECT count(*) AS total, count(*) FILTER (kind <> 'ts' AND word NOT IN (SELECT word FROM gone)) AS applied, count(*) FILTER (kind <> 'ts' AND word IN (SELECT word FROM gone)) AS deleted, count(*) FILTER (kind = 'ts') AS taps, count(DISTINCT day) AS days FROM log")
def compaction_summary(s, d):
    gone = _gone(s).select("word", F.lit(True).alias("gone"))
    rows = _log(s, d).join(F.broadcast(gone), "word", "left")  # two rows
    tap, out = F.col("kind") == "ts", F.col("gone").isNotNull()
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(~tap & ~out).alias("applied"), F.count_if(~tap & out).alias("deleted"), F.count_if(tap).alias("taps"), F.count_distinct("day").alias("days"))


_FALLBACK = f"""firsts AS (SELECT DISTINCT substr(word, 1, 3) || '-' AS previous FROM req UNION SELECT word FROM req), cont AS (SELECT w1 AS previous, w2 AS word, row_number() OVER (PARTITION BY w1, lane ORDER BY frequency DESC, w2) AS r FROM bi),
found AS (SELECT DISTINCT previous, word FROM firsts JOIN cont USING (previous) WHERE r <= 24), topw AS (SELECT DISTINCT word FROM (SELECT word, row_number() OVER (PARTITION BY lane ORDER BY frequency DESC, word) AS r FROM uni) WHERE r <= 50),
pool AS (SELECT previous, word, false AS fallback FROM found UNION ALL SELECT previous, word, true FROM firsts, topw WHERE previous NOT IN (SELECT previous FROM found)), x AS ({scored_sql('pool', 'q.previous, q.fallback')}),
k AS (SELECT previous, word, fallback, {blend_sql('z1', 'z2')} AS score, row_number() OVER (PARTITION BY previous ORDER BY round({blend_sql('z1', 'z2')}, 9) DESC, word) AS rank FROM x)"""


@query(f"WITH {TOK}, {BI}, {CAL}, {REQ}, {_FALLBACK} SELECT previous, word, fallback, rank, round(score, 6) AS score FROM k WHERE rank <= 5")
def next_word_fallback(s, d):
    """Next words by the single-word score; where nothing follows a word, from the most frequent words."""
    firsts = _requests(s, d).select(F.concat(F.left("word", F.lit(3)), F.lit("-")).alias("previous")).union(_requests(s, d)).distinct()
    found = L.continuations(firsts.toDF("w1"), _bi(s, d), DEFAULT.continuation_limit, scan_limit=False).select(F.col("w1").alias("previous"), "word").distinct()
    top = L.top(_uni(s, d), ["lane"], DEFAULT.unigram_limit).select("word").distinct()
    rest = firsts.join(found.select("previous").distinct(), "previous", "left_anti").crossJoin(F.broadcast(top))  # 50 words a lane
    rows = _scored(s, d, found.withColumn("fallback", F.lit(False)).unionByName(rest.withColumn("fallback", F.lit(True))))
    rows = rows.withColumn("score", M.blend(F.col("z_primary"), F.col("z_secondary"), F.lit(0.5))).withColumn("by", F.round("score", 9))
    return M.ranked(rows, ["previous"], 5, "by").select("previous", "word", "fallback", "rank", F.round("score", 6).alias("score"))


_CASED = "raw AS (SELECT regexp_extract_all(replace(text, '’', ''''), '[\\p{L}'']+') AS ws FROM conversations), sp AS (SELECT p.a AS previous, p.b AS word, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(ws)), lambda i: {'a': ws[i], 'b': ws[i + 1]})) AS p FROM raw WHERE len(ws) > 1) GROUP BY ALL)"


@query(
    f"""WITH {_CASED}, q AS (SELECT DISTINCT lower(previous) AS previous, lower(word) AS word FROM sp), cap(x, y) AS (SELECT x, unnest([x, upper(x[1]) || x[2:]]) FROM (SELECT DISTINCT unnest([previous, word]) AS x FROM q)),
v AS (SELECT DISTINCT q.previous, q.word, a.y AS pv, b.y AS wv FROM q JOIN cap a ON a.x = q.previous JOIN cap b ON b.x = q.word) SELECT v.previous, v.word, max(coalesce(n, 0))::BIGINT AS count FROM v LEFT JOIN sp ON sp.previous = pv AND sp.word = wv GROUP BY ALL"""
)
def pair_count_case_variants(s, d):
    """How often a pair was said: the highest count over the spellings of both words in lower case and capitalised."""
    w = table(s, d, "conversations").select(F.regexp_extract_all(F.replace("text", F.lit("’"), F.lit("'")), F.lit(L.WORD_PATTERN), F.lit(0)).alias("w")).filter(F.size("w") > 1)
    pairs = w.select(F.explode(F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("previous"), F.slice("w", 2, F.size("w") - 1).alias("word"))).alias("p")).groupBy("p.previous", "p.word").agg(F.count(F.lit(1)).alias("n"))
    asked = pairs.select(T.lower_case(F.col("previous")).alias("previous"), T.lower_case(F.col("word")).alias("word")).distinct()
    spelled = asked.select("*", F.explode(T.case_variants(F.col("previous"))).alias("pv")).select("*", F.explode(T.case_variants(F.col("word"))).alias("wv"))
    return spelled.join(pairs.toDF("pv", "wv", "n"), ["pv", "wv"], "left").groupBy("previous", "word").agg(F.max(F.coalesce("n", F.lit(0))).alias("count"))


# ---- morphology
@query(f"WITH {TOK}, {REQ}, {FORMS}, q AS (SELECT word FROM req UNION SELECT DISTINCT form FROM forms) SELECT word, word IN (SELECT form FROM forms) AS known, word IN (SELECT form FROM forms WHERE pos <= 2) AS open_class FROM q")
def known_forms(s, d):
    asked = _requests(s, d).union(_forms(s, d).select("form")).distinct()
    return P.known_forms(asked, _forms(s, d))


@query(f"WITH {TOK}, {FORMS} SELECT form AS word, array_to_string(list_sort(list_distinct(list(['nf', 'þf', 'þgf', 'ef'][(bundle & 3) + 1]))), ',') AS cases, array_to_string(list_sort(list_distinct(list(lemma))), ',') AS lemmas FROM forms GROUP BY form")
def form_cases(s, d):
    forms = _forms(s, d)
    return P.cases(forms.select(F.col("form").alias("word")).distinct(), forms).select("word", F.array_join("cases", ",").alias("cases"), F.array_join("lemmas", ",").alias("lemmas"))


@query(f"WITH {TOK}, {FORMS}, q AS (SELECT DISTINCT form AS word FROM forms) SELECT DISTINCT q.word, b.form FROM q JOIN forms a ON a.form = q.word JOIN forms b ON b.lemma = a.lemma AND b.bundle & 3 = 3 WHERE q.word NOT IN (SELECT form FROM forms WHERE bundle & 3 = 3) AND b.form <> q.word")
def wrong_case_siblings(s, d):
    """Genitives of words that cannot be one."""
    forms = _forms(s, d)
    return P.wrong_case_siblings(forms.select(F.col("form").alias("word")).distinct(), forms, 3)


@query(f"WITH {TOK}, {BI}, {REQ}, m AS (SELECT w1, w2, sum(frequency)::BIGINT AS f FROM bi WHERE lane = 'es' GROUP BY ALL) SELECT previous, word, coalesce(f, 0) AS frequency FROM reqpair LEFT JOIN m ON w1 = previous AND w2 = word")
def morphology_bigrams(s, d):
    return P.pair_frequency(_request_pairs(s, d), _bi(s, d).filter("lane = 'es'"))


@query(f"WITH {TOK}, {FORMS}, q AS (SELECT DISTINCT word FROM uni WHERE lane = 'es') SELECT DISTINCT word, coalesce(lemma, word) AS lemma FROM q LEFT JOIN forms ON form = word AND pos = 0 AND bundle & 3 = 1")
def lemmatize_morph(s, d):
    """Lemmas of words read as nouns in the accusative."""
    accusative = _forms(s, d).filter(F.col("bundle").bitwiseAND(F.lit(3)) == 1)
    return P.lemmatize(_uni(s, d).filter("lane = 'es'").select("word").distinct(), accusative, pos=0)


# ---- item histories, files and indexes
@query(
    """WITH o AS (SELECT user_id, (event_id % 12)::BIGINT AS item, {'us': epoch_us(ts), 'id': event_id} AS t, CASE event_type WHEN 'purchase' THEN 'pin' WHEN 'signup' THEN 'unpin' WHEN 'error' THEN 'remove' ELSE 'use' END AS op FROM events),
g AS (SELECT user_id, item, max(t) AS gone FROM o WHERE op = 'remove' GROUP BY ALL), s AS (SELECT user_id, item, max(t) AS t, max(t) FILTER (op = 'pin') AS p, max(t) FILTER (op = 'unpin') AS u FROM o LEFT JOIN g USING (user_id, item) WHERE op <> 'remove' AND (gone IS NULL OR t > gone) GROUP BY ALL),
r AS (SELECT user_id, item, (p IS NOT NULL AND (u IS NULL OR p > u)) AS pinned, t FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, pinned ORDER BY t DESC, item) AS position FROM r) SELECT user_id, item, pinned, position FROM k WHERE pinned OR position <= 4"""
)
def item_history(s, d):
    """Pinned and recent items of each user after all uses, pins, unpins and removals."""
    kind = F.when(F.col("event_type") == "purchase", "pin").when(F.col("event_type") == "signup", "unpin").when(F.col("event_type") == "error", "remove").otherwise("use")
    log = table(s, d, "events").select("user_id", (F.col("event_id") % 12).alias("item"), F.struct(us("ts").alias("us"), "event_id").alias("at"), kind.alias("op"))
    return S.item_history(log, 4)


_FILES = "files AS (SELECT page_id AS id, url AS display_name, length(html) AS size, CASE page_id % 3 WHEN 0 THEN 'text/html' ELSE 'text/html,text/plain' END AS mime_types FROM pages)"


def _files(s: SparkSession, d: str) -> DataFrame:
    kinds = F.when(F.col("page_id") % 3 == 0, "text/html").otherwise("text/html,text/plain")
    return table(s, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("display_name"), F.length("html").cast("bigint").alias("size"), kinds.alias("mime_types"))


@query(f"WITH {_FILES}, clips AS (SELECT DISTINCT event_id AS id FROM events WHERE event_type = 'purchase') SELECT id, display_name, size FROM files WHERE id IN (SELECT id FROM clips)")
def files_of_items(s, d):
    """Name and size of the files that items refer to."""
    asked = table(s, d, "events").filter("event_type = 'purchase'").select(F.col("event_id").alias("id"))
    return _files(s, d).join(asked, "id", "left_semi").select("id", "display_name", "size")


@query(f"WITH {_FILES}, gone AS (SELECT DISTINCT event_id AS id FROM events WHERE event_type = 'error') SELECT id, display_name, size, mime_types FROM files WHERE id NOT IN (SELECT id FROM gone)")
def files_deleted(s, d):
    """The files that are left when those of erroneous items are deleted."""
    gone = table(s, d, "events").filter("event_type = 'error'").select(F.col("event_id").alias("id"))
    return _files(s, d).join(gone, "id", "left_anti")


@query(f"WITH {_FILES}, more AS (SELECT p_partkey AS id, p_name AS display_name, p_size::BIGINT AS size, 'text/plain' AS mime_types FROM part) SELECT * FROM files WHERE id NOT IN (SELECT id FROM more) UNION ALL SELECT * FROM more")
def files_inserted(s, d):
    more = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("display_name"), F.col("p_size").cast("bigint").alias("size"), F.lit("text/plain").alias("mime_types"))
    return S.inserted(_files(s, d), more)


@query(f"WITH {_FILES} SELECT id, len(list_filter(string_split(mime_types, ','), lambda x: x <> '')) AS n, array_to_string(list_filter(string_split(mime_types || ',,', ','), lambda x: x <> ''), ',') AS again FROM files")
def list_codec(s, d):
    """Lists of types written with commas, read and written again."""
    return _files(s, d).select("id", F.size(T.to_list(F.col("mime_types"))).cast("bigint").alias("n"), T.from_list(T.to_list(F.concat("mime_types", F.lit(",,")))).alias("again"))


@query("SELECT 'region' AS kind, r_regionkey::BIGINT AS id, r_name AS name FROM region UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def index_union(s, d):
    """Three indexes as one."""
    of = lambda name, key, label: table(s, d, name).select(F.lit(name).alias("kind"), F.col(key).cast("bigint").alias("id"), F.col(label).alias("name"))
    return of("region", "r_regionkey", "r_name").unionByName(of("nation", "n_nationkey", "n_name")).unionByName(of("supplier", "s_suppkey", "s_name"))


@query("WITH w AS (SELECT p_brand FROM part UNION SELECT 'Brand#none') SELECT p_brand, min(p_partkey) AS p_partkey FROM w LEFT JOIN part USING (p_brand) GROUP BY p_brand")
def inverse_lookup(s, d):
    """The first part of each brand, null for a brand without parts."""
    part = table(s, d, "part")
    wanted = part.select("p_brand").union(s.createDataFrame([("Brand#none",)], "p_brand string")).distinct()
    return S.first_key(part, wanted, "p_partkey", "p_brand")


# ---- text
@query("SELECT doc_id, regexp_extract(text, '([\\p{L}'']+)[^\\p{L}'']*$', 1) AS last_word, coalesce(length(rtrim(text)) > 0 AND NOT regexp_matches(rtrim(text), '[.!?]$'), false) AS mid_sentence, length(regexp_extract(text, '([^ \\t\\n]+[ \\t\\n]*)$', 1)) AS to_delete FROM documents")
def end_of_text(s, d):
    """The last word of each text, whether the text breaks off within a sentence, and what deleting a word takes."""
    text = F.col("text")
    return table(s, d, "documents").select("doc_id", T.last_word(text).alias("last_word"), T.mid_sentence(text).alias("mid_sentence"), T.last_word_length(text).cast("bigint").alias("to_delete"))


@query("SELECT p_partkey, substr(p_name, 3, 6) AS part_of, substr(p_name, 1, 4) AS head, '' AS beyond, 'Buy ' || p_name || ' of ' || p_brand || ' {now}' AS filled FROM part")
def safe_substring(s, d):
    """Slices whose ends lie outside the text, and templates."""
    n = F.col("p_name")
    filled = T.fill("Buy {name} of {brand} {now}", name=n, brand=F.col("p_brand"))
    return table(s, d, "part").select("p_partkey", T.slice_safe(n, 2, 8).alias("part_of"), T.slice_safe(n, -5, 4).alias("head"), T.slice_safe(n, 4000, 9).alias("beyond"), filled.alias("filled"))


@query(f"WITH {TOK} SELECT c, unicode(c)::BIGINT AS code, count(*) AS words FROM (SELECT DISTINCT word, unnest(string_split(word, '')) AS c FROM uni) WHERE c <> '' GROUP BY c")
def code_points(s, d):
    """The letters of the lexicon with their code points, and in how many words they stand."""
    letters = _uni(s, d).select("word").distinct().select("word", F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''")
    return letters.groupBy("c").agg(F.count(F.lit(1)).alias("words")).select("c", F.ascii("c").cast("bigint").alias("code"), "words")


@query(
    f"""WITH {TOK}, {CAL}, {REQ}, k AS ({ORACLE_SQL['softmax_confidence']}), m AS (SELECT prefix, unnest(['complete', 'always', 'space']) AS mode FROM (SELECT DISTINCT prefix FROM k)), t AS (SELECT prefix, max_by(word, (confidence, -length(word), word)) AS word, max(confidence) AS confidence FROM k GROUP BY prefix)
SELECT prefix, mode, CASE WHEN mode = 'always' OR mode = 'complete' AND confidence >= 0.5 THEN word END AS chosen FROM m JOIN t USING (prefix)"""
)
def spacebar_choice(s, d):
    """What the space bar commits: the confident candidate, the first one, or none."""
    from lexmill.plans.language import softmax_confidence

    top = softmax_confidence(s, d).groupBy("prefix").agg(F.max_by("word", F.struct("confidence", F.negative(F.length("word")), "word")).alias("word"), F.max("confidence").alias("confidence"))
    rows = top.select("*", F.explode(F.array(*[F.lit(m) for m in ("complete", "always", "space")])).alias("mode"))
    return rows.select("prefix", "mode", F.when((F.col("mode") == "always") | ((F.col("mode") == "complete") & (F.col("confidence") >= 0.5)), F.col("word")).alias("chosen"))


@query(
    f"""SELECT g.typed, g.apply, c.candidates, concat_ws(',', CASE WHEN NOT long_enough THEN 'long_enough' END, CASE WHEN NOT cheap THEN 'cheap' END, CASE WHEN NOT marks_kept THEN 'marks_kept' END, CASE WHEN NOT typical THEN 'typical' END, CASE WHEN NOT ahead THEN 'ahead' END) AS failed
FROM ({ORACLE_SQL['autocorrect_gates']}) g JOIN (SELECT typed, string_agg(word, ',' ORDER BY rank) AS candidates FROM ({ORACLE_SQL['corrections_ranked']}) GROUP BY typed) c USING (typed)"""
)
def correction_trace(s, d):
    """Why each request is corrected or not: its first candidates, and the gates that its winner fails."""
    from lexmill.plans.correction import corrections_ranked

    gates = ("long_enough", "cheap", "marks_kept", "typical", "ahead")
    failed = F.concat_ws(",", *(F.when(~F.col(g), g) for g in gates))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda c: c["word"])  # five at most
    shown = corrections_ranked(s, d).groupBy("typed").agg(F.array_join(ordered, ",").alias("candidates"))
    return autocorrect_gates(s, d).select("typed", "apply", failed.alias("failed")).join(shown, "typed")


_ACUTES = "letters(typed, word) AS (VALUES ('a', 'á'), ('e', 'é'), ('i', 'í'), ('o', 'ó'), ('u', 'ú'), ('y', 'ý')), common AS (SELECT max(frequency) AS f FROM uni WHERE lane = 'es')"


@query(
    f"""WITH {TOK}, {CAL}, {_ACUTES}, uni2 AS (SELECT lane, word, frequency FROM uni WHERE NOT (lane = 'es' AND word IN (SELECT word FROM letters)) UNION ALL SELECT 'es', word, f FROM letters, common WHERE typed < 'p'), q AS (SELECT typed AS word FROM letters UNION SELECT word FROM letters),
x AS ({scored_sql('q', '1 AS one').replace('FROM uni WHERE', 'FROM uni2 WHERE')}), b AS (SELECT word, f1, z1, {blend_sql('z1', 'z2', '0.7')} AS score FROM x)
SELECT l.typed, l.word, w.f1 IS NOT NULL AND w.z1 >= 1.5 AS offered, w.f1 IS NOT NULL AND w.z1 >= 1.5 AND 0.7 >= 0.65 AS auto, round(1 / (1 + exp(t.score - w.score)), 6) AS confidence FROM letters l JOIN b w ON w.word = l.word JOIN b t ON t.word = l.typed"""
)
def single_letter_rules(s, d):
    """Whether a lone letter is offered its accent, with the accents of a, e, i and o taken for the commonest words."""
    from lexmill.plans.language import _stored

    uni, letters = _uni(s, d).select("lane", "word", "frequency"), s.createDataFrame(sorted((b, a) for a, b in ACUTE.items()), "typed string, word string")
    common = F.broadcast(uni.filter("lane = 'es'").agg(F.max("frequency").alias("frequency")))  # a single row
    own = letters.filter("typed < 'p'").crossJoin(common).select(F.lit("es").alias("lane"), "word", "frequency")
    lexicon = uni.filter(~((F.col("lane") == "es") & F.col("word").isin(*ACUTE))).unionByName(own)
    asked = letters.select(F.col("typed").alias("word")).union(letters.select("word"))
    scored = M.with_scores(asked, lexicon, _stored(s, d).scale).withColumn("score", M.blend(F.col("z_primary"), F.col("z_secondary"), F.lit(0.7)))
    rows = letters.join(scored.select("word", "f_primary", "z_primary", "score"), "word").join(scored.select(F.col("word").alias("typed"), F.col("score").alias("bare")), "typed")
    return C.single_letters(rows, 0.7).select("typed", "word", "offered", "auto", F.round("confidence", 6).alias("confidence"))


# ---- the whole decision: words without a letter after the word before them, words that ran together, and taps
_ASKED = """wordreq AS (SELECT substr(word, 1, 2) || substr(word, 4) AS typed, min(previous) AS previous FROM reqpair WHERE length(word) BETWEEN 4 AND 12 GROUP BY 1),
joined AS (SELECT previous || word AS typed, min(previous || ' ' || word) AS word FROM reqpair WHERE length(previous) BETWEEN 2 AND 5 AND length(word) BETWEEN 2 AND 5 GROUP BY 1),
typed AS (SELECT typed FROM wordreq UNION SELECT typed FROM joined)"""
_LIFT = "CASE WHEN c1 > 0 THEN (ln(0.6 * coalesce(b1, 0) / c1 + 0.4 * p1) - ln(p1)) / s1 END"


def _asked(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pairs = _request_pairs(s, d)
    cut = F.concat(F.left("word", F.lit(2)), F.substr("word", F.lit(4), F.length("word")))
    words = pairs.filter(F.length("word").between(4, 12)).groupBy(cut.alias("typed")).agg(F.min("previous").alias("previous"))
    short = F.length("previous").between(2, 5) & F.length("word").between(2, 5)
    joined = pairs.filter(short).groupBy(F.concat("previous", "word").alias("typed")).agg(F.min(F.concat_ws(" ", "previous", "word")).alias("word"))
    return words, joined


@query(
    f"""WITH {TOK}, {BI}, {CAL}, {REQ}, {KNOWN}, {_ASKED}, {_SUBST}, {_EDITS}, {_RESTORE}, pairs AS ({_PAIRS}),
c AS (SELECT typed, word, cost, previous FROM edits SEMI JOIN known USING (word) LEFT JOIN wordreq USING (typed)), x AS ({scored_sql("c", "q.typed, q.cost, q.previous")}),
y AS (SELECT x.*, u1.frequency AS c1, b1.frequency AS b1 FROM x LEFT JOIN uni u1 ON u1.word = previous AND u1.lane = 'es' LEFT JOIN bi b1 ON b1.w1 = previous AND b1.w2 = x.word AND b1.lane = 'es'),
h AS MATERIALIZED ({scored_sql("(SELECT DISTINCT unnest(string_split(word, ' ')) AS word FROM joined)", "1 AS one")}),
pool AS (SELECT typed, word, cost::DOUBLE AS cost, previous IS NOT NULL AS context, greatest(z1, z2) AS z, {_LIFT} AS lift, round(-cost + {blend_sql("z1", "z2")}, 9) AS score FROM y
UNION ALL SELECT typed, j.word, 5.0, false, least(greatest(a.z1, a.z2), greatest(b.z1, b.z2)), NULL, round(-5.0 + ({blend_sql("a.z1", "a.z2")} + {blend_sql("b.z1", "b.z2")}) / 2, 9) FROM joined j JOIN h a ON a.word = string_split(j.word, ' ')[1] JOIN h b ON b.word = string_split(j.word, ' ')[2]),
k AS MATERIALIZED (SELECT *, row_number() OVER w AS r, score - lead(score) OVER w AS margin, lead(lift) OVER w AS runner_lift, min(CASE WHEN NOT contains(word, ' ') THEN cost END) OVER (PARTITION BY typed) AS single_cost FROM pool WINDOW w AS (PARTITION BY typed ORDER BY score DESC, word)),
same AS (SELECT typed, word, unnest(range(1, length(typed) + 1)) AS i FROM k WHERE r = 1 AND length(typed) = length(word)), diff AS (SELECT typed, count(*) AS n, min(substr(typed, i, 1) || substr(word, i, 1)) AS p FROM same WHERE substr(typed, i, 1) <> substr(word, i, 1) GROUP BY ALL),
taps AS (SELECT typed, pos, typed[pos] AS letter, x + ((pos * 3) % 7 - 3) / 10.0 AS x, y FROM (SELECT typed, unnest(range(1, length(typed) + 1)) AS pos FROM typed) JOIN keys ON k = typed[pos] WHERE typed[pos] NOT IN ('á', 'é', 'í', 'ó', 'ú', 'ý')),
post AS (SELECT typed, pos, sum(exp(-d)) FILTER (letter = k) / sum(exp(-d)) AS p FROM (SELECT typed, pos, letter, k, (pow(taps.x - keys.x, 2) + pow(taps.y - keys.y, 2)) / (2 * 0.4 * 0.4) AS d FROM taps, keys WHERE k NOT IN ('á', 'é', 'í', 'ó', 'ú', 'ý')) GROUP BY ALL), sure AS (SELECT typed, avg(p) AS confidence FROM post GROUP BY typed),
w AS (SELECT k.*, contains(word, ' ') AS split, NOT contains(word, ' ') AND coalesce(n = 1 AND p IN (SELECT p FROM pairs) OR length(word) = length(typed) + 1 AND contains(word, '''') AND replace(word, '''', '') = replace(typed, '''', ''), false) AS restored, typed IN (SELECT word FROM known) AS valid, length(typed) % 2 = 0 AS capital, confidence,
 typed[: -2] IN (SELECT word FROM uni WHERE lane = 'es') AS stem1, typed[: -2] IN (SELECT word FROM uni WHERE lane = 'en') AS stem2 FROM k LEFT JOIN diff USING (typed) LEFT JOIN sure USING (typed) WHERE r = 1),
v AS (SELECT *, CASE WHEN NOT valid AND split THEN 'split' WHEN NOT valid AND restored THEN 'restoration' WHEN NOT valid THEN 'ordinary' WHEN restored THEN 'restoration of a word' ELSE 'none' END AS rule,
 CASE WHEN length(typed) <= 2 THEN 1.5 WHEN length(typed) <= 3 AND NOT restored AND context AND coalesce(lift < 0.25, true) THEN 1.5 ELSE -2.5 END AS floor, z < -1.0 AS junk FROM w),
g AS (SELECT *, CASE WHEN split THEN 2.5 WHEN restored THEN 0.5 ELSE 1.15 * CASE WHEN junk THEN 3.0 ELSE 1.0 END * CASE WHEN NOT junk AND coalesce(lift >= 0.75, false) AND coalesce(runner_lift <= 0, true) THEN 0.7 ELSE 1.0 END END * CASE WHEN restored THEN 1.0 ELSE least(4.0, 1 + 6.0 * greatest(coalesce(confidence, 0) - 0.5, 0)) END AS required FROM v),
d AS (SELECT typed, word, rule, round(required, 6)::DOUBLE AS required, length(typed) >= 2 AS long_enough, cost <= 6.0 AS cheap, length(replace(replace(word, '''', ''), '’', '')) - length(word) <= length(replace(replace(typed, '''', ''), '’', '')) - length(typed) AS marks_kept, rule <> 'none' AS open_rule,
 split OR starts_with(rule, 'restoration of') OR z >= floor AS typical, margin IS NULL OR margin >= required AS ahead, NOT split OR single_cost IS NULL OR single_cost > 2.5 AS no_single_word, NOT (length(typed) <= 2 AND length(word) > length(typed) AND starts_with(word, typed)) AS no_short_completion,
 NOT (capital AND NOT restored AND length(typed) >= 4 AND regexp_full_match(typed, '\\p{{L}}+s')) OR stem2 OR NOT stem1 AS no_name FROM g)
SELECT *, long_enough AND cheap AND marks_kept AND open_rule AND typical AND ahead AND no_single_word AND no_short_completion AND no_name AS apply FROM d"""
)
def autocorrect_decision(s, d):
    """The best suggestion for each typed word under every rule and gate: known words one edit away with the word before,
    words that ran together, taps a little beside their keys."""
    words, joined = _asked(s, d)
    uni, known = _uni(s, d), _known(s, d)
    asked = words.select("typed").union(joined.select("typed")).distinct()
    pool = C.edits(asked).join(known.select("word"), "word", "left_semi").join(words, "typed", "left")
    pairs = _stored(s, d).bigrams_after(words.select(F.col("previous").alias("w1")).distinct())
    scored = M.with_pair_scores(_scored(s, d, pool), uni, pairs)
    lift = F.when(F.coalesce("first_primary", F.lit(0)) > 0, F.col("zp_primary") - F.col("z_primary"))
    blend, best = M.blend(F.col("z_primary"), F.col("z_secondary"), F.lit(0.5)), F.greatest("z_primary", "z_secondary")
    singles = scored.select("typed", "word", F.col("cost").cast("double").alias("cost"), F.col("previous").isNotNull().alias("context"), best.alias("z"), lift.alias("lift"), F.round(-F.col("cost") + blend, 9).alias("score"))
    half = _scored(s, d, joined.select(F.explode(F.split("word", " ")).alias("word")).distinct()).select("word", best.alias("z"), blend.alias("b"))
    left, right = (half.select(*(F.col(c).alias(f"{c}{k}") for c in ("word", "z", "b"))) for k in (1, 2))
    two = joined.join(left, F.substring_index("word", " ", 1) == F.col("word1")).join(right, F.substring_index("word", " ", -1) == F.col("word2"))
    two = two.select("typed", "word", F.lit(5.0).alias("cost"), F.lit(False).alias("context"), F.least("z1", "z2").alias("z"), F.lit(None).cast("double").alias("lift"), F.round(-5.0 + (F.col("b1") + F.col("b2")) / 2, 9).alias("score"))
    won = D.winners(singles.unionByName(two))
    keys = s.createDataFrame([(k, float(x), float(y)) for k, (x, y) in sorted(key_centers().items()) if k not in ACUTE], "letter string, kx double, ky double")
    letters = asked.select("typed", F.posexplode(F.split("typed", "")).alias("p", "letter")).withColumn("pos", F.col("p") + 1)
    taps = letters.join(F.broadcast(keys), "letter").select("typed", "pos", "letter", (F.col("kx") + (F.col("pos") * 3 % 7 - 3) / 10).alias("x"), F.col("ky").alias("y"))  # 30 keys
    lane = lambda name, own: uni.filter(F.col("lane") == own).select(F.col("word").alias("stem"), F.lit(True).alias(name)).distinct()
    rows = won.join(known.select(F.col("word").alias("typed"), F.lit(True).alias("valid")), "typed", "left").withColumn("stem", F.left("typed", F.length("typed") - 1))
    rows = rows.join(lane("stem_primary", DEFAULT.primary), "stem", "left").join(lane("stem_secondary", DEFAULT.secondary), "stem", "left").join(D.tap_confidence(taps, 0.4), "typed", "left")
    rows = rows.na.fill(False, ["valid", "stem_primary", "stem_secondary"]).withColumns({"personal": F.lit(False), "capital": F.length("typed") % 2 == 0, "rewrite": C.rewrite_distance("typed", "word")})
    return D.decide(rows).select("typed", "word", "rule", F.round("required", 6).alias("required"), *D.GATES, "apply")
