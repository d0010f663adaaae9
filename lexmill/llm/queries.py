"""The queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import chosen_path, collocations, fm_quality, html_diff, katz, langid, mcd_rules, orc_tokens, packing, prefix_trie, qgram_decontam, reply_trees, substring_dedup
from lexmill.llm.common import crc_mod, table


def op1_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_texts(table(spark, sf_dir, "documents"))


def op2_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 3) == 1
    labels = table(spark, sf_dir, "labels").filter(~held_out)
    return fm_quality.score(docs, fm_quality.fit(docs, labels), held_out)


def op3_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mcd_rules.judge(table(spark, sf_dir, "documents"))


def op4_qgram_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qgram_decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), passage=qgram_decontam.PASSAGE)


def op5_hashed_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 5) == 0
    return langid.predict(docs, langid.fit(docs.filter(~held_out)), held_out)


def op6_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op7_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chosen_path.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op8_min_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digests(table(spark, sf_dir, "documents"))


def op9_nearest_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_diff.main_text(table(spark, sf_dir, "pages"))
    return text.withColumn("n_chars", F.length("text").cast("bigint"))


def op10_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = orc_tokens.token_files(table(spark, sf_dir, "documents"))
    return back.select("doc_id", "start", "n_tokens", orc_tokens.ids_crc32("ids").alias("ids_crc32"))


def op11_suffix_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return reply_trees.digests(reply_trees.written(rows.unionByName(planted)))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.shared_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_katz_backoff": op1_katz_backoff,
    "op2_factorisation_machine": op2_factorisation_machine,
    "op3_robust_outliers": op3_robust_outliers,
    "op4_qgram_lemma": op4_qgram_lemma,
    "op5_hashed_subwords": op5_hashed_subwords,
    "op6_fm_index": op6_fm_index,
    "op7_chosen_path": op7_chosen_path,
    "op8_min_bin_slack": op8_min_bin_slack,
    "op9_nearest_url": op9_nearest_url,
    "op10_orc_token_ids": op10_orc_token_ids,
    "op11_suffix_sigma": op11_suffix_sigma,
    "op12_reply_trees": op12_reply_trees,
    "op13_prefix_trie": op13_prefix_trie,
}
_WORDS = "SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)"


def _run_of(n: int) -> str:
    """``n`` words from here on, null where the document ends before."""
    return "word" + "".join(f" || ' ' || lead(word, {k}) OVER w" for k in range(1, n))


_ESCAPES = "regexp_replace(regexp_replace(text, '<(\\\\*(?:/?s>|\\|(?:im_start|im_end|endoftext|system|user|assistant)\\|>|unk>|pad>|</?SYS>>))', '<\\\\\\1', 'g'), '\\[(\\\\*/?INST\\])', '[\\\\\\1', 'g')"

#: What op6 and op7 return, by all windows and all pairs, and op11 by all runs of words; the others have trained models, alignments or token ids.
ORACLE_SQL: dict[str, str] = {
    "op6_fm_index": f"""WITH tok AS ({_WORDS.format(text="coalesce(text, '')")}), win AS (SELECT doc_id, pos, word, {_run_of(20)} AS run FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
seen AS (SELECT doc_id, pos, word, run IS NOT NULL AND row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) > 1 AS again FROM win),
cover AS (SELECT doc_id, pos, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM seen),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM cover GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)""",
    "op7_chosen_path": f"""WITH RECURSIVE tok AS ({_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}),
short AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS run FROM tok GROUP BY doc_id HAVING count(*) < 5), win AS (SELECT doc_id, {_run_of(5)} AS run FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
sh AS (SELECT DISTINCT doc_id, run FROM win WHERE run IS NOT NULL UNION SELECT doc_id, run FROM short), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM sh a JOIN sh b USING (run) WHERE a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)), e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b), c AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(coalesce(least, doc_id), doc_id) AS component_id, doc_id = least(coalesce(least, doc_id), doc_id) AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op11_suffix_sigma": f"""WITH piece AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(p, '[^\\x20\\x09]+') AS ws FROM (
SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
tok AS (SELECT lang, piece, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM piece), total AS (SELECT lang, count(*) AS n FROM tok GROUP BY lang),
win AS (SELECT lang, {", ".join(f"{_run_of(k)} AS p{k}" for k in range(1, 6))} FROM tok WINDOW w AS (PARTITION BY piece ORDER BY pos)),
f AS MATERIALIZED ({" UNION ALL ".join(f"SELECT lang, p{k} AS phrase, {k} AS size, count(*) AS f FROM win WHERE p{k} IS NOT NULL GROUP BY ALL HAVING count(*) >= 100" for k in range(1, 6))}),
cut AS (SELECT lang, phrase, size, f, string_split(phrase, ' ') AS ws, unnest(range(1, size)) AS k FROM f WHERE size > 1),
cand AS (SELECT c.lang, c.phrase, c.f AS a, c.k, x.f AS l, y.f AS r, n, 1000 * c.f::HUGEINT * n // (x.f::HUGEINT * y.f) AS score FROM cut c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[: c.k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.k + 1 :], ' ') JOIN total t ON t.lang = c.lang),
low AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, array_to_string(ws[i : j], ' ') AS phrase, max(f) AS most FROM (SELECT lang, f, string_split(phrase, ' ') AS ws, size, unnest(range(1, size + 1)) AS i FROM f WHERE size > 2), LATERAL (SELECT unnest(range(i + 1, size + 1)) AS j) WHERE j - i + 1 < size GROUP BY ALL)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (SELECT low.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low LEFT JOIN inner_ USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * a) WHERE rank <= 2000""",
    "op12_reply_trees": f"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, {_ESCAPES} AS escaped FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(7 + sum(length(role) + length(escaped) + 24) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id""",
    "op13_prefix_trie": """WITH own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: CASE WHEN d % 2 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END), 4294967295), 4294967295) % 4 AS h FROM own),
turn AS (SELECT c.conv_id, pos AS seq, role, text FROM conv c JOIN own o ON o.conv_id = c.base AND pos <= h UNION ALL SELECT c.conv_id, 10 + pos, role, text FROM conv c JOIN own o USING (conv_id) WHERE pos > h),
occ AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(sha256(length(role) || ':' || role || text), '') OVER w AS prefix, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS tokens FROM turn WINDOW w AS (PARTITION BY conv_id ORDER BY seq) UNION ALL SELECT conv_id, 0, '', 0 FROM conv),
last AS (SELECT conv_id, max(depth) AS depth FROM occ GROUP BY conv_id),
node AS (SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n, any_value(tokens) AS tokens, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (o.depth = last_depth), '') AS ends FROM (SELECT occ.*, last.depth AS last_depth FROM occ JOIN last USING (conv_id)) o GROUP BY prefix, depth),
link AS (SELECT n.prefix, p.conv_id AS parent FROM node n JOIN occ o ON o.conv_id = n.conv_id AND o.depth = n.depth - 1 JOIN node p ON p.prefix = o.prefix AND p.depth = o.depth),
kids AS (SELECT o.prefix, count(*) AS n FROM node n JOIN occ o ON o.conv_id = n.conv_id AND o.depth = n.depth - 1 GROUP BY o.prefix),
below AS (SELECT o.prefix, sum((n.n - 1) * n.tokens) AS saved, count(*) FILTER (k.n IS NULL) AS leaves FROM node n JOIN occ o ON o.conv_id = n.conv_id AND o.depth <= n.depth LEFT JOIN kids k ON k.prefix = n.prefix GROUP BY o.prefix)
SELECT n.conv_id, n.depth, parent AS parent_conv_id, n.n AS n_convs, coalesce(k.n, 0) AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256 FROM node n JOIN below USING (prefix) LEFT JOIN kids k USING (prefix) LEFT JOIN link USING (prefix)""",
}
