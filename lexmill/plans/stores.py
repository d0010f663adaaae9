"""Queries over dictionary and clipboard tables: parts are the dictionary, events the clipboard and the uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.operators import stores as S
from lexmill.plans.registry import query, table

NOW_S = 1706659200  # 2024-01-31 00:00:00 UTC
DICT = """dict AS (SELECT p_partkey AS id, p_name AS word, p_size AS frequency, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS locale, CASE WHEN p_partkey % 3 = 0 THEN lower(substr(p_type, 1, 3)) END AS shortcut FROM part)"""
CLIP = """clip AS (SELECT event_id AS id, user_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 0 END AS type, 'text ' || (event_id % 400) AS text, (epoch_us(ts) // 1000)::BIGINT AS created_ms, event_id % 97 = 0 AS pinned, event_type = 'error' AS sensitive FROM events)"""


def ms(column: str):
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def us(column: str):
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def _dict(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("word"), F.col("p_size").alias("frequency"),
        F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand")).alias("locale"), F.when(F.col("p_partkey") % 3 == 0, F.lower(F.substring("p_type", 1, 3))).alias("shortcut"),
    )


def _clip(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    kind = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).otherwise(0)
    text = F.concat(F.lit("text "), (F.col("event_id") % 400).cast("string"))
    return e.select(F.col("event_id").alias("id"), "user_id", kind.alias("type"), text.alias("text"), ms("ts").alias("created_ms"), (F.col("event_id") % 97 == 0).alias("pinned"), (F.col("event_type") == "error").alias("sensitive"))


@query(f"WITH {DICT} SELECT id, word FROM dict WHERE contains(lower(word), 'l_r') OR word ILIKE '%RING%'")
def user_dict_contains(s, d):
    return _dict(s, d).filter(S.contains(F.col("word"), "l_r") | S.contains(F.col("word"), "RING")).select("id", "word")


@query(f"WITH {DICT} SELECT id, word, locale FROM dict WHERE word ILIKE '%o%' AND (locale = 'Brand#13' OR locale IS NULL)")
def user_dict_contains_locale(s, d):
    return _dict(s, d).filter(S.contains(F.col("word"), "o") & S.locale_or_any(F.col("locale"), "Brand#13")).select("id", "word", "locale")


@query(f"WITH {DICT} SELECT id, word, shortcut FROM dict WHERE shortcut = (SELECT min(shortcut) FROM dict)")
def user_dict_by_shortcut(s, d):
    rows = _dict(s, d)
    return rows.join(F.broadcast(rows.agg(F.min("shortcut").alias("shortcut"))), "shortcut").select("id", "word", "shortcut")


@query(f"WITH {DICT} SELECT id, word FROM dict WHERE locale IS NOT DISTINCT FROM NULL")
def user_dict_nullsafe_locale(s, d):
    return _dict(s, d).filter(F.col("locale").eqNullSafe(F.lit(None).cast("string"))).select("id", "word")


@query(f"WITH {DICT} SELECT a.id, a.word, a.locale FROM dict a WHERE a.word IN (SELECT word FROM dict WHERE frequency >= 25) AND (a.locale IS NOT DISTINCT FROM 'Brand#13' OR a.locale IS NULL)")
def user_dict_exact(s, d):
    rows = _dict(s, d)
    wanted = rows.filter("frequency >= 25").select("word").distinct()
    return rows.join(wanted, "word", "left_semi").filter(F.col("locale").eqNullSafe("Brand#13") | F.col("locale").isNull()).select("id", "word", "locale")


@query(f"WITH {DICT} SELECT DISTINCT locale FROM dict")
def distinct_locales(s, d):
    return _dict(s, d).select("locale").distinct()


@query(f"WITH {DICT} SELECT id, word, frequency, row_number() OVER (ORDER BY frequency DESC, word, id) AS position FROM dict WHERE word ILIKE '%o%' AND (locale IN ('Brand#13-x', 'Brand#13') OR locale IS NULL) QUALIFY position <= 100")
def system_dict_query(s, d):
    found = _dict(s, d).filter(S.contains(F.col("word"), "o") & S.locale_family(F.col("locale"), "Brand#13-x"))
    best = found.orderBy(F.col("frequency").desc(), "word", "id").limit(100)
    return best.select("id", "word", "frequency", F.row_number().over(Window.orderBy(F.col("frequency").desc(), "word", "id")).alias("position"))


@query("SELECT code, text, weight FROM (SELECT lower(p_type) AS code, p_name AS text, p_size AS weight, p_partkey FROM part WHERE starts_with(lower(p_type), (SELECT min(substr(lower(p_type), 1, 2)) FROM part))) ORDER BY code, weight DESC, text, p_partkey LIMIT 60")
def han_code_prefix(s, d):
    codes = table(s, d, "part").select(F.lower("p_type").alias("code"), F.col("p_name").alias("text"), F.col("p_size").alias("weight"), "p_partkey")
    prefix = codes.agg(F.min(F.substring("code", 1, 2)).alias("prefix"))
    found = codes.join(F.broadcast(prefix), F.col("code").startswith(F.col("prefix")))
    return found.orderBy("code", F.col("weight").desc(), "text", "p_partkey").limit(60).select("code", "text", "weight")


@query("SELECT lower(p_type) AS code, length(p_type)::INT AS n, rank() OVER (ORDER BY length(p_type) DESC) AS position FROM (SELECT DISTINCT p_type FROM part)")
def longest_codes(s, d):
    codes = table(s, d, "part").select("p_type").distinct()
    return codes.select(F.lower("p_type").alias("code"), F.length("p_type").alias("n"), F.rank().over(Window.orderBy(F.length("p_type").desc())).alias("position"))


@query(
    f"""WITH {DICT}, own AS (SELECT * FROM dict WHERE id % 2 = 0), sys AS (SELECT * FROM dict WHERE id % 2 = 1)
SELECT word, round(frequency / 255.0, 9) AS confidence, 'own' AS source, 'word' AS matched FROM own WHERE word ILIKE '%bol%' UNION ALL SELECT word, round(frequency / 255.0, 9), 'own', 'shortcut' FROM own WHERE shortcut = 'bol'
UNION ALL SELECT word, round(frequency / 255.0, 9), 'system', 'word' FROM sys WHERE word ILIKE '%bol%' UNION ALL SELECT word, round(frequency / 255.0, 9), 'system', 'shortcut' FROM sys WHERE shortcut = 'bol'"""
)
def multi_source_suggest(s, d):
    rows = _dict(s, d)
    return S.multi_source(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"), "bol").withColumn("confidence", F.round("confidence", 9))


@query(f"WITH {DICT} SELECT q.word, (EXISTS (SELECT 1 FROM dict x WHERE x.word = q.word AND x.id % 2 = 0) OR EXISTS (SELECT 1 FROM dict x WHERE x.shortcut = q.word)) AS known FROM (SELECT DISTINCT word FROM dict UNION SELECT DISTINCT shortcut FROM dict WHERE shortcut IS NOT NULL) q")
def membership_spell(s, d):
    rows = _dict(s, d)
    asked = rows.select("word").union(rows.select("shortcut").filter("shortcut IS NOT NULL")).distinct()
    known = rows.filter("id % 2 = 0").select("word").union(rows.select("shortcut").filter("shortcut IS NOT NULL")).distinct().withColumn("known", F.lit(True))
    return asked.join(known, "word", "left").select("word", F.coalesce("known", F.lit(False)).alias("known"))


@query(f"WITH {DICT} SELECT id, word FROM dict WHERE contains(lower(word), lower('UE B'))")
def dictionary_search(s, d):
    return _dict(s, d).filter(F.contains(F.lower("word"), F.lower(F.lit("UE B")))).select("id", "word")


@query(f"WITH {DICT} SELECT id, regexp_full_match(trim(word), '[^\\s;,]+') AND frequency BETWEEN 1 AND 40 AS plain, (regexp_full_match(trim(word), '[^\\s;,]+') AND frequency BETWEEN 1 AND 255 AND (shortcut IS NULL OR trim(shortcut) = '' OR regexp_full_match(trim(shortcut), '[^\\s;,]+'))) AS valid FROM dict")
def dictionary_validity(s, d):
    plain = F.trim("word").rlike("^[^\\s;,]+$") & F.col("frequency").between(1, 40)
    return _dict(s, d).select("id", plain.alias("plain"), S.valid_entry(F.col("word"), F.col("frequency"), F.col("shortcut")).alias("valid"))


@query(f"WITH {CLIP} SELECT id, type, text, created_ms, pinned FROM clip WHERE type IN (1, 2)")
def clipboard_type_filter(s, d):
    return _clip(s, d).filter(F.col("type").isin(1, 2)).select("id", "type", "text", "created_ms", "pinned")


@query(f"WITH {CLIP} SELECT id AS _id, text, created_ms AS creationTimestampMs, pinned AS isPinned, sensitive AS is_sensitive, false AS is_remote_device FROM clip")
def clipboard_migration(s, d):
    """An older table with two columns renamed and new ones given their defaults."""
    old = _clip(s, d).withColumnsRenamed({"id": "_id", "created_ms": "creationTimestampMs", "pinned": "isPinned"})
    return old.select("_id", "text", "creationTimestampMs", "isPinned", F.coalesce("sensitive", F.lit(False)).alias("is_sensitive"), F.lit(False).alias("is_remote_device"))


@query(f"WITH {CLIP} SELECT id, CASE WHEN id % 10 = 0 THEN 'new ' || id ELSE text END AS text FROM clip UNION ALL SELECT id + 1000000, 'new ' || (id + 1000000) FROM clip WHERE id % 1000 = 0")
def clipboard_upsert(s, d):
    old = _clip(s, d).select("id", "text")
    ids = old.filter("id % 10 = 0").select("id").union(old.filter("id % 1000 = 0").select((F.col("id") + 1_000_000).alias("id")))
    return S.upsert(old, ids.withColumn("text", F.concat(F.lit("new "), F.col("id").cast("string"))), ["id"])


@query(f"WITH {CLIP} SELECT id FROM clip WHERE NOT (id % 5 = 0 AND NOT pinned)")
def clipboard_delete_unpinned(s, d):
    return _clip(s, d).filter(~((F.col("id") % 5 == 0) & ~F.col("pinned"))).select("id")


@query(f"WITH {CLIP} SELECT id FROM clip WHERE id NOT IN (SELECT event_id FROM events WHERE event_type = 'view') AND type <> 2")
def clipboard_delete_list(s, d):
    gone = table(s, d, "events").filter("event_type = 'view'").select(F.col("event_id").alias("id"))
    return _clip(s, d).filter("type <> 2").join(gone, "id", "left_anti").select("id")


@query(f"WITH {CLIP} SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY created_ms DESC, id DESC) AS position FROM clip")
def history_sorted(s, d):
    return _clip(s, d).select("user_id", "id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("created_ms").desc(), F.col("id").desc())).alias("position"))


@query(f"WITH {CLIP} SELECT id, CASE WHEN pinned THEN 'pinned' WHEN {NOW_S}000 - created_ms < 300000 THEN 'recent' ELSE 'other' END AS bucket FROM clip")
def clipboard_buckets(s, d):
    return S.buckets(_clip(s, d), NOW_S * 1000).select("id", "bucket")


@query(f"WITH {CLIP} SELECT text, sensitive, max_by(id, (created_ms, id)) AS id, max(created_ms) AS created_ms, bool_or(pinned) AS pinned, count(*) AS copies FROM clip GROUP BY text, sensitive")
def clipboard_dedup(s, d):
    return S.moved_to_front(_clip(s, d))


@query(f"WITH {CLIP} SELECT user_id, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, pinned ORDER BY created_ms DESC, id DESC) AS r FROM clip) WHERE r <= 20 OR pinned")
def retention_limit(s, d):
    return S.retained(_clip(s, d), ["user_id"]).select("user_id", "id")


@query(f"WITH {CLIP} SELECT id FROM clip WHERE pinned OR {NOW_S}000 - created_ms < CASE WHEN sensitive THEN 86400000 ELSE 864000000 END")
def expiry_sweep(s, d):
    return S.unexpired(_clip(s, d), NOW_S * 1000, 864_000_000, 86_400_000).select("id")


@query(f"WITH {CLIP}, r AS (SELECT id + 1000000 AS id, type, text, created_ms, pinned, sensitive FROM clip WHERE id % 3 = 0 UNION ALL SELECT id + 2000000, type, text, created_ms + 1, pinned, sensitive FROM clip WHERE id % 50 = 0) SELECT id, text FROM r WHERE NOT EXISTS (SELECT 1 FROM clip c WHERE c.type = r.type AND c.text IS NOT DISTINCT FROM r.text AND c.created_ms = r.created_ms AND c.pinned = r.pinned AND c.sensitive = r.sensitive)")
def clipboard_restore(s, d):
    """Of a backup the items that the store does not have, ids aside."""
    clip = _clip(s, d).drop("user_id")
    backup = clip.filter("id % 3 = 0").withColumn("id", F.col("id") + 1_000_000).unionByName(clip.filter("id % 50 = 0").withColumn("id", F.col("id") + 2_000_000).withColumn("created_ms", F.col("created_ms") + 1))
    same = [backup[c].eqNullSafe(clip[c]) for c in ("type", "text", "created_ms", "pinned", "sensitive")]
    return backup.join(clip, same, "left_anti").select("id", "text")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type")
def consecutive_dedup(s, d):
    return S.not_repeated(table(s, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


@query("SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_wins(s, d):
    return S.latest(table(s, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query(f"SELECT event_id FROM events WHERE epoch(ts) >= {NOW_S} - 86400 AND epoch(ts) < {NOW_S}")
def suggestion_timeout(s, d):
    age = F.lit(NOW_S) - ms("ts") / 1000.0
    return table(s, d, "events").filter((age <= 86400) & (age > 0)).select("event_id")


@query("SELECT a.event_id FROM events a JOIN (SELECT user_id, max_by(event_type, event_id) AS live FROM events GROUP BY user_id) b ON a.user_id = b.user_id AND a.event_type = b.live")
def stale_guard(s, d):
    """Requests whose recorded token is still the live one of their session."""
    events = table(s, d, "events")
    live = events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"))
    return events.join(live, ["user_id", "event_type"]).select("event_id")


FREC = f"frec AS (SELECT user_id % 20 AS owner, event_type || '-' || (event_id % 40) AS item, sum(pow(2.0, -(({NOW_S} - epoch_us(ts) / 1000000.0::DOUBLE) / 86400.0::DOUBLE) / 30.0::DOUBLE)) AS score FROM events GROUP BY ALL)"
FREC_TOP = f"{FREC}, top AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY round(score, 9) DESC, item) AS rank FROM frec QUALIFY rank <= 60)"


def _frecency(s: SparkSession, d: str) -> DataFrame:
    uses = table(s, d, "events").select((F.col("user_id") % 20).alias("owner"), F.concat_ws("-", "event_type", (F.col("event_id") % 40).cast("string")).alias("item"), (us("ts") / 1e6).alias("used_s"))
    return S.frecency(uses, ["owner"], "item", NOW_S)


@query(f"WITH {FREC_TOP} SELECT owner, item, round(score, 5) AS score, rank FROM top")
def frecency_top(s, d):
    return _frecency(s, d).withColumn("score", F.round("score", 5))


@query(f"WITH {FREC_TOP}, few AS (SELECT * FROM top WHERE rank <= 5), seed AS (SELECT 'view-' || i AS item, i AS seed FROM range(1, 30) t(i)), u AS (SELECT owner, item, 0 AS tier, rank AS pos FROM few UNION ALL SELECT owner, item, 1, seed FROM (SELECT DISTINCT owner FROM few), seed WHERE NOT EXISTS (SELECT 1 FROM few f WHERE f.owner = few.owner AND f.item = seed.item)) SELECT owner, item, row_number() OVER (PARTITION BY owner ORDER BY tier, pos) AS position FROM u QUALIFY position <= 12".replace("(SELECT DISTINCT owner FROM few), seed WHERE NOT EXISTS (SELECT 1 FROM few f WHERE f.owner = few.owner", "(SELECT DISTINCT owner FROM few) o, seed WHERE NOT EXISTS (SELECT 1 FROM few f WHERE f.owner = o.owner"))
def frecency_padded(s, d):
    few = _frecency(s, d).filter("rank <= 5")
    seeds = s.range(1, 30).select(F.concat(F.lit("view-"), F.col("id").cast("string")).alias("item"), F.col("id").alias("seed"))
    return S.padded(few, seeds, ["owner"], "item", 12)


@query("SELECT user_id, event_type, max(ts) AS last_used, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, event_type) AS position FROM events GROUP BY user_id, event_type")
def recent_items(s, d):
    """Move-to-front history: each item once, the most recent first."""
    last = table(s, d, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("last_used"))
    return last.withColumn("position", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("last_used").desc(), "event_type")))


@query("SELECT event_id, floor(epoch(ts) / 86400)::INT AS day FROM events")
def day_buckets(s, d):
    return table(s, d, "events").select("event_id", F.floor(ms("ts") / 86_400_000).cast("int").alias("day"))


@query("SELECT p_partkey, p_type AS code, count(*) OVER (PARTITION BY p_type) - row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) + 1 AS weight FROM part")
def code_weights(s, d):
    """Weights of a code table: how many entries of the code are left, in order."""
    w = Window.partitionBy("p_type")
    return table(s, d, "part").select("p_partkey", F.col("p_type").alias("code"), (F.count(F.lit(1)).over(w) - F.row_number().over(w.orderBy("p_partkey")) + 1).alias("weight"))


@query(f"WITH {DICT} SELECT id, ' w=' || word || ';f=' || frequency || ';l=' || coalesce(locale, 'null') || coalesce(';s=' || shortcut, '') AS line FROM dict")
def combined_list_export(s, d):
    from lexmill.sources.text_tables import combined_lines

    return combined_lines(_dict(s, d))


@query(f"WITH {DICT} SELECT word, frequency, locale, shortcut FROM dict")
def combined_list_round_trip(s, d):
    """Export to lines and import them again."""
    from lexmill.sources.text_tables import combined_lines, parse_combined

    return parse_combined(combined_lines(_dict(s, d)).select(F.col("line").alias("value"))).select("word", "frequency", "locale", "shortcut")
