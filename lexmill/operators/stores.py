"""Table stores: dictionary queries, clipboard history rules, frecency, expiry and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.config import DEFAULT, Config


# ---- dictionaries (id, word, frequency, locale, shortcut)
def contains(word: Column, query: str) -> Column:
    """Case-insensitive substring test; % and _ in the query are ordinary characters."""
    escaped = query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return word.ilike(f"%{escaped}%")


def locale_or_any(locale: Column, wanted: str | None) -> Column:
    """``locale = wanted OR locale IS NULL`` in three-valued logic: a null wish finds the null locales."""
    return (locale == F.lit(wanted).cast("string")) | locale.isNull()


def locale_family(locale: Column, tag: str) -> Column:
    """The tag itself, its language, or no locale."""
    return locale.isin(tag, tag.split("-")[0]) | locale.isNull()


def multi_source(own: DataFrame, system: DataFrame, query: str) -> DataFrame:
    """Matches by word and by shortcut in both dictionaries, duplicates kept; confidence is frequency / 255."""
    parts = []
    for name, d in (("own", own), ("system", system)):
        for by, test in (("word", contains(F.col("word"), query)), ("shortcut", F.col("shortcut") == query)):
            parts.append(d.filter(test).select("word", (F.col("frequency") / 255.0).alias("confidence"), F.lit(name).alias("source"), F.lit(by).alias("matched")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def valid_entry(word: Column, frequency: Column, shortcut: Column) -> Column:
    """Words and shortcuts without white space, semicolon or comma; frequencies of 1 to 255."""
    text = "^[^\\s;,]+$"
    return F.coalesce(F.trim(word).rlike(text), F.lit(False)) & F.coalesce(frequency.between(1, 255), F.lit(False)) & (shortcut.isNull() | (F.trim(shortcut) == "") | F.trim(shortcut).rlike(text))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` in place of the rows of ``old`` with null-safe equal keys, and the rest of ``old``."""
    match = [old[k].eqNullSafe(new[k]) for k in keys]
    return old.join(new.select(*keys), match, "left_anti").unionByName(new)


# ---- clipboard (id, type, text, created_ms, pinned, sensitive)
def buckets(items: DataFrame, now_ms: int, recent_ms: int = 300_000) -> DataFrame:
    age = F.lit(now_ms) - F.col("created_ms")
    return items.withColumn("bucket", F.when(F.col("pinned"), "pinned").when(age < recent_ms, "recent").otherwise("other"))


def moved_to_front(items: DataFrame) -> DataFrame:
    """One item for each text and sensitivity: the newest, pinned if any of them was."""
    newest = F.struct("created_ms", "id")
    return items.groupBy("text", "sensitive").agg(F.max_by("id", newest).alias("id"), F.max("created_ms").alias("created_ms"), F.bool_or("pinned").alias("pinned"), F.count(F.lit(1)).alias("copies"))


def retained(items: DataFrame, by: list[str], limit: int = DEFAULT.retention) -> DataFrame:
    """Pinned items and the newest others of each owner."""
    order = Window.partitionBy(*by, "pinned").orderBy(F.col("created_ms").desc(), F.col("id").desc())
    return items.withColumn("_r", F.row_number().over(order)).filter((F.col("_r") <= limit) | F.col("pinned")).drop("_r")


def unexpired(items: DataFrame, now_ms: int, keep_ms: int = 1_200_000, sensitive_ms: int = 20_000) -> DataFrame:
    age = F.lit(now_ms) - F.col("created_ms")
    return items.filter(F.col("pinned") | (age < F.when(F.col("sensitive"), sensitive_ms).otherwise(keep_ms)))


def not_repeated(items: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before."""
    w = Window.partitionBy(*by).orderBy(*order)
    return items.withColumn("_p", F.lag(value).over(w)).filter(~F.col(value).eqNullSafe(F.col("_p")) | F.col("_p").isNull()).drop("_p")


def latest(requests: DataFrame, by: list[str], generation: str) -> DataFrame:
    """The request of the highest generation of each key."""
    return requests.groupBy(*by).agg(F.max_by(F.struct(*[c for c in requests.columns if c not in by]), generation).alias("_r")).select(*by, "_r.*")


# ---- frecency
def decay(age_days: Column, half_life: float = DEFAULT.frecency_half_life_days) -> Column:
    return F.pow(F.lit(2.0), -age_days / half_life)


def frecency(uses: DataFrame, by: list[str], item: str, now_s: int, config: Config = DEFAULT) -> DataFrame:
    """Sum of decayed uses of each item, the best ``frecency_entries`` of each owner.

    Decaying the running score at each use and adding one gives this sum, whatever the order."""
    age = (F.lit(now_s) - F.col("used_s")) / 86400.0
    scores = uses.groupBy(*by, item).agg(F.sum(decay(age, config.frecency_half_life_days)).alias("score"))
    order = Window.partitionBy(*by).orderBy(F.round("score", 9).desc(), F.col(item))
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= config.frecency_entries)


def padded(scores: DataFrame, seeds: DataFrame, by: list[str], item: str, count: int) -> DataFrame:
    """The best ``count`` of each owner, filled up from ``seeds`` (item, seed) in their order."""
    owners = scores.select(*by).distinct()
    own = scores.select(*by, item, F.lit(0).alias("tier"), F.col("rank").alias("at"))
    rest = owners.join(F.broadcast(seeds)).join(scores.select(*by, item), [*by, item], "left_anti").select(*by, item, F.lit(1).alias("tier"), F.col("seed").alias("at"))
    order = Window.partitionBy(*by).orderBy("tier", "at")
    return own.unionByName(rest).withColumn("position", F.row_number().over(order)).filter(F.col("position") <= count).drop("tier", "at")


def item_history(operations: DataFrame, recent: int, by: str = "user_id") -> DataFrame:
    """Pinned and recent items of each user after a log of operations (by, item, at, op: use, pin, unpin, remove).

    An item's operations before its last removal do not count.  It is pinned if its last pin or unpin is a pin;
    pinned items stand in the order they were last pinned or used in, newest first, and recent ones likewise, up
    to ``recent`` of them."""
    gone = operations.filter("op = 'remove'").groupBy(by, "item").agg(F.max("at").alias("_gone"))
    live = operations.filter("op <> 'remove'").join(gone, [by, "item"], "left").filter("_gone IS NULL OR at > _gone")
    state = live.groupBy(by, "item").agg(F.max("at").alias("at"), F.max(F.when(F.col("op") == "pin", F.col("at"))).alias("_pin"), F.max(F.when(F.col("op") == "unpin", F.col("at"))).alias("_unpin"))
    pinned = F.col("_pin").isNotNull() & (F.col("_unpin").isNull() | (F.col("_pin") > F.col("_unpin")))
    state = state.select(by, "item", "at", pinned.alias("pinned"))
    order = Window.partitionBy(by, "pinned").orderBy(F.col("at").desc(), "item")
    return state.withColumn("position", F.row_number().over(order)).filter(F.col("pinned") | (F.col("position") <= recent)).select(by, "item", "pinned", "position")


def inserted(files: DataFrame, more: DataFrame, key: str = "id") -> DataFrame:
    """``files`` with the rows of ``more``, which replace rows of the same key."""
    return files.join(more.select(key), key, "left_anti").unionByName(more)


def first_key(table: DataFrame, wanted: DataFrame, key: str, value: str) -> DataFrame:
    """For each wanted value the first key that has it, null if none has."""
    return wanted.join(table.groupBy(value).agg(F.min(key).alias(key)), value, "left")
