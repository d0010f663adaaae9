"""Text formats: combined dictionary lists, curated vocabularies, word imports, event logs and emoji lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def combined_lines(words: DataFrame) -> DataFrame:
    """id and line of each dictionary entry (id, word, frequency, locale, shortcut)."""
    line = F.concat(F.lit(" w="), "word", F.lit(";f="), F.col("frequency").cast("string"), F.lit(";l="), F.coalesce("locale", F.lit("null")), F.coalesce(F.concat(F.lit(";s="), F.col("shortcut")), F.lit("")))
    return words.select("id", line.alias("line"))


def parse_combined(lines: DataFrame) -> DataFrame:
    """word, frequency, locale and shortcut of lines of key=value pairs (value); bad entries are left out."""
    pairs = F.map_from_entries(F.transform(F.split("value", ";"), lambda p: F.struct(F.lower(F.trim(F.substring_index(p, "=", 1))), F.trim(F.substring_index(p, "=", -1)))))
    rows = lines.withColumn("_m", pairs)
    get = lambda *names: F.nullif(F.coalesce(*[F.try_element_at("_m", F.lit(n)) for n in names]), F.lit(""))
    locale = get("l", "locale")
    out = rows.select(get("w", "word").alias("word"), F.expr("try_cast(coalesce(try_element_at(_m, 'f'), try_element_at(_m, 'freq')) AS int)").alias("frequency"), F.when(~locale.isin("all", "null"), locale).alias("locale"), get("s", "shortcut").alias("shortcut"))
    return out.filter(F.col("word").isNotNull() & F.col("frequency").between(1, 255))


def read_combined(spark: SparkSession, path: str) -> DataFrame:
    """A combined list without its header line."""
    return parse_combined(spark.read.text(path).filter(~F.col("value").startswith("dictionary=")))


def curated(lines: DataFrame, value: str = "value", order: str = "line_no", count: int = 8) -> DataFrame:
    """word and frequency of a curated vocabulary: no blanks, no comments, the first spelling of each word."""
    rows = lines.select(F.trim(value).alias("word"), order).filter((F.col("word") != "") & ~F.col("word").startswith("#"))
    first = rows.groupBy(F.lower("word").alias("_k")).agg(F.min_by("word", order).alias("word"))
    return first.select("word", F.lit(count).alias("frequency"))


def learnable(word: Column, longest: int = 64) -> Column:
    """Words that may be learned: a letter, no white space, control character or emoji, not too long."""
    emoji = "[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{2300}-\\x{23FF}\\x{A9}-\\x{AE}\\x{203C}\\x{2049}\\x{2122}\\x{2139}\\x{3030}-\\x{303D}\\x{3297}-\\x{3299}]"
    return word.rlike("\\p{L}") & ~word.rlike("[\\s\\p{Cc}]") & ~word.rlike(emoji) & F.length(word).between(1, longest)


def importable(lines: DataFrame, value: str = "value") -> DataFrame:
    """Distinct words of a plain word list: comments and words that cannot be learned are left out."""
    word = F.trim(value)
    return lines.select(word.alias("word")).filter((F.col("word") != "") & ~F.col("word").startswith("#") & learnable(F.col("word"))).distinct()


def merge_import(model: DataFrame, words: DataFrame, tombstones: DataFrame, seed: int = 3) -> DataFrame:
    """Personal words (word, count, explicit) with imported ones seeded, unless they were deleted."""
    fresh = words.join(tombstones.select("word"), "word", "left_anti").select("word", F.lit(seed).cast("bigint").alias("seed"))
    both = model.join(fresh, "word", "full_outer")
    return both.select("word", F.greatest(F.coalesce("count", F.lit(0)), F.coalesce("seed", F.lit(0))).alias("count"), (F.coalesce("explicit", F.lit(False)) | F.col("seed").isNotNull()).alias("explicit"))


_HELD = "\ue000"


# ---- event log lines: version, day, kind and fields, separated by tabs
def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for a, b in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def unescape(text: Column) -> Column:
    """The reverse of ``escape``; a private character keeps the place of escaped backslashes."""
    out = F.replace(text, F.lit("\\\\"), F.lit(_HELD))
    for a, b in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), (_HELD, "\\")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def event_lines(events: DataFrame, *keep: str) -> DataFrame:
    """Lines of events (day, kind, a, b, c): the fields that the kind has, escaped; ``keep`` are columns beside them."""
    fields = F.when(F.col("kind") == "wt", F.array("a")).when(F.col("kind").isin("sa", "cr"), F.array("a", "b")).otherwise(F.array("a", F.coalesce("b", F.lit("")), "c"))
    parts = F.concat(F.array(F.lit("1"), F.col("day").cast("string"), F.col("kind")), F.transform(fields, escape))
    return events.select(*keep, F.array_join(parts, "\t").alias("value"))


def parse_events(lines: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Events of log lines: day, kind, fields and ``ok``; header lines are left out, bad lines have ok false."""
    f = F.split(F.col(value), "\t")
    rows = lines.filter(~F.col(value).startswith("#gen\t")).select("*", f.alias("_f"))
    kind, size = F.get(F.col("_f"), 2), F.size("_f")
    at = lambda i: unescape(F.get(F.col("_f"), i))
    number = lambda i: F.expr(f"try_cast(get(_f, {i}) AS double)")
    day = F.expr("try_cast(get(_f, 1) AS int)")
    shape = (
        F.when(kind == "wc", (size == 6) & (at(3) != "") & F.get(F.col("_f"), 5).isin("is", "en", "un"))
        .when(kind.isin("sa", "cr"), (size == 5) & (at(3) != "") & (at(4) != ""))
        .when(kind == "wt", (size == 4) & (at(3) != ""))
        .when(kind == "ts", (size == 6) & (F.length(at(3)) == 1) & number(4).isNotNull() & number(5).isNotNull())
    )
    ok = F.coalesce((F.get(F.col("_f"), 0) == "1") & day.isNotNull() & shape, F.lit(False))
    return rows.select(
        *keep, day.alias("day"), kind.alias("kind"), at(3).alias("a"), F.nullif(F.when(size > 4, at(4)), F.lit("")).alias("b"), F.when(size > 5, F.get(F.col("_f"), 5)).alias("c"),
        F.when(kind == "ts", number(4)).alias("dx"), F.when(kind == "ts", number(5)).alias("dy"), ok.alias("ok"),
    )


def append_events(events: DataFrame, path: str) -> None:
    """Add events to the log in ``path``, in files of their own: a writer that broke off leaves no half line that a
    later append could run into."""
    event_lines(events.filter(learnable(F.col("a")) | (F.col("kind") == "ts"))).write.mode("append").text(path)


def truncated(lines: DataFrame, after_day: int) -> DataFrame:
    """The lines of a log's next generation: well-formed events after the day that a snapshot already holds."""
    kept = parse_events(lines).filter(F.col("ok") & (F.col("day") > after_day))
    return event_lines(kept.select("day", "kind", "a", "b", "c"))


def emoji_table(lines: DataFrame, value: str = "value", order: str = "line_no") -> DataFrame:
    """category, emoji, name, keywords and base of an emoji list: [category] lines, ';' fields, '|' keywords,
    indented variants that take the name of the row above.  The running category is a window over one file."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("category", F.last(F.nullif(F.regexp_extract(value, "^\\[(.+)\\]$", 1), F.lit("")), ignorenulls=True).over(w))
    rows = rows.filter(~F.col(value).rlike("^\\[.+\\]$") & (F.trim(value) != "")).withColumn("_f", F.split(F.trim(value), ";")).filter(F.size("_f") == 3)
    is_base = ~F.col(value).startswith("\t")
    rows = rows.withColumn("base", F.last(F.when(is_base, F.get("_f", 0)), ignorenulls=True).over(w)).withColumn("name", F.last(F.when(is_base, F.get("_f", 1)), ignorenulls=True).over(w))
    return rows.select("category", F.get("_f", 0).alias("emoji"), "name", F.split(F.get("_f", 2), "\\|").alias("keywords"), "base")
