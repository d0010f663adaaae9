"""Frequency lexicons built from text, and point, prefix and continuation queries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.config import DEFAULT, FIRST_LETTERS, SECOND_LETTERS, Config

WORD_PATTERN = "[\\p{L}']+"


def key(text: Column) -> Column:
    """The form under which words are stored and looked up (text is taken to be NFC; see functions.text.nfc)."""
    return F.replace(F.lower(text), F.lit("’"), F.lit("'"))


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(key(text), F.lit(WORD_PATTERN), F.lit(0))


def tokens(docs: DataFrame, lanes: tuple[str, ...] | None = None) -> DataFrame:
    """doc_id, lane, pos (from 1) and word of every word of ``docs`` (doc_id, text, lang)."""
    if lanes is not None:
        docs = docs.filter(F.col("lang").isin(*lanes))
    return docs.select("doc_id", F.col("lang").alias("lane"), F.posexplode(word_array(F.col("text"))).alias("at", "word")).select("doc_id", "lane", (F.col("at") + 1).alias("pos"), "word")


def unigrams(words: DataFrame) -> DataFrame:
    return words.groupBy("lane", "word").agg(F.count(F.lit(1)).alias("frequency"))


def bigrams(docs: DataFrame, lanes: tuple[str, ...] | None = None, after: DataFrame | None = None) -> DataFrame:
    """Pairs of neighbours; each document's pairs are made from its own row, so only counts are shuffled.

    With ``after`` (w1, each once) only pairs whose first word is one of these are counted."""
    if lanes is not None:
        docs = docs.filter(F.col("lang").isin(*lanes))
    pairs = docs.select(F.col("lang").alias("lane"), word_array(F.col("text")).alias("w")).filter(F.size("w") > 1)
    pairs = pairs.select("lane", F.explode(F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("w1"), F.slice("w", 2, F.size("w") - 1).alias("w2"))).alias("p"))
    pairs = pairs.select("lane", "p.w1", "p.w2")
    if after is not None:
        pairs = pairs.join(after, "w1", "left_semi")
    return pairs.groupBy("lane", "w1", "w2").agg(F.count(F.lit(1)).alias("frequency"))


def totals(unigram: DataFrame) -> DataFrame:
    return unigram.groupBy("lane").agg(F.sum("frequency").alias("total"))


def lookup(requests: DataFrame, unigram: DataFrame) -> DataFrame:
    """Frequency of each requested word in each lane that has it; null where none does."""
    return requests.join(unigram, "word", "left")


def lookup_pairs(requests: DataFrame, bigram: DataFrame) -> DataFrame:
    return requests.join(bigram, ["w1", "w2"], "left")


def top(rows: DataFrame, by: list[str], limit: int, rank: str = "rank") -> DataFrame:
    """The first ``limit`` rows of each group by frequency, then word."""
    order = Window.partitionBy(*by).orderBy(F.col("frequency").desc(), F.col("word"))
    return rows.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= limit)


def completions(prefixes: DataFrame, unigram: DataFrame, limit: int, config: Config = DEFAULT, length: int = 3, scan_limit: bool = True) -> DataFrame:
    """The most frequent words that start with each prefix (prefix), longer prefixes than ``length`` included.

    At most ``scan_limit`` words, in byte order, are looked at for a prefix.  The join is on the first
    ``length`` letters; shorter prefixes are first completed to all heads of that length."""
    heads = unigram.select(F.substring("word", 1, length).alias("head")).distinct()
    short = prefixes.filter(F.length("prefix").between(1, length - 1)).join(heads, F.col("head").startswith(F.col("prefix")))
    long = prefixes.filter(F.length("prefix") >= length).withColumn("head", F.substring("prefix", 1, length))
    found = short.unionByName(long).join(unigram.withColumn("head", F.substring("word", 1, length)), "head").filter(F.col("word").startswith(F.col("prefix"))).drop("head")
    if scan_limit:
        scan = Window.partitionBy("prefix", "lane").orderBy("word")
        found = found.withColumn("_scan", F.row_number().over(scan)).filter(F.col("_scan") <= config.scan_limit).drop("_scan")
    return top(found, ["prefix", "lane"], limit)


def continuations(previous: DataFrame, bigram: DataFrame, limit: int, config: Config = DEFAULT, scan_limit: bool = True) -> DataFrame:
    """The most frequent second words after each first word (w1), of the first ``scan_limit`` in byte order if that is on."""
    found = previous.join(bigram, "w1").withColumnRenamed("w2", "word")
    if scan_limit:
        scan = Window.partitionBy("w1", "lane").orderBy("word")
        found = found.withColumn("_scan", F.row_number().over(scan)).filter(F.col("_scan") <= config.scan_limit).drop("_scan")
    return top(found, ["w1", "lane"], limit)


def children(unigram: DataFrame, depth: int) -> DataFrame:
    """Every node of the lexicon's trie at ``depth`` with its children: how many words and tokens each has,
    and whether the node itself is a word (child '')."""
    prefix, child = F.substring("word", 1, depth), F.substring("word", depth + 1, 1)
    return unigram.filter(F.length("word") >= depth).groupBy("lane", prefix.alias("prefix"), child.alias("child")).agg(F.count(F.lit(1)).alias("words"), F.sum("frequency").alias("tokens"))


def calibration(unigram: DataFrame, per_bucket: int = 12, config: Config = DEFAULT) -> DataFrame:
    """lane, mu and sigma of the log frequencies of the most frequent words of each two-letter bucket."""
    bucket = F.substring("word", 1, 2)
    sampled = unigram.filter(F.substring("word", 1, 1).isin(*FIRST_LETTERS) & F.substring("word", 2, 1).isin(*SECOND_LETTERS)).withColumn("bucket", bucket)
    logs = top(sampled, ["lane", "bucket"], per_bucket).withColumn("x", F.log(F.col("frequency") + config.add_k))
    few = F.count("x") < 4
    return logs.groupBy("lane").agg(
        F.when(few, 0.0).otherwise(F.avg("x")).alias("mu"),
        F.when(few, 1.0).otherwise(F.greatest(F.stddev_pop("x"), F.lit(config.sigma_floor))).alias("sigma"),
        F.count("x").alias("samples"),
    )
