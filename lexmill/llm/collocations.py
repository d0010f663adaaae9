"""Phrases that are more than their parts, by suffix-sigma: truncated suffixes, sorted, counted by one stack.

Within a piece (what lies between two marks or line ends) every place starts a suffix of at most ``max_n`` words.
The suffixes go to tasks by language, first word and, since a hot first word may start a third of them, the words
after it: in ranges of one order, never by the word alone.  Each task reads its range in reverse order, in which all
suffixes that begin with a phrase follow each other, and a stack of the phrases now open counts all of them in one
pass.  Only the phrases open at a range's two ends may go on in another one; their counts are added up afterwards.

Words that a language has less than ``least`` times are in no phrase that counts, so suffixes end before them; a
fixed-size bitmap says which words may be frequent (a word that only shares a bit costs time, not correctness).
Suffixes that repeat within a chunk of texts travel once, with their number, and each language's most frequent words
(``CODED`` over all languages) in two or three bytes that begin with one that UTF-8 never has; others are spelled and
begin with "!" and end with a space.  No word's bytes begin another's, so words and bytes agree on what begins with a
phrase and on the order.  A row is one value: the language, the words, and behind them how often the chunk has them.
Bounds of the ranges come from a sample of texts; they say where rows go, never what is counted.

Parts of a phrase are at least as frequent as it, so all their counts are there once phrases below ``least`` are
gone: they are joined by language and phrase.  Products of counts are decimals of 38 digits, exact up to 10^16 words.

Null texts have no words, a null language counts as ``und``; repeated rows count each; pieces of any length are taken
whole; phrases of equal score go by frequency, then by the bytes of the phrase; other columns are ignored, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import Stored, cut
from lexmill.shipping import ship

#: Bits of the map of words that may be frequent: 2 MB.
BITMAP_BITS = 24
#: Bytes of text whose suffixes are put together before they travel.
CHUNK_BYTES = 8 << 20
#: Parts that a language's candidates are ranked in first.
RANK_PARTS = 64
#: Words that have a code: 1024 of a language in two bytes, the others in three.
CODED = 65_536
_SHORT = 1024
#: Languages that have a code of one byte; others are spelled.
CODED_LANGS = 200
#: Words of the texts, and suffixes for each range, that bounds of ranges are taken from.
SAMPLE_WORDS, SAMPLED = 3_000_000, 50
#: Ends the words of a suffix; no word's bytes begin with it or with less.
_STOP = 0x09
_MARK = b","
#: Everything that ends a piece becomes one sign that no word holds.
_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", _MARK * 10)


def tokens(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8, A-Z lower-cased, with a mark between pieces."""
    if not text:
        return []
    return text.encode("utf-8", "surrogatepass").lower().translate(_ENDS).replace(_MARK, b" , ").split()


def _by_lang(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, list[bytes]]]:
    """Language and tokens of chunks of texts; a mark stands between texts."""
    held: dict[str, list[bytes]] = {}
    sizes: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            text = text.as_py()
            own = held.setdefault(lang, [])
            own += tokens(text)
            own.append(_MARK)
            sizes[lang] += len(text or "")
            if sum(sizes.values()) >= most:
                lang = max(sizes, key=sizes.get)
                del sizes[lang]
                yield lang, held.pop(lang)
    yield from held.items()


def _count_words(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, found in _by_lang(batches, most):
            counts = Counter(found)
            del counts[_MARK]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array([w.decode("utf-8", "surrogatepass") for w in counts], pa.string()), pa.array(counts.values(), pa.int64())], names=["lang", "word", "n"])

    return run


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n: how often each language has each word."""
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_count_words(CHUNK_BYTES), "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, least: int) -> DataFrame:
    """lang, word and n of words with ``least`` occurrences, and a row without word for all others of a language."""
    return counts.groupBy("lang", F.when(F.col("n") >= least, F.col("word")).alias("word")).agg(F.sum("n").alias("n"))


def frequent_bitmap(words: DataFrame) -> bytes:
    """A bit for the hash of each of ``frequent_words``; at most 512 rows of 4 kB come to the driver."""
    at = F.pmod(F.xxhash64("lang", "word"), F.lit(1 << BITMAP_BITS)) + 1  # the functions' first bucket holds 1 to 32768
    bits = words.filter("word IS NOT NULL").select(at.alias("at"))
    blocks = bits.groupBy(F.bitmap_bucket_number("at").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = bytearray((1 << BITMAP_BITS) // 8)
    for block, raw in blocks.collect():
        out[(block - 1) * len(raw) : block * len(raw)] = raw
    return bytes(out)


def may_be_frequent(lang: str, words: list[bytes], bitmap: np.ndarray) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), seed=42)
    at = np.fromiter((xxhash.xxh64_intdigest(w, seed=seed) & ((1 << BITMAP_BITS) - 1) for w in words), np.int64, len(words))
    return bitmap[at >> 3] >> (at & 7) & 1 > 0


def codes(words: DataFrame) -> dict[str, list[bytes]]:
    """The words of each language that have a code, by number: the ``CODED`` most frequent ones."""
    top = words.filter("word IS NOT NULL").orderBy(F.desc("n"), "lang", "word").limit(CODED)
    out: dict[str, list[bytes]] = {}
    for lang, word, _ in top.collect():
        out.setdefault(lang, []).append(word.encode("utf-8", "surrogatepass"))
    return out


def _code(k: int) -> bytes:
    if k < _SHORT:
        return bytes((0xF8 + (k >> 8), k & 255))
    k -= _SHORT
    return bytes((0xFC + (k >> 16), k >> 8 & 255, k & 255))


def lang_codes(coded: dict[str, list[bytes]]) -> dict[str, bytes]:
    """One byte for each of the first languages that have coded words."""
    return {lang: bytes((k,)) for k, lang in enumerate(sorted(coded)[:CODED_LANGS], 1)}


def _lang_bytes(lang: str, known: dict[str, bytes]) -> bytes:
    """A language's code, or 0, its length in four bytes and its letters; none begins another."""
    raw = lang.encode("utf-8", "surrogatepass")
    return known.get(lang) or b"\0" + len(raw).to_bytes(4, "big") + raw


def _suffixes(bitmap: bytes, coded: dict[str, list[bytes]], langs: dict[str, bytes], max_n: int, most: int, bounds: list[bytes] | None = None):
    """Distinct truncated suffixes of each chunk with their number, and the range that each goes to."""
    bits = np.frombuffer(bitmap, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = {lang: {w: _code(k) for k, w in enumerate(words)} for lang, words in coded.items()}
        for lang, found in _by_lang(batches, most):
            vocabulary = sorted(set(found) - {_MARK})
            frequent = [w for w, f in zip(vocabulary, may_be_frequent(lang, vocabulary, bits).tolist()) if f]
            if not frequent:
                continue
            own = written.get(lang, {})
            spelling = {w: own.get(w) or b"!" + w + b" " for w in frequent}
            frequent.sort(key=spelling.get)  # so that suffixes come in the order of their bytes
            spelled = pa.array([b""] + [spelling[w] for w in frequent], pa.binary())
            code = {w: k for k, w in enumerate(frequent, 1)}
            ids = np.fromiter((code.get(w, 0) for w in found), np.int64, len(found))
            ids = np.concatenate([ids, np.zeros(max_n, np.int64)])
            columns = [ids[: len(found)]]
            for k in range(1, max_n):  # a suffix ends with its piece, and before a word that is not frequent
                columns.append(np.where(columns[-1] > 0, ids[k : len(found) + k], 0))
            keep = columns[0] > 0
            columns = [c[keep] for c in columns]
            width = int(len(frequent)).bit_length()
            per, keys = 63 // width, []
            for a in range(0, max_n, per):
                key = np.zeros(len(columns[0]), np.int64)
                for c in columns[a : a + per]:
                    key = key << width | c
                keys.append(key)
            order = np.lexsort(keys[::-1])
            new = np.zeros(len(order), bool)
            new[:1] = True
            for key in keys:
                new[1:] |= key[order][1:] != key[order][:-1]
            first = np.flatnonzero(new)
            counts = np.diff(np.append(first, len(order)))
            for a in range(0, len(first), 1 << 16):
                rows = order[first[a : a + (1 << 16)]]
                number = counts[a : a + (1 << 16)]
                ends = pa.array([bytes((_STOP,)) + n.to_bytes((n.bit_length() + 7) // 8, "big") for n in range(1, 257)], pa.binary()).take(pa.array(np.minimum(number, 256) - 1))
                if number.max() > 256:
                    ends = pa.array([bytes((_STOP,)) + n.to_bytes((n.bit_length() + 7) // 8, "big") for n in number.tolist()], pa.binary())
                begin = pa.scalar(_lang_bytes(lang, langs), pa.binary())
                suffixes = pc.binary_join_element_wise(begin, *(spelled.take(pa.array(c[rows])) for c in columns), ends, b"")
                stops = [bisect.bisect_left(range(len(suffixes)), bound, key=lambda k: suffixes[k].as_py()) for bound in bounds or []]
                to = np.repeat(np.arange(len(stops) + 1), np.diff([0, *stops, len(suffixes)]))
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), suffixes], names=["range", "suffix"])

    return run


def word_ends(raw: np.ndarray, at: np.ndarray, max_n: int) -> np.ndarray:
    """For suffixes whose words begin at ``at``, where the first, second, ... word ends; where there are no more, the end
    of the last one."""
    spaces, ends = np.append(np.flatnonzero(raw == 0x20), len(raw) - 1), []
    for _ in range(max_n):
        lead = raw[at]
        after = np.where(lead >= 0xFC, at + 3, np.where(lead >= 0xF8, at + 2, at))
        long = np.flatnonzero((lead < 0xF8) & (lead != _STOP))
        after[long] = spaces[np.searchsorted(spaces, at[long])] + 1  # a spelled word
        at = after
        ends.append(at)
    return np.stack(ends)


_WINDOW = np.arange(32)


def _shared_bytes(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes each row begins with that the one before it begins with too."""
    size = np.diff(offsets)
    limit = np.zeros(len(size), np.int64)
    limit[1:] = np.minimum(size[1:], size[:-1])
    head = raw[np.minimum(offsets[:-1, None] + _WINDOW, len(raw) - 1)]
    out = np.zeros(len(size), np.int64)
    differ = head[1:] != head[:-1]
    out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), len(_WINDOW))
    out = np.minimum(out, limit)
    live = np.flatnonzero((out == len(_WINDOW)) & (out < limit))
    while len(live):  # what is longer is compared byte by byte
        live = live[raw[offsets[live] + out[live]] == raw[offsets[live - 1] + out[live]]]
        out[live] += 1
        live = live[out[live] < limit[live]]
    return out


def _spell(raw: bytes, words: list[bytes]) -> str:
    """The phrase that bytes of a suffix stand for."""
    out, at = [], 0
    while at < len(raw):
        if raw[at] >= 0xFC:
            out.append(words[_SHORT + ((raw[at] - 0xFC) << 16 | raw[at + 1] << 8 | raw[at + 2])])
            at += 3
        elif raw[at] >= 0xF8:
            out.append(words[(raw[at] - 0xF8) << 8 | raw[at + 1]])
            at += 2
        else:
            end = raw.index(b" ", at)
            out.append(raw[at + 1 : end])
            at = end + 1
    return b" ".join(out).decode("utf-8", "surrogatepass")


def _count_prefixes(coded: dict[str, list[bytes]], langs: dict[str, bytes], max_n: int, least: int):
    """Counts of all phrases of a range of suffixes in order; below ``least`` only those that may go on in another range."""

    names = {code[0]: lang for lang, code in langs.items()}

    def counted(rows: list[tuple[bytes, int, int, int]]) -> pa.RecordBatch:
        out = []
        for raw, begin, size, n in rows:
            lang = names[raw[0]] if raw[0] else raw[5:begin].decode("utf-8", "surrogatepass")
            out.append((lang, _spell(raw[begin:], coded.get(lang, [])), size, n))
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["lang", "phrase", "size", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list = [None] * (max_n + 1)  # for each size the phrase now open: its bytes, where words begin in them, its count, whether it began the range
        began = False
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("suffix")
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            at = offsets[:-1]
            lead = np.ones(len(at), np.int64)  # bytes of the language
            for k in np.flatnonzero(raw[at] == 0).tolist():
                lead[k] = 5 + int.from_bytes(raw[at[k] + 1 : at[k] + 5].tobytes(), "big")
            ends = word_ends(raw, at + lead, max_n)
            count = np.zeros(len(at), np.int64)
            for place in range(1, int((offsets[1:] - ends[-1]).max())):
                there = ends[-1] + place < offsets[1:]
                count[there] = count[there] << 8 | raw[(ends[-1] + place)[there]]
            shared = _shared_bytes(raw, offsets)
            shared[0] = -1
            done: list[tuple[bytes, int, int, int]] = []
            last_end = at + lead
            for size, end in enumerate(ends, 1):
                there, last_end, open_ = end > last_end, end, stack[size]
                stack[size] = None
                starts = np.flatnonzero(there & (shared < end - at))
                spell = lambda row, end=end: (raw[at[row] : end[row]].tobytes(), int(lead[row]))
                goes_on = len(starts) and starts[0] == 0 and open_ is not None and spell(0)[0] == open_[0]
                if open_ is not None and not goes_on and (open_[2] >= least or open_[3]):
                    done.append((*open_[:2], size, open_[2]))
                if not len(starts):
                    continue
                sums = np.add.reduceat(np.where(there, count, 0), starts)
                edge = not began and starts[0] == 0
                if goes_on:
                    sums[0] += open_[2]
                    edge = open_[3]
                last = len(starts) - 1
                if there[-1]:  # the last row's phrase stays open
                    stack[size] = (*spell(int(starts[last])), int(sums[last]), edge and last == 0)
                out = sums >= least
                out[0] |= edge
                if there[-1]:
                    out[last] = False
                done += [(*spell(k), size, n) for k, n in zip(starts[out].tolist(), sums[out].tolist())]
            began = True
            if done:
                yield counted(done)
        rest = [(*s[:2], size, s[2]) for size, s in enumerate(stack) if s is not None]
        if rest:
            yield counted(rest)

    return run


def _bounds(suffixes: DataFrame, ranges: int) -> list[bytes]:
    """Where ranges of about equal size end, by about ``SAMPLED`` suffixes for each of them."""
    share = min(1.0, SAMPLED * ranges / SAMPLE_WORDS)  # a sample has fewer suffixes than words
    found = sorted(r[0] for r in suffixes.select("suffix").filter(F.rand(7) < share).collect())
    return sorted({found[k * len(found) // ranges] for k in range(1, ranges)}) if found else []


def phrase_counts(docs: DataFrame, words: DataFrame, max_n: int = 5, least: int = 100) -> DataFrame:
    """lang, phrase, size and n of all phrases of up to ``max_n`` words that a language has ``least`` times.

    ``words`` are ``frequent_words``, kept in a table."""
    ship(docs.sparkSession)
    bitmap, coded = frequent_bitmap(words), codes(words)
    langs = lang_codes(coded)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    total = words.agg(F.sum("n")).first()[0] or 0
    suffixes = lambda df, bounds=None: df.mapInArrow(_suffixes(bitmap, coded, langs, max_n, CHUNK_BYTES, bounds), "range int, suffix binary")
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = SAMPLE_WORDS / max(1, total)
    bounds = _bounds(suffixes(rows if share >= 1 else rows.sample(share, 11)), ranges)
    ranged = suffixes(rows, bounds).repartitionById(len(bounds) + 1, "range").sortWithinPartitions(F.desc("suffix")).select("suffix")
    counted = ranged.mapInArrow(_count_prefixes(coded, langs, max_n, least), "lang string, phrase string, size int, n bigint")
    return counted.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def parts(counts: DataFrame) -> DataFrame:
    """lang, phrase, size, a, k, l and r for each way to cut a phrase of two words or more after its first k words."""
    cuts = counts.filter("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - size)"))
    left = counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    return cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).select("lang", "phrase", "size", "a", "k", "l", "r")


def maximal(counts: DataFrame, share: int = 100) -> DataFrame:
    """Phrases of two words or more of which no phrase of one word more has ``share`` per cent of the occurrences.

    A still longer one that has them has one of one word more in between that has them as well."""
    longer = counts.filter("size > 2")
    inner = F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))
    within = longer.select("lang", F.explode(inner).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    joined = counts.filter("size > 1").join(within, ["lang", "phrase"], "left")
    return joined.filter(F.col("most").isNull() | (100 * F.col("most") < share * F.col("n"))).select("lang", "phrase")


def collocations(docs: DataFrame, max_n: int = 5, least: int = 100, top: int = 2000, share: int = 100) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases by 1000 a n / (l r), rounded down, of the weakest cut."""
    words = Stored(frequent_words(word_counts(docs), least), "frequent-words").rows  # written by a query, after which its shuffle files go
    counts = cut(phrase_counts(docs, words, max_n, least))
    salt = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)).cast("int").alias("salt")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(RANK_PARTS - 1))))
    kept = parts(counts).join(maximal(counts, share), ["lang", "phrase"], "left_semi").withColumn("salt", salt)
    exact = {c: F.col(c).cast("decimal(16,0)") for c in ("a", "n", "l", "r")}
    cuts = kept.join(totals, ["lang", "salt"]).select("*", F.struct(*(exact[c].alias(c) for c in exact)).alias("x"))
    cuts = cuts.withColumn("score", F.expr("(x.a * x.n * 1000) div (x.l * x.r)"))
    weakest = cuts.groupBy("lang", "salt", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("w")).select("lang", "salt", "phrase", "w.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language's candidates are ranked in parts first, so that few of them meet in its last ranking
    part = weakest.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    best = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
