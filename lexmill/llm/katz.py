"""Katz backoff language model of order 3: Good-Turing discounted counts with exactly normalised backoff weights.

A text is its words (A-Z in lower case) and one end token; its first word follows a begin mark.  A seen n-gram
gets ``d(c) * c(context, w) / c(context)``; what the discounts leave of a context goes to the words not seen
after it, in proportion to their probability in the shorter context, by the weight
``alpha = (1 - sum seen P(w|context)) / (1 - sum seen P(w|shorter context))``; single words are discounted
likewise and what is left over is the probability of the one class of unknown words.  A token is evaluated
recursively: triple, else weight times pair, else weight times single word; the first word of a text from the
pair on.  Counts up to ``K`` are discounted by the Good-Turing ratio; where the counts of counts give no ratio
in (0, 1], by absolute discounting.  A context that has only larger counts keeps one pseudo count for its
unseen words, so every weight is positive.

Counts live in tables partitioned by a hash of the context, a bucket for about ``common.BUCKET_BYTES`` of text.
Documents travel in chunks.  A chunk asks each bucket about its distinct words, which get numbers, then about
its distinct pairs, then about its distinct triples; the answers (counts, and for each context how many words
of each count follow it) are joined back to the chunk by its number, and scoring is local.  What a shorter
context gives to the seen words is summed up in whole numbers or known probabilities where the n-grams meet,
so the weights are exact.  N-grams of frequent contexts are dealt out by their last word too, and the chunk
adds up the sums of the parts; so no context's n-grams meet in one task.  Every phase leaves a table in the
shared folder, and what a finished phase needed is removed.

Words are told apart by 64-bit hashes, contexts of two words by 56 bits of a hash of their numbers.

Null or empty texts are the end token alone; texts of any length are taken whole; repeated rows count and are
scored each; ties in frequency only change numbers, not results; a null doc_id is hashed as the empty text;
columns other than doc_id and text are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import BUCKET_BYTES, Stored, crc_mod
from lexmill.llm.hashing import by_run, mix, split_words, word_hashes
from lexmill.llm.memory import trim
from lexmill.llm.packed import pack, unpack
from lexmill.shipping import ship

K = 5
CHUNK_DOCS, CHUNK_BYTES = 4000, 4 << 20
#: Contexts with more training tokens than this have their n-grams dealt out by the last word too.
HOT_TOKENS, HOT_PARTS = 200_000, 64
END = np.uint64(0x656E64)
_CHUNKS = "chunk bigint, payload binary, bucket int, ask binary"
_ASKS = "chunk bigint, bucket int, ask binary"
_ANSWERS = "of_chunk bigint, bucket int, answer binary, stats array<bigint>"


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and how many each text has."""
    parts, sizes = [], []
    for text in texts:
        h = word_hashes(split_words(text, lower=True))
        parts += [h, np.array([END])]
        sizes.append(len(h) + 1)
    return np.concatenate(parts), np.array(sizes, np.int64)


def _bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return (mix(h ^ np.uint64(0x3C3C)) >> np.uint64(33)).astype(np.int64) % n


def _slices(bucket: np.ndarray, n: int):
    """(bucket, positions) of every bucket that has some, in order."""
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(n + 1))
    return [(b, order[bounds[b] : bounds[b + 1]]) for b in range(n) if bounds[b + 1] > bounds[b]]


def _planes(x: np.ndarray) -> np.ndarray:
    """The bytes of whole numbers, byte by byte and without the upper ones that are all zero: small numbers and
    their equal bytes compress well this way."""
    raw = np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)
    used = int(np.bitwise_or.reduce(x.astype(np.uint64), initial=np.uint64(0))).bit_length() + 7 >> 3
    return np.ascontiguousarray(raw[:, :used].T)


def _unplanes(x: np.ndarray) -> np.ndarray:
    out = np.zeros((x.shape[1], 8), np.uint8)
    out[:, : len(x)] = x.T
    return out.view("<u8")[:, 0].astype(np.int64)


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in no more bytes than the largest needs."""
    most = int(x.max(initial=0))
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.int64)


def _ask_words(n_buckets: int, modulus: int):
    """A chunk's tokens as positions in its words, frequent ones first, and for each bucket the words there
    with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, size = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        texts: list[str] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq, size
            tokens, sizes = _tokens(texts)
            held = np.array([zlib.crc32(b"" if i is None else str(i).encode()) % modulus == 0 for i in ids])
            words, of, times = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            words, of = words[order], place[of]
            count = np.bincount(of, weights=np.repeat(~held, sizes), minlength=len(words)).astype(np.int32)
            bucket = _bucket_of(words, n_buckets)
            rows = [(None, pack((ids, held, sizes.astype(np.int32), _planes(of), bucket.astype(np.uint32)), level=3), None)]
            rows += [(b, None, pack((words[at], count[at]))) for b, at in _slices(bucket, n_buckets)]
            chunk = (part << 32) | seq
            seq, size = seq + 1, 0
            ids.clear()
            texts.clear()
            return pa.RecordBatch.from_arrays([pa.array([chunk] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["chunk", "payload", "bucket", "ask"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids.append(doc_id)
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if len(ids) >= CHUNK_DOCS or size >= CHUNK_BYTES:
                    yield flush()
        if ids:
            yield flush()

    return run


def _counts_of_counts(total: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(total[total > 0], K + 2), minlength=K + 3)[: K + 2].tolist() + [int((total > 0).sum()), int(total.sum())]


def _answer(table: pa.Table, out: list[bytes], stats: list[int]) -> pa.RecordBatch:
    """The answers of a bucket to its chunks, and a row of its own with its counts of counts."""
    chunks = table.column("chunk").to_pylist() + [-1]
    bucket = [table.column("bucket")[0].as_py()] * len(chunks)
    return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(bucket, pa.int32()), pa.array([*out, b""], pa.binary()), pa.array([None] * len(out) + [stats], pa.list_(pa.int64()))], names=["of_chunk", "bucket", "answer", "stats"])


def _count_words(n_buckets: int):
    """Training counts and numbers of a bucket's words: frequent words have small numbers, unknown ones 0."""

    def bucket(table: pa.Table) -> pa.RecordBatch:
        parts = [unpack(b) for b in table.column("ask").to_pylist()]
        words, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        total = np.bincount(of, weights=np.concatenate([p[1] for p in parts]), minlength=len(words)).astype(np.int64)
        number = np.empty(len(words), np.int64)
        number[np.argsort(-total, kind="stable")] = np.arange(len(words)) * n_buckets + table.column("bucket")[0].as_py() + 1
        number[total == 0] = 0
        out, at = [], 0
        for p in parts:
            own = of[at : at + len(p[0])]
            out.append(pack((_planes(total[own]), _planes(number[own]))))
            at += len(p[0])
        return _answer(table, out, _counts_of_counts(total))

    return lambda batches: by_run(batches, "bucket", bucket)


class Discounts:
    """Good-Turing discount ratios from counts of counts n_1..n_{K+1}."""

    def __init__(self, n: list[int]):
        ratio = np.ones(K + 1)
        cut_off = (K + 1) * n[K + 1] / n[1] if n[1] else 0.0
        absolute = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
        for r in range(1, K + 1):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - cut_off) / (1 - cut_off) if n[r] and cut_off < 1 else -1.0
            ratio[r] = d if 0 < d <= 1 else max(1e-3, 1 - absolute / r)
        self.ratio = np.append(ratio, 1.0)
        self.ratio[0] = 0.0

    def mass(self, count: np.ndarray) -> np.ndarray:
        return self.ratio[np.minimum(count, K + 1)] * count


class Words:
    """Probabilities of single words; ``unknown`` is that of the class of unknown words."""

    def __init__(self, counts: list[int]):
        self.types, self.tokens = counts[K + 2], counts[K + 3]
        self.discounts = Discounts(counts)
        seen = sum(self.discounts.ratio[r] * r * counts[r] for r in range(1, K + 1)) + self.tokens - sum(r * counts[r] for r in range(1, K + 1))
        self.unknown = max(1 - seen / max(1, self.tokens), 1 / (self.tokens + self.types + 1)) if self.tokens else 1.0
        self.scale = (1 - self.unknown) / seen if seen > 0 else 0.0

    def probability(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.discounts.mass(count) * self.scale, self.unknown)


def _merged(answers: list | None) -> dict[int, object]:
    return {a["bucket"]: unpack(a["answer"]) for a in answers or []}


class _Grams:
    """A chunk's distinct n-grams of one order that training can have, in the order of the buckets they are
    counted in, and the contexts they follow.

    For each token ``context`` is the index of its context (the last one stands for none), ``word`` its word's
    position and ``lower`` the training count of the shorter n-gram; for each context ``identity`` is a number
    that all chunks agree on and ``tokens`` its training count."""

    def __init__(self, context, word, number, lower, identity, tokens, held, n_buckets: int, hot_tokens: int):
        known = tokens[context] > 0
        self.known, self.context_of, self.n_contexts = known, context, len(tokens)
        used = np.zeros(len(tokens), bool)
        used[context[known]] = True
        parts = np.where(tokens > hot_tokens, HOT_PARTS, 1) * used  # every part of a frequent context is asked for its sums
        self.owner = np.repeat(np.arange(len(tokens)), parts)
        begin = np.cumsum(parts) - parts
        part = np.arange(len(self.owner)) - begin[self.owner]
        heads = mix(mix(identity[self.owner]) + part.astype(np.uint64)) >> np.uint64(8)
        order = np.argsort(heads)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.heads, self.owner = heads[order], self.owner[order]
        needed = np.zeros(len(tokens), bool)
        needed[context[known & held]] = True
        self.wanted = needed[self.owner]

        asked = np.flatnonzero(known & (lower > 0))
        own = context[asked]
        salt = np.where(parts[own] > 1, (mix(number[word[asked]].astype(np.uint64)) >> np.uint64(40)).astype(np.int64) % HOT_PARTS, 0)
        radix = len(number)
        key, of = np.unique(rank[begin[own] + salt] * radix + word[asked], return_inverse=True)
        self.head, self.word = key // radix, key % radix
        self.number = number[self.word]
        self.gram = np.full(len(context), -1)
        self.gram[asked] = of
        self.context, self.lower = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        self.context[of], self.lower[of] = own, lower[asked]
        self.trained = np.bincount(of, weights=~held[asked], minlength=len(key)).astype(np.int64)
        self.size = np.bincount(self.head, minlength=len(heads))
        at = ((self.heads >> np.uint64(24)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
        self.head_bounds = np.searchsorted(at, np.arange(n_buckets + 1))
        self.gram_bounds = np.searchsorted(self.head, self.head_bounds)

    def buckets(self):
        """(bucket, slice of its heads, slice of its n-grams) of every bucket that is asked."""
        for b in np.flatnonzero(np.diff(self.head_bounds)).tolist():
            yield b, slice(*self.head_bounds[b : b + 2].tolist()), slice(*self.gram_bounds[b : b + 2].tolist())

    def asks(self):
        for b, heads, grams in self.buckets():
            words, codes = np.unique(self.number[grams], return_inverse=True)
            lower, of_lower = np.unique(self.lower[grams], return_inverse=True)
            arrays = (np.diff(self.heads[heads], prepend=np.uint64(0)), self.size[heads], self.wanted[heads], np.diff(words, prepend=0), codes, lower, of_lower, self.trained[grams])
            yield b, pack(tuple(map(_planes, arrays)))

    def take(self, answers: list | None):
        """Of each n-gram its count, and of each context how many words follow it with each count up to K, the
        sum of larger counts, and what the shorter contexts give to the words seen after it."""
        total, n = np.zeros(len(self.head), np.int64), self.n_contexts
        following, below, got = np.zeros((n, K + 1)), np.zeros(n), _merged(answers)
        for b, heads, grams in self.buckets():
            counts, sums, shorter = got[b]
            owner, total[grams] = self.owner[heads], _unplanes(counts)
            np.add.at(below, owner[self.wanted[heads]], shorter)
            for r, column in enumerate(sums):
                at = np.flatnonzero(column := _unplanes(column))
                np.add.at(following[:, r], owner[at], column[at])
        return total, following, below


def _count_grams(weight):
    """Training counts of a bucket's n-grams, and of each context part there how many words of each count
    follow it and the sum of ``weight`` of their shorter n-grams' counts."""

    def bucket(table: pa.Table) -> pa.RecordBatch:
        parts = [unpack(b) for b in table.column("ask").to_pylist()]  # byte planes; a column at a time becomes numbers
        heads, head_of = np.unique(np.concatenate([np.cumsum(_unplanes(p[0])) for p in parts]), return_inverse=True)
        head_of = head_of.astype(np.int32)
        word = np.concatenate([_narrow(np.cumsum(_unplanes(p[3])))[_unplanes(p[4])] for p in parts])
        radix = int(word.max(initial=0)) + 1
        key = np.repeat(head_of, np.concatenate([_narrow(_unplanes(p[1])) for p in parts])).astype(np.int64)
        key *= radix
        key += word.astype(np.int64)
        del word
        key, gram_of = np.unique(key, return_inverse=True)
        gram_of = gram_of.astype(np.int32)
        of = (key // radix).astype(np.int32)
        bounds = np.concatenate([[0], np.cumsum([p[4].shape[1] for p in parts])]).tolist()
        total, shorter = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        del key
        for p, a, b in zip(parts, bounds, bounds[1:]):
            np.add.at(total, gram_of[a:b], _unplanes(p[7]))
            shorter[gram_of[a:b]] = _unplanes(p[5])[_unplanes(p[6])]
        seen = total > 0
        sums = [_narrow(np.bincount(of[total == r], minlength=len(heads))) for r in range(1, K + 1)]
        sums.append(_narrow(np.bincount(of, weights=np.where(total > K, total, 0), minlength=len(heads)).astype(np.int64)))
        below = np.bincount(of[seen], weights=weight(shorter[seen]), minlength=len(heads))
        stats, total = _counts_of_counts(total), _narrow(total)
        out, h = [], 0
        for p, a, b in zip(parts, bounds, bounds[1:]):
            own = head_of[h : h + p[0].shape[1]]
            out.append(pack((_planes(total[gram_of[a:b]]), [_planes(s[own]) for s in sums], below[own[_unplanes(p[2]) > 0]])))
            h += len(own)
        return _answer(table, out, stats)

    return lambda batches: by_run(batches, "bucket", bucket)


class _Chunk:
    """A chunk's tokens with the counts and numbers of their words."""

    def __init__(self, payload: bytes, answers: list, n_buckets: int, train_docs: int, hot_tokens: int):
        self.ids, held_docs, sizes, planes, bucket = unpack(payload)
        self.sizes, self.of, self.held_docs = sizes.astype(np.int64), _unplanes(planes), held_docs
        self.held, self.settings = np.repeat(held_docs, self.sizes), (n_buckets, hot_tokens)
        n = len(bucket)
        self.count, self.number = np.zeros(n, np.int64), np.zeros(n + 1, np.int64)  # the last is the begin mark
        got = _merged(answers)
        for b, at in _slices(bucket.astype(np.int64), n_buckets):
            self.count[at], self.number[at] = map(_unplanes, got[b])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.before = np.empty(len(self.of), np.int64)
        self.before[1:] = self.of[:-1]
        self.before[self.starts] = n
        self.tokens = np.append(self.count, train_docs)

    def pairs(self) -> _Grams:
        return _Grams(self.before, self.of, self.number, self.count[self.of], self.number.astype(np.uint64), self.tokens, self.held, *self.settings)

    def triples(self, pairs: _Grams, pair_total: np.ndarray) -> _Grams:
        context = np.empty(len(self.of), np.int64)
        context[1:] = pairs.gram[:-1]
        context[self.starts] = -1
        tokens = np.append(pair_total, 0)
        identity = mix(self.number[pairs.context].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + pairs.number.astype(np.uint64)
        return _Grams(context, self.of, self.number, tokens[pairs.gram], np.append(identity, np.uint64(0)), tokens, self.held, *self.settings)


def _asks(chunk: int, grams: _Grams) -> Iterator[pa.RecordBatch]:
    rows = list(grams.asks())
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["chunk", "bucket", "ask"])


def _rows(batches: Iterator[pa.RecordBatch], *columns: str):
    """The values of each row; a row at a time is unpacked, and what it took is given back."""
    for batch in batches:
        for row in range(batch.num_rows):
            yield tuple(batch.column(c)[row].as_py() for c in columns)
            trim()


def _ask_pairs(*settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, payload, answers in _rows(batches, "chunk", "payload", "answers"):
            yield from _asks(chunk, _Chunk(payload, answers, *settings).pairs())

    return run


def _ask_triples(*settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, payload, answers, pair_answers in _rows(batches, "chunk", "payload", "answers", "pair_answers"):
            c = _Chunk(payload, answers, *settings)
            pairs = c.pairs()
            yield from _asks(chunk, c.triples(pairs, pairs.take(pair_answers)[0]))

    return run


def _backed_off(grams: _Grams, answers: list | None, discounts: Discounts, tokens: np.ndarray, shorter: np.ndarray, per: np.ndarray | None):
    """(probability of every token, count of every n-gram, denominator of every context) from ``shorter``, the
    tokens' probabilities in the shorter context; ``per`` divides what the shorter contexts give."""
    total, following, below = grams.take(answers)
    kept = following[:, :K] @ (discounts.ratio[1 : K + 1] * np.arange(1, K + 1)) + following[:, K]
    bottom = np.where(tokens - kept > 1e-9 * np.maximum(tokens, 1), tokens, tokens + 1).astype(float)
    left = 1 - (below if per is None else below / per)
    alpha = (1 - kept / bottom) / np.maximum(left, 1e-15)
    out = shorter.copy()
    at = np.flatnonzero(grams.known)
    own, gram = grams.context_of[at], grams.gram[at]
    count = np.where(gram >= 0, total[gram], 0) if len(total) else np.zeros(len(at), np.int64)
    out[at] = np.where(count > 0, discounts.mass(count) / bottom[own], alpha[own] * shorter[at])
    return out, total, bottom


def _score(settings: tuple, model: Words, pair_discounts: Discounts, triple_discounts: Discounts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for payload, answers, pair_answers, triple_answers in _rows(batches, "payload", "answers", "pair_answers", "triple_answers"):
            c = _Chunk(payload, answers, *settings)
            single = model.probability(c.count)[c.of]
            pairs = c.pairs()
            double, pair_total, bottom = _backed_off(pairs, pair_answers, pair_discounts, c.tokens, single, None)
            triples = c.triples(pairs, pair_total)
            # a pair (v, w) was counted in d(c(v, w)) * c(v, w) there; its probability has v's denominator below it
            per = np.append(bottom[pairs.word], 1.0)
            final, _, _ = _backed_off(triples, triple_answers, triple_discounts, np.append(pair_total, 0), double, per)
            base = np.log10((c.count + 0.1) / (model.tokens + 0.1 * (model.types + 1)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(c.ids, pa.int64()), pa.array(c.held_docs, pa.bool_()), pa.array(c.sizes, pa.int64()), pa.array(np.add.reduceat((c.count > 0)[c.of].astype(np.int64), c.starts), pa.int64()),
                    pa.array(np.full(len(c.ids), model.tokens), pa.int64()), pa.array(np.add.reduceat(base[c.of], c.starts), pa.float64()), pa.array(np.add.reduceat(np.log10(final), c.starts), pa.float64()),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def _summed(answers: DataFrame) -> list[int]:
    """Counts of counts over all buckets: one row of K + 4 numbers."""
    rows = answers.filter("of_chunk = -1").select(F.posexplode("stats").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect()
    found = {r["k"]: r["n"] for r in rows}
    return [int(found.get(k, 0)) for k in range(K + 4)]


def _exchange(asks: DataFrame, n: int, count, name: str) -> Stored:
    """The asks (chunk, bucket, ask) brought together by bucket, and a table of the answers."""
    return Stored(asks.repartition(n, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(count, _ANSWERS), name)


def _with_answers(chunks: DataFrame, answers: Stored, column: str) -> DataFrame:
    gathered = answers.rows.filter("of_chunk >= 0").groupBy("of_chunk").agg(F.collect_list(F.struct("bucket", "answer")).alias(column))
    return chunks.join(gathered, F.col("chunk") == F.col("of_chunk"), "left").drop("of_chunk")


def score_texts(docs: DataFrame, modulus: int = 10, buckets: int | None = None, hot_tokens: int = HOT_TOKENS) -> DataFrame:
    """Score every text of ``docs`` under the model of those whose crc32(doc_id) modulo ``modulus`` is not 0."""
    spark = ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    trained = F.count(F.when(crc_mod(F.col("doc_id"), modulus) != 0, 1))
    train_docs, size = docs.agg(trained, F.sum(F.octet_length("text").cast("bigint"))).first()
    n = buckets or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // BUCKET_BYTES))
    settings = (n, train_docs, hot_tokens)

    asked = Stored(docs.mapInArrow(_ask_words(n, modulus), _CHUNKS), "katz-words")
    word_counts = _exchange(asked.rows.filter("bucket IS NOT NULL").select("chunk", "bucket", "ask"), n, _count_words(n), "katz-word-counts")
    model = Words(_summed(word_counts.rows))
    numbered = Stored(_with_answers(asked.rows.filter("bucket IS NULL").select("chunk", "payload"), word_counts, "answers"), "katz-numbered")
    asked.drop()
    word_counts.drop()

    pair_counts = _exchange(numbered.rows.mapInArrow(_ask_pairs(*settings), _ASKS), n, _count_grams(model.probability), "katz-pair-counts")
    pair_discounts = Discounts(_summed(pair_counts.rows))
    paired = Stored(_with_answers(numbered.rows, pair_counts, "pair_answers"), "katz-paired")
    numbered.drop()
    pair_counts.drop()

    triple_counts = _exchange(paired.rows.mapInArrow(_ask_triples(*settings), _ASKS), n, _count_grams(pair_discounts.mass), "katz-triple-counts")
    triple_discounts = Discounts(_summed(triple_counts.rows))
    ready = _with_answers(paired.rows, triple_counts, "triple_answers").select("payload", "answers", "pair_answers", "triple_answers")
    out = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return ready.mapInArrow(_score(settings, model, pair_discounts, triple_discounts), out)
