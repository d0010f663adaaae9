"""Substring dedup: repeated windows of words found by backward search in an FM-index for each shard.

Every window of ``width`` words has a minimizer, the least hash among its runs of ``GRAM`` words, so equal
windows have equal minimizers.  Only stretches around minimizers that occur twice in the corpus can repeat;
they are dealt out to shards by that minimizer.  Each shard builds an FM-index over its distinct stretches,
streams them through it and reports, for every position with at least ``width`` matching words, the earliest
document and position of that window.  A word is removed if a window over it has an earlier occurrence.

Documents travel in chunks: a chunk's compressed texts are written once, what shards need of a chunk is
distinct and aggregated first (each stretch once, with its earliest place), and what they return is as large
at most.  So a passage that all documents share reaches a shard once for each chunk.  Documents of the very
same words are one class: all but the smallest id repeat it from the first word on.

Words are compared by 64-bit hashes, stretches by all of these; the number of shards follows the size
of the texts, so that a shard holds what about ``common.BUCKET_BYTES`` of text have in common with others.

Null or empty texts have no words and lose none; texts of any length are taken whole, periodic ones too; a null
doc_id counts as the smallest; rows that repeat a doc_id and its text get the same result, and rows that repeat
a doc_id with other texts are compared as one document would be; ties fall to the smaller doc_id, then to the
earlier start; other columns are ignored whatever their names, or travel along unchanged
(``with_kept_text``); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lexmill.llm.common import Stored, cut, text_buckets
from lexmill.llm.fm_index import FMIndex
from lexmill.llm.hashing import by_run, mix, split_words, window_hashes, word_hashes
from lexmill.llm.packed import pack, unpack
from lexmill.shipping import ship

GRAM = 8
CHUNK_DOCS, CHUNK_BYTES = 8000, 12 << 20
#: Words that are worked on at a time.
BLOCK_WORDS = 1 << 16
NULL_ID = -(1 << 63)
_CHUNKS = "chunk bigint, ids array<bigint>, n_words array<int>, sig1 array<bigint>, sig2 array<bigint>, payload binary, minimizers array<binary>"


def blocks(texts: list[str | None], skip: set[int] = frozenset()) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of some texts, how many words each has, and all their words' hashes; as many texts at a time as have about
    ``BLOCK_WORDS`` words."""
    held: list[bytes] = []
    which, n = [], []
    for d, text in enumerate(texts):
        if d in skip:
            continue
        words = split_words(text, lower=False)
        which.append(d)
        n.append(len(words))
        held += words
        if len(held) >= BLOCK_WORDS:
            yield np.array(which), np.array(n), word_hashes(held)
            held, which, n = [], [], []
    if which:
        yield np.array(which), np.array(n), word_hashes(held)


def stretches(grams: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, minimizer hash, first window and last window of each run of a document's windows with one minimizer.

    ``grams`` are the hashes of all runs of ``GRAM`` words in documents of ``n`` words that stand end to end."""
    least, span, size = grams, width - min(GRAM, width) + 1, 1
    while size < span and len(least):  # minimum over ``span`` grams by doubling
        step = min(size, span - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    of = np.repeat(np.arange(len(n)), n)[: len(least)]
    windows = np.flatnonzero(np.arange(len(least)) + width <= np.cumsum(n)[of])  # those within one document
    least, of = least[windows], of[windows]
    new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (of[1:] != of[:-1])])[: len(windows)])
    return of[new], least[new], windows[new], windows[np.append(new[1:], len(windows))[: len(new)] - 1]


def _signatures(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each document's words and their places; 0 for documents without words."""
    begin, some = np.cumsum(n) - n, np.flatnonzero(n)
    order = (2 * (np.arange(len(h)) - np.repeat(begin, n)) + 1).astype(np.uint64)
    out = np.zeros((2, len(n)), np.uint64)
    for k, words in enumerate((h, h ^ np.uint64(0x9E3779B97F4A7C15))):
        if len(some):
            out[k, some] = np.add.reduceat(mix(words * order), begin[some])
    return out[0].view(np.int64), out[1].view(np.int64)


def _repeating(grams: np.ndarray, n: np.ndarray, of: np.ndarray, key: np.ndarray, gram: int) -> np.ndarray:
    """Those of the minimizers ``key`` of documents ``of`` that stand twice in their document."""
    salt = mix(np.arange(1, len(n) + 1, dtype=np.uint64))
    doc = np.repeat(np.arange(len(n)), n)[: len(grams)]
    own = np.sort((grams ^ salt[doc])[np.arange(len(grams)) + gram <= np.cumsum(n)[doc]])
    again = own[1:][own[1:] == own[:-1]]
    return key[np.isin(key ^ salt[of], again)] if len(again) else key[:0]


def _buckets(keys: np.ndarray, n: int) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xA5A5A5A5)) >> np.uint64(33)).astype(np.int64) % n


def _ipc(batches: list[pa.RecordBatch]) -> bytes:
    """The columns that only travel along."""
    if not batches or not batches[0].num_columns:
        return b""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema) as writer:
        for b in batches:
            writer.write_batch(b)
    return sink.getvalue().to_pybytes()


def _chunk(width: int, n_buckets: int):
    """Chunks of documents with their signatures and, for each bucket, their distinct minimizers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, size = TaskContext.get().partitionId(), 0, 0
        ids: list[int] = []
        texts: list[str | None] = []
        rest: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq, size
            n, s1, s2, keys = [], [], [], []
            gram = min(GRAM, width)
            for _, size_of, h in blocks(texts):
                n.append(size_of)
                for out, sig in zip((s1, s2), _signatures(h, size_of)):
                    out.append(sig)
                grams = window_hashes(h, gram)
                of, key, _, _ = stretches(grams, size_of, width)
                keys += [key, _repeating(grams, size_of, of, key, gram)]  # such a minimizer may repeat within one stretch
            n, s1, s2 = map(np.concatenate, (n, s1, s2))
            key, count = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.uint64), return_counts=True)
            bucket = _buckets(key, n_buckets)
            order = np.argsort(bucket.astype(np.uint16) if n_buckets <= 1 << 16 else bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            blobs = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                own = order[a:b]
                blobs.append(_short(key[own]) + (count[own] > 1).tobytes() if b > a else b"")
            payload = pack((texts, _ipc(rest)), level=3)
            row = [[(part << 32) | seq], [ids], [n], [s1], [s2], [payload], [blobs]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary())]
            out = pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(row, kinds)], names=["chunk", "ids", "n_words", "sig1", "sig2", "payload", "minimizers"])
            seq, size = seq + 1, 0
            ids.clear()
            texts.clear()
            rest.clear()
            return out

        for batch in batches:
            others = batch.select([c for c in batch.schema.names if c not in ("_lexmill_id", "_lexmill_text")])
            at = 0
            for row, (doc_id, text) in enumerate(zip(batch.column("_lexmill_id").to_pylist(), batch.column("_lexmill_text"))):
                text = text.as_py()
                ids.append(NULL_ID if doc_id is None else doc_id)
                texts.append(text)
                size += len(text or "")
                if len(ids) >= CHUNK_DOCS or size >= CHUNK_BYTES:
                    rest.append(others.slice(at, row + 1 - at))
                    at = row + 1
                    yield flush()
            if at < batch.num_rows:
                rest.append(others.slice(at))
        if ids:
            yield flush()

    return run


def _short(keys: np.ndarray) -> bytes:
    """The upper 40 bits of each key.  Keys that agree in them only bring stretches to a shard in vain."""
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def _long(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, 3:] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view(np.uint64)[:, 0]


def _shared(table: pa.Table) -> pa.RecordBatch | None:
    """For each chunk those of its minimizers in this bucket that the corpus holds more than once."""
    blobs = table.column("blob").to_pylist()
    sizes = [len(b) // 6 for b in blobs]
    keys = np.concatenate([_long(b[: 5 * n]) for b, n in zip(blobs, sizes)])
    twice = np.concatenate([np.frombuffer(b[5 * n :], bool) for b, n in zip(blobs, sizes)])
    _, of = np.unique(keys, return_inverse=True)
    many = np.bincount(of, weights=1 + twice)[of] > 1
    rows, at = [], 0
    for chunk, n in zip(table.column("chunk").to_pylist(), sizes):
        own = keys[at : at + n][many[at : at + n]]
        at += n
        if len(own):
            rows.append((chunk, _short(own)))
    if not rows:
        return None
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["of_chunk", "keys"])


def _cut_stretches(width: int, n_buckets: int):
    """For each chunk the places of its stretches with shared minimizers, and for each bucket its distinct
    stretches with their earliest place in the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, ids, payload, keys, skip in zip(*(batch.column(c).to_pylist() for c in ("chunk", "ids", "payload", "keys", "skip"))):
                shared = np.unique(_long(b"".join(keys or [])))
                skip = set(skip or [])
                doc_of, first, last, names, bucket, content = [], [], [], [], [], []
                known: dict[bytes, int] = {}
                for which, n, h in blocks(unpack(payload)[0] if len(shared) else [], skip):
                    of, key, a, b = stretches(window_hashes(h, min(GRAM, width)), n, width)
                    short = key & np.uint64(0xFFFFFFFFFF000000)
                    keep = np.flatnonzero(shared[np.minimum(np.searchsorted(shared, short), len(shared) - 1)] == short)
                    if not len(keep):
                        continue
                    of, key, a, b = of[keep], key[keep], a[keep], b[keep]
                    own = [h[x : y + width] for x, y in zip(a.tolist(), b.tolist())]
                    begin = (np.cumsum(n) - n)[of]
                    doc_of.append(which[of])
                    first.append(a - begin)
                    last.append(b - begin)
                    names.append(_names(own, known))
                    bucket.append(_buckets(key, n_buckets))
                    content += own
                if not doc_of:
                    continue
                doc_of, first, last, names, bucket = map(np.concatenate, (doc_of, first, last, names, bucket))
                id_of = np.array(ids, np.int64)[doc_of]
                order = np.lexsort((first, id_of, names, bucket))
                new = np.concatenate([[True], (names[order][1:] != names[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])])
                which = np.empty(len(order), np.int64)
                which[order] = np.cumsum(new) - 1
                lead = order[new]
                rows = [(-1, pack((doc_of.astype(np.int32), first.astype(np.int32), which.astype(np.int32), bucket[lead].astype(np.int32))))]
                bounds = np.flatnonzero(np.concatenate([[True], bucket[lead][1:] != bucket[lead][:-1], [True]]))
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    own = lead[a:b]
                    vocabulary, codes = np.unique(np.concatenate([content[k] for k in own]), return_inverse=True)
                    small = np.uint16 if len(vocabulary) < 1 << 16 else np.uint32
                    lengths = last[own] - first[own] + width  # without bound: a periodic text is one stretch
                    lengths = lengths.astype(np.uint16 if lengths.max() < 1 << 16 else np.uint32)
                    rows.append((int(bucket[own[0]]), pack((vocabulary, codes.astype(small), lengths, id_of[own], first[own].astype(np.int32)))))
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["chunk", "bucket", "blob"])

    return run


def _names(stretches: list[np.ndarray], known: dict[bytes, int]) -> np.ndarray:
    """A number for each stretch, equal for equal ones; ``known`` holds those numbered so far."""
    return np.array([known.setdefault(x.tobytes(), len(known)) for x in stretches], np.int64)


def _search_shard(width: int):
    """Build the shard's index, stream its stretches, and return for each chunk the earliest place of every
    window of its stretches."""

    def shard(table: pa.Table) -> pa.RecordBatch:
        parts = [unpack(b) for b in table.column("blob").to_pylist()]
        vocabulary = np.unique(np.concatenate([p[0] for p in parts]))
        words = np.concatenate([np.searchsorted(vocabulary, p[0])[p[1]] for p in parts]).astype(np.int64) + 1
        lengths = np.concatenate([p[2] for p in parts]).astype(np.int64)
        id_of, start = np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts]).astype(np.int64)
        ends = np.cumsum(lengths)
        short = words.astype(np.int32)
        name = _names([short[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist())], {})
        order = np.lexsort((start, id_of, name))
        new = np.concatenate([[True], name[order][1:] != name[order][:-1]])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        lead = order[new]
        size = lengths[lead]
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        patterns = words[np.repeat(ends[lead] - size, size) + inside]
        text = np.zeros(len(patterns) + len(lead), np.int64)
        text[np.arange(len(patterns)) + np.repeat(np.arange(len(lead)), size)] = patterns
        owner, offset = np.repeat(np.arange(len(lead)), size + 1), np.arange(len(text)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
        index = FMIndex(text, width)
        docs, rank = np.unique(id_of[lead], return_inverse=True)
        place = rank[owner].astype(np.int64) << 32 | (start[lead][owner] + offset)
        place[size[owner] - offset < width] = np.iinfo(np.int64).max
        firsts = np.flatnonzero(np.concatenate([[True], index.group[1:] != index.group[:-1]]))
        earliest = np.minimum.reduceat(place[index.order], firsts)
        pattern, at, group = index.matches(patterns, size, width)
        windows = size - width + 1
        begin = np.cumsum(windows) - windows
        found = np.zeros(int(windows.sum()), np.int64)
        found[begin[pattern] + at] = earliest[group]
        out, k = [], 0
        for p in parts:
            own = which[k : k + len(p[2])]
            k += len(p[2])
            w = windows[own]
            values = found[np.repeat(begin[own] - (np.cumsum(w) - w), w) + np.arange(int(w.sum()))]
            out.append(pack((docs[values >> 32], (values & 0xFFFFFFFF).astype(np.int32), w.astype(np.int32))))
        return pa.RecordBatch.from_arrays([table.column("chunk").combine_chunks(), table.column("bucket").combine_chunks(), pa.array(out, pa.binary())], names=["of_chunk", "bucket", "answer"])

    return lambda batches: by_run(batches, "bucket", shard)


def _finish(width: int, columns: list[str] | None = None):
    """The rows' results, or the rows themselves (``columns``) with what is left of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, n_words, payload, skip, places, answers in zip(*(batch.column(c).to_pylist() for c in ("ids", "n_words", "payload", "skip", "places", "answers"))):
                skip, spans = set(skip or []), {}
                if places is not None:
                    doc_of, first, which, buckets = unpack(places)
                    got = {a["bucket"]: unpack(a["answer"]) for a in answers}
                    used = np.unique(buckets)  # the distinct stretches stand in the order of their buckets
                    docs, starts, windows = (np.concatenate([got[int(b)][k] for b in used]) for k in range(3))
                    begin = np.cumsum(windows.astype(np.int64)) - windows
                    w = windows[which].astype(np.int64)
                    step = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
                    entry = np.repeat(begin[which], w) + step
                    doc, at = np.repeat(doc_of, w), np.repeat(first, w) + step
                    own = np.array(ids, np.int64)[doc]
                    bad = (docs[entry] < own) | (docs[entry] == own) & (starts[entry] < at)
                    doc, at = doc[bad], at[bad]
                    order = np.argsort(doc, kind="stable")
                    doc, at = doc[order], at[order]
                    cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]])) if len(doc) else np.zeros(0, int)
                    spans = {int(doc[a]): at[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())}
                texts, removed = [], []
                own_texts, others = unpack(payload)
                for d, (text, n) in enumerate(zip(own_texts, n_words)):
                    if d in skip and n >= width:
                        texts.append("")
                        removed.append(n)
                    elif d in spans:
                        edge = np.zeros(n + 1, np.int32)
                        np.add.at(edge, spans[d], 1)
                        np.add.at(edge, np.minimum(spans[d] + width, n), -1)
                        gone = np.cumsum(edge[:-1]) > 0
                        texts.append(b" ".join([w for w, g in zip(split_words(text, lower=False), gone.tolist()) if not g]).decode("utf-8", "surrogatepass"))
                        removed.append(int(gone.sum()))
                    else:
                        texts.append(text if columns else b" ".join(split_words(text, lower=False)).decode("utf-8", "surrogatepass"))
                        removed.append(0)
                if columns is None:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([None if i == NULL_ID else i for i in ids], pa.int64()), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"]
                    )
                    continue
                table = pa.ipc.open_stream(others).read_all() if others else None
                out = [pa.array(texts, pa.string()) if c == "text" else table.column(c).combine_chunks() for c in columns]
                keep = pa.array([not r or t != "" for r, t in zip(removed, texts)])
                yield pa.RecordBatch.from_arrays([*out, pa.array(removed, pa.int64())], names=[*columns, "_lexmill_removed"]).filter(keep)

    return run


def _repeated_documents(chunks: DataFrame) -> DataFrame:
    """of_skip and the positions of documents that repeat all words of one with a smaller id."""
    rows = chunks.select("chunk", F.posexplode(F.arrays_zip("ids", "n_words", "sig1", "sig2")).alias("at", "r")).select("chunk", "at", "r.*").filter("n_words > 0")
    # a table of its own, so that AQE can split the rows of large groups of copies in the join
    least = cut(rows.groupBy("sig1", "sig2", "n_words").agg(F.min("ids").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    skip = rows.join(least, ["sig1", "sig2", "n_words"]).filter("ids > first_id").groupBy("chunk").agg(F.collect_list("at").alias("skip"))
    return cut(skip.withColumnRenamed("chunk", "of_skip"))


def _with_skip(chunks: DataFrame, skip: DataFrame) -> DataFrame:
    return chunks.select("chunk", "ids", "n_words", "payload").join(skip, F.col("chunk") == F.col("of_skip"), "left").drop("of_skip")


def _pieces(chunks: DataFrame, skip: DataFrame, width: int, shards: int) -> Stored:
    by_bucket = chunks.select("chunk", F.posexplode("minimizers").alias("bucket", "blob")).filter(F.length("blob") > 0)
    by_bucket = by_bucket.repartition(shards, "bucket").sortWithinPartitions("bucket", "chunk")
    shared = by_bucket.mapInArrow(lambda batches: by_run(batches, "bucket", _shared), "of_chunk bigint, keys binary")
    keys = shared.groupBy("of_chunk").agg(F.collect_list("keys").alias("keys"))
    ready = _with_skip(chunks, skip).join(keys, F.col("chunk") == F.col("of_chunk")).select("chunk", "ids", "payload", "keys", "skip")
    return Stored(ready.mapInArrow(_cut_stretches(width, shards), "chunk bigint, bucket int, blob binary"), "stretches")


def _judged(docs: DataFrame, width: int, shards: int | None, carried: list[str]) -> DataFrame:
    """Chunks with everything that ``_finish`` needs; ``carried`` columns travel along."""
    ship(docs.sparkSession)
    shards = shards or text_buckets(docs)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("_lexmill_id"), F.col("text").alias("_lexmill_text"), *carried)
    chunks = cut(rows.mapInArrow(_chunk(width, shards), _CHUNKS))
    skip = _repeated_documents(chunks)
    pieces = _pieces(chunks, skip, width, shards)
    to_shards = pieces.rows.filter("bucket >= 0").repartition(shards, "bucket").sortWithinPartitions("bucket", "chunk")
    # a table of its own, so that what was dealt out to the shards goes before the chunks meet their answers
    answers = cut(to_shards.mapInArrow(_search_shard(width), "of_chunk bigint, bucket int, answer binary"))
    answers = answers.groupBy("of_chunk").agg(F.collect_list(F.struct("bucket", "answer")).alias("answers"))
    places = Stored(pieces.rows.filter("bucket < 0").select(F.col("chunk").alias("of_chunk"), F.col("blob").alias("places")), "places")
    pieces.drop()  # the shards have seen the stretches
    found = places.rows.join(answers, "of_chunk")
    return _with_skip(chunks, skip).join(found, F.col("chunk") == F.col("of_chunk"), "left").select("ids", "n_words", "payload", "skip", "places", "answers")


def remove_repeats(docs: DataFrame, width: int = 20, shards: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (the kept words joined by one space) of every row."""
    return _judged(docs, width, shards, []).mapInArrow(_finish(width), "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def with_kept_text(docs: DataFrame, width: int = 20, shards: int | None = None) -> DataFrame:
    """``docs`` with the kept text in place of those that lost words, and without those that lost all.

    Texts that lose nothing stay as they are, white space included; ``n_chars`` follows a changed text."""
    schema = StructType([*docs.schema.fields, StructField("_lexmill_removed", LongType())])
    out = _judged(docs, width, shards, [c for c in docs.columns if c != "text"]).mapInArrow(_finish(width, docs.columns), schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_lexmill_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
