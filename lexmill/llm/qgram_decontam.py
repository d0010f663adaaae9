"""Benchmark decontamination by q-gram lemma filtering.

Two texts of which one aligns with ``k`` errors to a stretch of the other share at least
``length + 1 - q - k*q`` q-grams, and all of them on diagonals at most ``k`` apart.  Every document is
streamed past an index of the benchmark's q-grams; shared q-grams are counted in overlapping diagonal bands
for each item, bands that meet the bound for the item's error budget are kept, and a banded alignment of the
whole item decides.  Items that occur cut off or edited are found by their pieces, searched in the same way: an
item counts if pieces near each other cover ``passage`` of its characters.  Texts are compared in lower case with each run of white space as one space; spans are
positions in that form.

The benchmark is the stated query set: it is indexed in blocks of at most ``block_chars`` characters, each
of which goes to all tasks, so what is broadcast has a fixed bound.  Documents are never shuffled.

Null or empty texts and items match nothing; items shorter than q match where they occur exactly between
word borders; texts of any length are searched whole; repeated items or documents each give their matches, and of
overlapping matches of one item the one with the fewest errors, then the first, counts; a null doc_id keeps its
matches; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.shipping import ship

Q = 12
ERROR_RATE = 0.05
PASSAGE, PIECE, STEP = 66, 32, 8
BLOCK_CHARS = 4_000_000
_MASK_BITS = 22
MATCHES = "doc_id bigint, item_id bigint, start bigint, end bigint, errors int"


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)


def qgrams(codes: np.ndarray, q: int) -> np.ndarray:
    """32-bit hash of every q-gram; equal q-grams have equal hashes."""
    if len(codes) < q:
        return np.zeros(0, np.uint32)
    base, out, have, power = np.uint32(0x01000193), None, 0, codes * np.uint32(0x85EBCA6B)
    width, factor = 1, base
    while True:  # build runs of powers of two and append those that q needs
        if q & width:
            if out is None:
                out = power
            else:
                scale = np.uint32(pow(int(base), width, 1 << 32))
                n = min(len(out), len(power) - have)
                out = out[:n] * scale + power[have : have + n]
            have += width
        width *= 2
        if width > q:
            break
        power = power[: -(width // 2)] * factor + power[width // 2 :]
        factor = np.uint32(pow(int(base), width, 1 << 32))
    out = out[: len(codes) - q + 1]
    out = (out ^ (out >> np.uint32(16))) * np.uint32(0x7FEB352D)
    return out ^ (out >> np.uint32(15))


def banded(item: np.ndarray, text: np.ndarray, budget: int) -> tuple[int, int]:
    """Least errors of aligning the whole of ``item`` to some stretch of ``text`` on the diagonals that
    ``text`` leaves, and where the stretch ends; errors above the budget mean none."""
    width = len(text) - len(item) + 1 + 2 * budget
    if width < 1:
        return budget + 1, 0
    lanes = np.arange(width, dtype=np.int32)
    big = np.int32(1 << 20)
    row = np.zeros(width, np.int32)  # row[d]: item[:i] aligned to a stretch that ends at text[i + d - budget]
    padded = np.concatenate([np.full(budget, 0xFFFFFFFF, np.uint32), text, np.full(2 * budget + 1, 0xFFFFFFFF, np.uint32)])
    for i in range(len(item)):
        step = row + (padded[i : i + width] != item[i])
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        row = np.minimum.accumulate(step - lanes) + lanes
        if row.min() > budget:
            return budget + 1, 0
    ends = len(item) + lanes - budget
    row = np.where((ends >= 0) & (ends <= len(text)), row, big)
    at = int(row.argmin())
    return int(row[at]), int(ends[at])


def _verbatim(item: np.ndarray, text: np.ndarray) -> int:
    """Where ``item`` first stands in ``text`` as it is, -1 if nowhere."""
    for at in np.flatnonzero(text[: max(0, len(text) - len(item) + 1)] == item[0]).tolist():
        if np.array_equal(text[at : at + len(item)], item):
            return at
    return -1


class Index:
    """Q-grams of some benchmark items, for streaming documents past them."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float):
        self.q = q
        self.ids = [i for i, _ in items]
        self.codes = [_codes(t) for _, t in items]
        self.texts = [t for _, t in items]
        self.budget = np.array([int(rate * len(c)) for c in self.codes], np.int64)
        self.least = np.array([max(1, len(c) + 1 - q - k * q) for c, k in zip(self.codes, self.budget.tolist())], np.int64)
        self.stride = self.budget + 1
        self.short = [(i, re.compile(rf"(?<!\w){re.escape(t)}(?!\w)")) for i, t in items if t and len(t) < q]
        grams = [qgrams(c, q) for c in self.codes]
        key = np.concatenate(grams) if grams else np.zeros(0, np.uint32)
        item = np.repeat(np.arange(len(items)), [len(g) for g in grams]) if grams else np.zeros(0, np.int64)
        at = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.item, self.at = item[order], at[order]
        self.keys, self.first, self.many = np.unique(key[order], return_index=True, return_counts=True)
        self.mask = np.zeros(1 << _MASK_BITS, bool)
        self.mask[self.keys >> np.uint32(32 - _MASK_BITS)] = True

    def matches(self, text: str, codes: np.ndarray | None = None, grams: dict[int, np.ndarray] | None = None) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, errors) of every item that the text holds within its budget; ``codes`` and
        ``grams`` (by q) are the text's, where they are known already."""
        out = [(i, m.start(), m.end(), 0) for i, p in self.short for m in p.finditer(text)]
        if not len(self.keys):
            return out
        codes, known = _codes(text) if codes is None else codes, {} if grams is None else grams
        if self.q not in known:
            known[self.q] = qgrams(codes, self.q)
        grams = known[self.q]
        if not len(grams):
            return out
        spot = np.flatnonzero(self.mask[grams >> np.uint32(32 - _MASK_BITS)])
        if not len(spot):
            return out
        k = np.searchsorted(self.keys, grams[spot])
        k[k == len(self.keys)] = 0
        hit = self.keys[k] == grams[spot]
        spot, k = spot[hit], k[hit]
        many = self.many[k]
        if not len(spot) or many.sum() < self.least.min():
            return out
        entry = np.repeat(self.first[k] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))
        item = self.item[entry]
        diagonal = np.repeat(spot, many) - self.at[entry] + (1 << 30)
        band, count = np.unique(item << 40 | diagonal // self.stride[item], return_counts=True)
        both = count.copy()
        next_to = np.flatnonzero(band[1:] == band[:-1] + 1)
        both[next_to] += count[next_to + 1]
        good = np.flatnonzero(both >= self.least[band >> 40])
        found: dict[int, list[tuple[int, int, int]]] = {}
        for b in good.tolist():
            i = int(band[b] >> 40)
            stride, budget, own = int(self.stride[i]), int(self.budget[i]), self.codes[i]
            low = int(band[b] & ((1 << 40) - 1)) * stride - (1 << 30)
            start, end = max(0, low - budget), min(len(codes), low + 2 * stride + len(own) + budget)
            at = _verbatim(own, codes[start:end])  # as most are, and that is quickly seen
            if at >= 0:
                found.setdefault(i, []).append((start + at, start + at + len(own), 0))
                continue
            errors, stop = banded(own, codes[start:end], budget)
            if errors <= budget:
                back = banded(own[::-1], codes[start : start + stop][::-1], budget)[1]
                found.setdefault(i, []).append((start + stop - back, start + stop, errors))
        for i, spans in found.items():
            for s, e, errors in sorted(spans, key=lambda x: (x[2], x[0])):
                if not any(s < f and e > g for _, g, f, _ in (x for x in out if x[0] == self.ids[i])):
                    out.append((self.ids[i], s, e, errors))
        return out


class Search:
    """Whole items within their budget and, with ``passage``, items of which pieces that cover so many characters occur.

    Pieces of ``PIECE`` characters begin at every ``STEP``-th one, so a stretch of n characters holds pieces that
    cover n - 2 * (STEP - 1) at least."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float, passage: int | None):
        by_q: dict[int, list[tuple[int, str]]] = {}
        for i, t in items:  # the bound is positive for q up to length / (budget + 1)
            n = len(_codes(t))
            by_q.setdefault(min(q, max(1, n // (int(rate * n) + 1))) if n >= q else q, []).append((i, t))
        self.whole = [Index(some, k, rate) for k, some in by_q.items()]
        self.passage, self.items, self.pieces = passage, items, None
        if passage:
            starts = [(k, at) for k, (_, t) in enumerate(items) if len(t) >= passage for at in sorted({*range(0, len(t) - PIECE + 1, STEP), len(t) - PIECE})]
            self.pieces = Index([(k << 32 | at, items[k][1][at : at + PIECE]) for k, at in starts], min(q, PIECE // (int(rate * PIECE) + 1)), rate)

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        codes, grams = _codes(text), {}
        out = [m for index in self.whole for m in index.matches(text, codes, grams)]
        if self.pieces is None:
            return out
        found: dict[int, list[tuple[int, int, int]]] = {}
        for name, start, end, _ in self.pieces.matches(text, codes, grams):
            found.setdefault(name >> 32, []).append((start, end, name & 0xFFFFFFFF))
        for k, spans in found.items():
            item, t = self.items[k]
            whole = [(a, b) for i, a, b, _ in out if i == item]
            groups: list[list[tuple[int, int, int]]] = []
            for span in sorted(spans):
                if groups and span[0] <= max(x[1] for x in groups[-1]) + len(t):
                    groups[-1].append(span)
                else:
                    groups.append([span])
            for group in groups:
                group = [x for x in group if not any(x[0] < b and x[1] > a for a, b in whole)]
                covered = np.zeros(len(t), bool)
                for _, _, at in group:
                    covered[at : at + PIECE] = True
                if covered.sum() >= self.passage:
                    out.append((item, group[0][0], max(x[1] for x in group), int((~covered).sum())))
        return out


def _search(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = index.value.matches
        for batch in batches:
            rows = [(d, *m) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")) for m in find(normal(t.as_py()))]
            if rows:
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c[k], pa.int64()) for k in range(4)] + [pa.array(c[4], pa.int32())], names=["doc_id", "item_id", "start", "end", "errors"])

    return run


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most so many characters, read one after another."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("bigint"), "text").toLocalIterator():
        text = normal(row[1])
        if text:
            if size + len(text) > block_chars and block:
                yield block
                block, size = [], 0
            block.append((row[0], text))
            size += len(text)
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS, passage: int | None = None) -> DataFrame:
    """doc_id, item_id, start, end and errors for every occurrence of a benchmark item in a document.

    With ``passage``, also of items that occur in part or edited, from so many characters in matching pieces on;
    the errors of those are the characters of the item in no such piece."""
    context = ship(docs.sparkSession).sparkContext
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    parts = [docs.mapInArrow(_search(context.broadcast(Search(block, q, error_rate, passage))), MATCHES) for block in _blocks(benchmark, block_chars)]
    return reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], MATCHES)


def without_leaks(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    bad = found.select(F.col("doc_id").alias("_lexmill_bad")).distinct()
    return docs.join(bad, docs.doc_id.cast("bigint").eqNullSafe(F.col("_lexmill_bad")), "left_anti")
