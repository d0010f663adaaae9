"""Minimum bin slack packing of token sequences.

A bin is filled by a subset-sum dynamic programme over the lengths that are still there: a bitset holds the
reachable fills, and the fullest reachable combination is taken and removed.  Only lengths matter to it, so
it works on the histogram of lengths (at most ``capacity`` rows, whatever the corpus): a combination is
removed as often at once as the histogram allows.  The resulting plan gives bins to the pieces of each
length by their rank; ranks are counted within groups of about ``GROUP_ROWS`` pieces of one length, so that no
length meets in one task.

Null or empty texts are a document of the end id alone; repeated rows are packed each; an empty table gives
no rows; other columns are ignored, whatever their names.  Only documents longer than the capacity are cut, those
of any length whole; a null doc_id is packed; pieces of equal length take seats in the order of doc_id and piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import cut
from lexmill.llm.encoding import encode_with_end, encoder, slices, vocabulary_path
from lexmill.shipping import ship

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary"
#: Pieces of one length that are ranked together, about.
GROUP_ROWS = 20_000


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, bounds = encode_with_end(enc, batch.column("text"), end_id)
                count = -(-np.diff(bounds) // capacity)
                of = np.repeat(np.arange(batch.num_rows), count)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, np.diff(bounds)[of] - start)
                first = np.append(bounds[:-1][of] + start, bounds[-1])
                raw = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer((4 * first).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids, "<i4"))])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), raw], names=["doc_id", "piece", "start", "length", "ids"])

    return run


def token_pieces(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """The documents' ids with ``end_id`` appended, cut where longer than ``capacity``: doc_id, piece, start,
    length and ids (little-endian unsigned 32-bit)."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.mapInArrow(_pieces(vocabulary or vocabulary_path(), end_id, capacity), PIECES)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to ``room``; long lengths come first."""
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []  # reachable before, length, how many at once
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, block = min(counts[length], room // length), 1
        while left > 0 and not reach >> room & 1:
            block = min(block, left)
            steps.append((reach, length, block))
            reach |= reach << (length * block) & mask
            left -= block
            block *= 2
        if reach >> room & 1:
            break
    fill, chosen = reach.bit_length() - 1, {}
    for before, length, block in reversed(steps):
        if not before >> fill & 1:
            chosen[length] = chosen.get(length, 0) + block
            fill -= length * block
    return chosen


def slack_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, combination) until the histogram is used up.  Each bin holds the longest length left."""
    left = {k: v for k, v in histogram.items() if v > 0}
    if any(k > capacity or k < 1 for k in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    plan = []
    while left:
        first = max(left)
        left[first] -= 1
        combination = fullest({k: v for k, v in left.items() if v}, capacity - first)
        left[first] += 1
        combination[first] = combination.get(first, 0) + 1
        times = min(left[k] // n for k, n in combination.items())
        for k, n in combination.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        plan.append((times, combination))
    return plan


def _seats(plan: list[tuple[int, dict[int, int]]], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, first bin, how many to a bin and offset of each combination."""
    seats: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for times, combination in plan:
        offset = 0
        for length in sorted(combination, reverse=True):
            n = combination[length]
            seats.setdefault(length, []).append((used.get(length, 0), base, n, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        base += times
    return {k: tuple(np.array(x, dtype=np.int64) for x in zip(*v)) for k, v in seats.items()}


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (doc_id, piece, length and more columns, none of them ids) with sequence_id and offset.

    ``pieces`` is read several times: it should be a table or a checkpoint."""
    lengths = cut(pieces.groupBy("length").agg(F.count(F.lit(1)).alias("_n")))  # at most capacity rows
    histogram = {int(r[0]): int(r[1]) for r in lengths.collect()}
    salts = lengths.select("length", F.ceil(F.col("_n") / GROUP_ROWS).alias("_salts"))
    salted = pieces.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("_salts")).cast("int")).drop("_salts")
    sizes = cut(salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")))  # a row for GROUP_ROWS pieces, and one for each length at most
    seats = _seats(slack_plan(histogram, capacity), capacity)
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1
    ranked = salted.withColumn("_rank", rank).join(offsets, ["length", "_salt"])  # both are dealt out by these keys
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before")).select(*pieces.columns, "_rank")

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def seat(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, at = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        seq, off = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        order = np.argsort(size, kind="stable")
        cuts = np.flatnonzero(np.diff(size[order])) + 1
        for rows in np.split(order, cuts) if len(order) else []:
            first, base, n, offset = seats[int(size[rows[0]])]
            k = np.searchsorted(first, at[rows], side="right") - 1
            j = at[rows] - first[k]
            seq[rows], off[rows] = base[k] + j // n[k], offset[k] + j % n[k] * size[rows]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    return ranked.withColumn("_seat", seat("length", "_rank")).select(*pieces.columns, "_seat.sequence_id", "_seat.offset")


def packed_digests(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Pieces with the crc32 of their ids in place of the ids, and their seats."""
    pieces = token_pieces(docs, vocabulary, end_id, capacity)
    return pack(cut(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))), capacity)


def packed_sequences(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """sequence_id, n_tokens, ids (little-endian unsigned 32-bit) and pieces (offset, doc_id, piece, length) of every
    sequence: what a training job reads.  A sequence has ``capacity`` ids at most, so its pieces meet in one row."""
    seated = pack(cut(token_pieces(docs, vocabulary, end_id, capacity).select("doc_id", "piece", "length", "ids")), capacity)
    held = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    rows = seated.groupBy("sequence_id").agg(held.alias("held"), F.sum("length").alias("n_tokens"))
    ids = F.aggregate(F.transform("held", lambda h: h["ids"]), F.lit(b""), lambda a, b: F.concat(a, b))
    return rows.select("sequence_id", "n_tokens", ids.alias("ids"), F.transform("held", lambda h: F.struct(*(h[c].alias(c) for c in ("offset", "doc_id", "piece", "length")))).alias("pieces"))
