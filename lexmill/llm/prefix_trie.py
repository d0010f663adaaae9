"""The trie of conversation prefixes, by ownership of the smallest member.

A node stands for the conversations that begin with the same turns.  Its smallest member owns it; along a conversation
the nodes that it owns are a suffix, since deeper nodes have fewer members.  So every sum over a subtree is a sum over
the members of its top: a member gives the tokens of its turns from there on, less those of the nodes that it owns
from there on (each node of the subtree is owned by one member), and one leaf if it owns one.  Windows mark who owns
a node, and one grouping by prefix adds everything up, with sums made in each task first.

Texts are left behind at once: a turn is a digest of role and text, a prefix the exclusive or of its turns' 64-bit
hashes, each hashed together with its depth, twice with different salts (128 bits).

A prefix may have a third of all conversations, and a conversation a third of all turns: nodes are marked among parts
of their members first and then among the parts' smallest, prefixes are run within blocks of a conversation and then
over blocks, joins by conversation leave Spark a side that it can split.

A null role or text is empty; null turns come first, rows that repeat a turn are ordered by role and then by digest
and all stay; rows without conv_id belong to no conversation; remainders have the sign of the number, as in SQL; texts
of any length are taken whole; other columns are ignored, whatever their names; without conversations there is no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import WORD, cut
from lexmill.llm.ordering import numbered
from lexmill.shipping import ship

#: Turns of one conversation that are run through in one task before blocks are.
BLOCK = 4096
#: Ids that travel as one text on the way to their digest.
PIECE = 4096
_NODE = ["depth", "k1", "k2"]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), digest and tokens of the turns of conversations (conv_id, turn, role, text)."""
    ship(conversations.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    slim = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256).alias("digest"), F.size(F.regexp_extract_all(text, F.lit(WORD), 0)).cast("bigint").alias("tokens"),
    )
    return numbered(slim, "conv_id", [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]).select("conv_id", "pos", "digest", "tokens")


def with_shared_heads(rows: DataFrame, family: int = 20, longest: int = 3) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first of their family does: occurrences (conv_id, depth from 1, digest, tokens)
    and conversations (conv_id, length).

    Conversation c takes the first h turns of conversation c - c % ``family`` in place of its own first h, with h the
    crc32 of its number in decimals modulo ``longest`` + 1.  ``rows`` are ``turns``, kept in a table."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(longest + 1)).cast("int")
    convs = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    heads = rows.filter((F.col("conv_id") % family == 0) & (F.col("pos") < longest))
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "tokens"))).alias("head"))  # ``longest`` turns at most
    convs = convs.join(heads, "base", "left").withColumn("head", F.when(F.col("h") == 0, F.array()).otherwise(F.slice(F.coalesce("head", F.array()), F.lit(1), F.greatest("h", F.lit(1)))))
    convs = cut(convs.withColumn("n", F.size("head")).withColumn("length", F.col("n") + F.greatest(F.lit(0), F.col("own") - F.col("h"))))
    first = convs.select("conv_id", F.explode("head").alias("x")).select("conv_id", (F.col("x.pos") + 1).alias("depth"), "x.digest", "x.tokens")
    moved = rows.join(convs.select("conv_id", "h", "n"), "conv_id").filter("pos >= h")
    rest = moved.select("conv_id", (F.col("n") + F.col("pos") - F.col("h") + 1).cast("bigint").alias("depth"), "digest", "tokens")
    return first.unionByName(rest), convs.select("conv_id", F.col("length").cast("bigint").alias("length"))


def _run_along(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, depth, x1, x2, tokens) with k1, k2 (exclusive or up to here) and run (sum of tokens up to here)."""
    rows = cut(rows.withColumn("block", F.expr(f"depth div {BLOCK}")))
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"k1": (F.bit_xor, "x1"), "k2": (F.bit_xor, "x2"), "run": (F.sum, "tokens")}
    blocks = rows.groupBy("conv_id", "block").agg(*(f(c).alias(n) for n, (f, c) in sums.items()))
    carried = blocks.select("conv_id", "block", *(f(n).over(before).alias(f"_{n}") for n, (f, _) in sums.items())).filter("block > 0")
    out = rows.select("*", *(f(c).over(inside).alias(n) for n, (f, c) in sums.items())).join(carried, ["conv_id", "block"], "left")
    for n in sums:
        earlier = F.coalesce(f"_{n}", F.lit(0).cast("bigint"))
        out = out.withColumn(n, F.col(n) + earlier if n == "run" else F.col(n).bitwiseXOR(earlier))
    return out.drop("block", *(f"_{n}" for n in sums))


def _marked(rows: DataFrame) -> DataFrame:
    """``rows`` with owned (whether conv_id is the smallest of its node) and, where it is, deepest (the longest member)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("conv_id"), F.lit(parts)).cast("int"))
    part = Window.partitionBy(*_NODE, "_salt")
    ranked = salted.withColumn("_first", F.row_number().over(part.orderBy("conv_id")) == 1).withColumn("_far", F.max("length").over(part))
    # the smallest of each part meet in one window a node; the others own nothing and stay outside it by a key of their own
    outside = F.when(F.col("_first"), F.lit(None)).otherwise(F.xxhash64("conv_id"))
    node = Window.partitionBy(*_NODE, outside)
    out = ranked.withColumn("owned", F.col("_first") & (F.row_number().over(node.orderBy("conv_id")) == 1)).withColumn("deepest", F.max("_far").over(node))
    return out.drop("_salt", "_first", "_far")


def _pieces(most: int):
    """Ids of a node in a row, comma-joined, with the place of the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        last = at = None

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in last), pa.array([at], pa.int64()), pa.array([",".join(held)])], names=[*_NODE, "first", "ids"])
            held.clear()
            return out

        for batch in batches:
            for *node, conv_id in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "conv_id"))):
                if held and (node != last or len(held) >= most):
                    yield flush()
                if not held:
                    last, at = node, conv_id
                held.append(str(conv_id))
        if held:
            yield flush()

    return run


def _joined_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's pieces, which come in order; only one piece is held at a time."""
    last, digest = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in last), pa.array([digest.hexdigest()])], names=[*_NODE, "ends_sha256"])

    for batch in batches:
        for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "ids"))):
            if node != last:
                if last is not None:
                    yield done()
                last, digest = node, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if last is not None:
        yield done()


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, k1, k2 and ends_sha256 of the nodes that conversations (conv_id, depth, k1, k2) end at."""
    keys = ", ".join(f"{c} bigint" for c in _NODE)
    ranged = ends.repartitionByRange(*_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id")
    pieces = ranged.mapInArrow(_pieces(PIECE), f"{keys}, first bigint, ids string")
    return pieces.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(_joined_digests, f"{keys}, ends_sha256 string")


def trie(occurrences: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node of
    conversations (conv_id, length) with turns (conv_id, depth from 1, digest, tokens)."""
    zero = F.lit(0).cast("bigint")
    keyed = occurrences.select("conv_id", "depth", F.xxhash64(F.lit("a"), "digest", "depth").alias("x1"), F.xxhash64(F.lit("b"), "digest", "depth").alias("x2"), "tokens")
    root = convs.select("conv_id", zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), zero.alias("tokens"))
    run = _run_along(root.unionByName(keyed)).join(convs, "conv_id")
    marked = cut(_marked(run))
    sums = marked.groupBy("conv_id").agg(
        F.sum("tokens").alias("all"), F.coalesce(F.sum(F.when(F.col("owned"), F.col("tokens"))), zero).alias("mine"), F.min(F.when(F.col("owned"), F.col("depth"))).alias("since"),
        F.max(F.when(F.col("owned") & (F.col("depth") == F.col("length")) & (F.col("deepest") == F.col("depth")), 1).otherwise(0)).cast("bigint").alias("leaf"),
    )
    given = F.when(F.col("owned"), zero).otherwise(F.col("all") - F.col("run") + F.col("tokens") - F.col("mine"))
    child = F.coalesce((F.col("depth") + 1 >= F.col("since")) & (F.col("depth") < F.col("length")), F.lit(False)).cast("bigint")
    members = marked.join(sums, "conv_id").select(*_NODE, "conv_id", F.struct(F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2")).alias("above"), given.alias("given"), child.alias("child"), "leaf")
    nodes = cut(
        members.groupBy(*_NODE).agg(
            F.min("conv_id").alias("conv_id"), F.min("above").alias("above"), F.count(F.lit(1)).alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("given").alias("saved_tokens"),
        )
    )
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.select("*", "above.*").drop("above").join(parents, ["depth", "p1", "p2"], "left")
    ends = end_digests(marked.filter("depth = length").select("conv_id", *_NODE))
    return nodes.join(ends, _NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    )


def shared_trie(conversations: DataFrame) -> DataFrame:
    """``trie`` of conversations (conv_id, turn, role, text) that begin as the first of their family does."""
    return trie(*with_shared_heads(cut(turns(conversations))))
