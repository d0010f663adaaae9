"""Conversations from trees of replies: paths by iterative self-joins, branches ranked by score, one text a path.

Messages name the message they reply to.  Each round of joins doubles how far a message looks up its tree, so a tree
of depth d takes about log2(d) rounds; rounds work on the messages that have not met their root yet.  A leaf then
knows its root, its depth and the sum of scores on its path.  Leaves of a root are ranked by that sum, in parts first
where one root has many.  Paths of the chosen leaves are written out by the same jumps, longest first, each of which
doubles the messages that a path has so far: rows are those of the result, and no task holds a tree.

A chosen path becomes one text.  Turns are marked; control strings inside texts and roles are escaped reversibly, and
spans of characters say which parts are to be learned: the assistant's texts, nothing of the template.  Turns are
joined in blocks, then blocks in their path's row.

A null role or text is empty; a reply to a message that is not there is a root; messages that reply to each other in
a ring have no root and are in no path; message ids must be unique and not null; leaves of equal score go by the
deeper one, then by id; texts of any length are taken whole; other columns are ignored, whatever their names; an
empty table gives no rows.  ``as_messages`` gives conversations of numbered turns that form: null turns come first,
rows that repeat a turn are ordered by role and text and all stay, a null conv_id is a conversation of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import Stored, cut
from lexmill.llm.ordering import numbered
from lexmill.shipping import ship

BEGIN, END, TURN, TURN_END = "<s>", "</s>", "<|im_start|>", "<|im_end|>"
#: Strings that steer a model; inside texts a backslash goes between the first sign and the rest.
CONTROL = (BEGIN, END, TURN, TURN_END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LEARNED = "assistant"
#: Turns that are joined in one row before blocks are.
BLOCK_TURNS = 256
#: Parts that the leaves of one root are ranked in first.
RANK_PARTS = 64


def _places(before: str) -> str:
    """A pattern for the place after the first sign of a control string, with ``before`` what stands there."""
    ways = []
    for sign in sorted({c[0] for c in CONTROL}):
        rest = "|".join(re.escape(c[1:]) for c in CONTROL if c[0] == sign)
        ways.append(rf"(?<={re.escape(sign)}){before}(?=\\*(?:{rest}))")
    return "|".join(ways)


_ESCAPED = re.compile(_places(r"\\"))
_ROLE_SIGNS = {"\\": "\\\\", "\n": "\\n", "<": "\\l", "[": "\\k"}
_TURNS = re.compile(re.escape(TURN) + r"([^\n]*)\n(.*?)" + re.escape(TURN_END) + "\n", re.S)


def escaped(text: Column) -> Column:
    """``text`` without any control string; ``unescaped`` gives it back."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _places(""), "\\\\")


def unescaped(text: str) -> str:
    return _ESCAPED.sub("", text)


def escaped_role(role: Column) -> Column:
    out = F.coalesce(role, F.lit(""))
    for sign, instead in _ROLE_SIGNS.items():
        out = F.replace(out, F.lit(sign), F.lit(instead))
    return out


def unescaped_role(role: str) -> str:
    back = {v[1]: k for k, v in _ROLE_SIGNS.items()}
    return re.sub(r"\\(.)", lambda m: back[m[1]], role)


def climbed(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """message, root, depth and total (scores from the root to it) of every message (message, parent, score) below a
    root, and for each power of two the messages with so many others above them, with the one they reach (message, above)."""
    nodes = messages.select("message", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"))
    there = nodes.select(F.col("message").alias("above"))
    # where each message stands: above is null once it has met its root
    rows = cut(nodes.join(there, F.col("parent") == F.col("above"), "left").select("message", "above", F.col("message").alias("root"), F.lit(0).cast("bigint").alias("depth"), "total"))
    done, active, jumps, step = rows.filter("above IS NULL"), rows.filter("above IS NOT NULL"), [], 1
    rounds = rows.count().bit_length() + 1  # more than any tree needs; what is left then goes round in rings
    while len(jumps) < rounds and not active.isEmpty():
        jumps.append(active.select("message", "above"))
        upper = done.unionByName(active).select(F.col("message").alias("_at"), *(F.col(c).alias(f"_{c}") for c in ("above", "root", "depth", "total")))
        met = F.col("_above").isNull()
        moved = active.join(upper, F.col("above") == F.col("_at")).select(
            "message", F.col("_above").alias("above"), F.when(met, F.col("_root")).otherwise(F.col("root")).alias("root"),
            F.when(met, F.col("_depth") + step).otherwise(F.col("depth")).alias("depth"), (F.col("total") + F.col("_total")).alias("total"),
        )
        moved = cut(moved)
        done, active, step = done.unionByName(moved.filter("above IS NULL")), moved.filter("above IS NOT NULL"), 2 * step
    return done.select("message", "root", "depth", "total"), jumps


def ranked_leaves(messages: DataFrame, stand: DataFrame, branches: int | None) -> DataFrame:
    """message, root, depth, total and rank of each root's ``branches`` best leaves (all of them, without rank, for None)."""
    replied = messages.filter("parent IS NOT NULL").select(F.col("parent").alias("message")).distinct()
    leaves = stand.join(replied, "message", "left_anti")
    if branches is None:
        return leaves.withColumn("rank", F.lit(None).cast("bigint"))
    order = [F.desc("total"), F.desc("depth"), F.asc("message")]
    salt = F.pmod(F.xxhash64("message"), F.lit(RANK_PARTS))
    part = leaves.withColumn("_salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("root", "_salt").orderBy(*order))).filter(F.col("rank") <= branches)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= branches).drop("_salt")


def paths(leaves: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """path (the leaf), depth and message of every message on the way from the root to each leaf."""
    rows = leaves.select(F.col("message").alias("path"), "depth", "message")
    for k in range(len(jumps) - 1, -1, -1):
        up = jumps[k].withColumnRenamed("message", "_at")
        higher = rows.join(up, F.col("message") == F.col("_at")).select("path", (F.col("depth") - (1 << k)).alias("depth"), F.col("above").alias("message"))
        rows = cut(rows.unionByName(higher))
    return rows


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of turns of a path as one text, with the spans to be learned."""
    for batch in batches:
        texts, spans, turns = [], [], []
        for blocks in batch.column("blocks"):
            blocks = sorted(blocks.as_py(), key=lambda b: b["block"])
            lead, body, chars, learned = (np.array([x for b in blocks for x in b[c]], np.int64) for c in ("lead", "body", "chars", "learned"))
            start = len(BEGIN) + np.cumsum(chars) - chars + lead
            own = learned > 0
            texts.append(BEGIN + "".join(b["text"] for b in blocks) + END)
            spans.append([{"start": a, "end": b} for a, b in zip(start[own].tolist(), (start + body)[own].tolist())])
            turns.append(len(chars))
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(turns, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["path", "n_turns", "text", "spans"])


def formatted(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """path, root, total, rank, n_turns, text and spans (start and end, in characters, of what is to be learned) of each
    root's ``branches`` best paths through ``messages`` (message, parent, role, text, score).

    ``messages`` is read several times: it should be a table or a checkpoint."""
    ship(messages.sparkSession)
    stand, jumps = climbed(messages)
    leaves = cut(ranked_leaves(messages, stand, branches))
    lead = F.concat(F.lit(TURN), escaped_role(F.col("role")), F.lit("\n"))
    pieces = messages.select("message", lead.alias("lead"), escaped(F.col("text")).alias("body"), F.coalesce(F.col("role") == LEARNED, F.lit(False)).cast("int").alias("learned"))
    turns = paths(leaves, jumps).join(pieces, "message")
    text = F.concat("lead", "body", F.lit(TURN_END + "\n"))
    counted = {"lead": F.length("lead"), "body": F.length("body"), "chars": F.length(text), "learned": F.col("learned")}
    turn = F.struct("depth", text.alias("text"), *(n.cast("bigint").alias(c) for c, n in counted.items()))
    blocks = turns.groupBy("path", F.expr(f"depth div {BLOCK_TURNS}").alias("block")).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    block = F.struct("block", F.array_join("t.text", "").alias("text"), *(F.col(f"t.{c}").alias(c) for c in ("lead", "body", "chars", "learned")))
    whole = blocks.select("path", block.alias("b")).groupBy("path").agg(F.collect_list("b").alias("blocks"))
    kind = messages.select(F.col("message").alias("path")).schema["path"].dataType.simpleString()
    done = whole.mapInArrow(_texts, f"path {kind}, n_turns bigint, text string, spans array<struct<start: bigint, end: bigint>>")
    return leaves.select(F.col("message").alias("path"), "root", "total", "rank").join(done, "path")


def as_messages(conversations: DataFrame) -> DataFrame:
    """conv_id, message, parent, role, text and score of conversations (conv_id, turn, role, text): each turn replies to the one before."""
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    order = [F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text")]
    at = numbered(rows, "conv_id", order, [F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.substring("text", 1, 32)])
    name = lambda pos: F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit("/"), pos.cast("string"))
    return at.select("conv_id", name(F.col("pos")).alias("message"), F.when(F.col("pos") > 0, name(F.col("pos") - 1)).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def turns_of(text: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation."""
    if not text.startswith(BEGIN) or not text.endswith(END):
        raise ValueError("not a formatted conversation")
    return [(unescaped_role(r), unescaped(t)) for r, t in _TURNS.findall(text)]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text"), batch.column("spans")):
            text, turns, loss = text.as_py(), hashlib.sha256(), hashlib.sha256()
            n = chars = 0
            for role, said in turns_of(text):
                turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                n += 1
            for span in spans.as_py():
                part = unescaped(text[span["start"] : span["end"]])
                loss.update(part.encode("utf-8", "surrogatepass"))
                chars += len(part)
            rows.append((n, turns.hexdigest(), chars, loss.hexdigest(), len(text)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("root"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["root", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def written(conversations: DataFrame, branches: int | None = 1) -> DataFrame:
    """The formatted conversations, written as Parquet to the shared folder and read back; ``root`` is their conv_id and "/0"."""
    return Stored(formatted(cut(as_messages(conversations)), branches), "conversations").rows


def digests(texts: DataFrame) -> DataFrame:
    """conv_id and digests of what formatted conversations say when they are parsed again."""
    rows = texts.select("root", "text", "spans").mapInArrow(_digests, "root string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    conv_id = F.expr("cast(nullif(substring_index(root, '/', 1), '') AS bigint)")
    return rows.select(conv_id.alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
