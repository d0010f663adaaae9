"""MinHash near-duplicates by chosen-path set similarity join.

A document's set is its distinct word shingles.  Documents of the same set are one class from the start.
In each of ``trees`` independent trees a class goes to the node of its minwise token; a node that is too
large branches again by the next minwise token of its members, and so on, while small nodes are compared
exhaustively.  From the fourth level on a node branches by two minwise tokens at once, so a pair of
similarity s meets in a leaf of depth d with chance s^min(d,3) * (1 - (1-s)^2)^max(0,d-3), and with the trees
below a pair at the threshold of 0.85 is missed with chance 1e-10 at depth 1, 2e-7 at 2, 1e-5 at 3, 2e-5 at 4
and 3e-5 at 5, the last depth.  A node that is still too large there is compared in pairs of blocks, so
nothing is capped.

Within a leaf, sketches (one byte of each minwise token) choose candidates with a margin of more than four
standard errors, and every link is confirmed on the full sets.  Leaves return spanning forests, never all
pairs: two members that already hang together are not compared again.  Links become components.

A null or empty text has the empty set and is linked with nothing; fewer words than a shingle are one
shingle; texts of any length are taken whole.  A row without doc_id has no component and is not compared.  Rows
that repeat a doc_id and its set are one document; of an id that comes with several sets, the least set by size
and signature is compared in the name of the id.  Equal sets get the component of their smallest id; ties fall
to the smallest id.  Columns other than doc_id and text are ignored, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import cut
from lexmill.llm.components import connected
from lexmill.llm.hashing import by_run, mix, split_words, window_hashes, word_hashes
from lexmill.shipping import ship

TREES = 12
#: Minwise tokens by which a node branches at each depth; their number is the last depth.
BRANCHES = (1, 1, 1, 2, 2)
DEPTH, TOKENS = len(BRANCHES), sum(BRANCHES)
#: Largest node that is compared exhaustively: members, and shingles of all members.
NODE_MEMBERS, NODE_SHINGLES = 4000, 6_000_000
SKETCH_MARGIN = 4.2
_SEEDS = mix(np.arange(1, TREES * TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SIGNATURE = "doc_id bigint, n_shingles bigint, sig1 bigint, sig2 bigint, minwise array<int>, sketch binary"


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    h = word_hashes(split_words(text, lower=True))
    if not len(h):
        return h
    return np.unique(window_hashes(h, min(width, len(h))))


def minwise(shingles: np.ndarray) -> np.ndarray:
    """One minimum for each tree and token."""
    out = np.full(len(_SEEDS), np.uint64(0xFFFFFFFFFFFFFFFF))
    for a in range(0, len(shingles), 4096):
        x = shingles[a : a + 4096]
        y = (x[None, :] ^ _SEEDS[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
        y ^= y >> np.uint64(29)
        y *= np.uint64(0x94D049BB133111EB)
        out = np.minimum(out, y.min(1))
    return out


def _signature(shingles: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over the set."""
    return np.array([mix(shingles).sum(dtype=np.uint64), mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)]).view(np.int64)


def sketch(minima: np.ndarray) -> bytes:
    """A byte of each minimum, mixed first: the upper bits of a minimum over many values are all zero."""
    return (mix(minima) >> np.uint64(56)).astype(np.uint8).tobytes()


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                n, s1, s2, mins, sketches = [], [], [], [], []
                for text in batch.column("text"):
                    s = shingle_set(text.as_py(), width)
                    n.append(len(s))
                    both = _signature(s)
                    s1.append(int(both[0]))
                    s2.append(int(both[1]))
                    m = minwise(s) if len(s) else np.zeros(0, np.uint64)
                    mins.append((m >> np.uint64(32)).astype(np.uint32).view(np.int32))
                    sketches.append(sketch(m) if len(m) else b"")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(mins, pa.list_(pa.int32())), pa.array(sketches, pa.binary())],
                    names=["doc_id", "n_shingles", "sig1", "sig2", "minwise", "sketch"],
                )

    return run


def _leaves(classes: DataFrame) -> DataFrame:
    """(leaf, doc_id, block, blocks): members of every node that is small enough, or of the last depth."""
    first = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(t, F.get(F.col("minwise"), t * TOKENS)).alias("node")))
    rows = classes.select("doc_id", "n_shingles", F.inline(first))
    leaves = []
    for depth, branches in enumerate(BRANCHES):
        if depth:  # only members of large nodes come here; their trees' tokens are fetched for them alone
            if depth == 1:
                rows = rows.join(classes.select("doc_id", "minwise"), "doc_id").withColumn("tokens", F.slice("minwise", F.col("tree") * TOKENS + 1, TOKENS))
            own = F.slice("tokens", sum(BRANCHES[:depth]) + 1, branches)
            rows = rows.select("doc_id", "n_shingles", "tree", "node", "tokens", F.posexplode(own).alias("branch", "token"))
            rows = rows.select("doc_id", "n_shingles", "tree", "tokens", F.xxhash64("node", "tree", "branch", "token").alias("node"))
        # a table of its own, so that both sides of the join come from plain exchanges and AQE can split large nodes
        sizes = cut(rows.groupBy("node").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("shingles")).filter("members > 1"))
        large = (F.col("members") > NODE_MEMBERS) | (F.col("shingles") > NODE_SHINGLES)
        rows = cut(rows.join(sizes, "node").withColumn("large", large))
        blocks = F.lit(1) if depth < DEPTH - 1 else F.ceil(F.greatest(2 * F.col("members") / NODE_MEMBERS, 2 * F.col("shingles") / NODE_SHINGLES)).cast("int")
        leaf = rows if depth == DEPTH - 1 else rows.filter(~F.col("large"))
        leaves.append(leaf.select(F.col("node").alias("leaf"), "doc_id", F.when(F.col("large"), blocks).otherwise(1).alias("blocks")))
        rows = rows.filter("large").drop("members", "shingles", "large")
        if rows.isEmpty():
            break
    out = leaves[0]
    for more in leaves[1:]:
        out = out.union(more)
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(block, i).alias("a"), F.greatest(block, i).alias("b")))
    split = out.filter("blocks > 1").select("doc_id", "leaf", F.explode(pairs).alias("p")).select("doc_id", F.xxhash64("leaf", "p.a", "p.b").alias("leaf"))
    return out.filter("blocks = 1").select("doc_id", "leaf").union(split)


class _Hanging:
    """Members that hang together; only members that do not yet are compared."""

    def __init__(self, sketches: np.ndarray, sizes: np.ndarray, threshold: float):
        self.sketches, self.sizes, self.threshold = sketches, sizes, threshold
        self.least = threshold - SKETCH_MARGIN * (threshold * (1 - threshold) / sketches.shape[1]) ** 0.5
        self.of = np.arange(len(sizes))

    def near(self, i: int) -> np.ndarray:
        """Later members outside i's group whose sizes and sketches could belong to sets of the threshold, the
        likeliest first."""
        a, b = self.sizes[i], self.sizes[i + 1 :]
        near = np.flatnonzero((np.minimum(a, b) >= self.threshold * np.maximum(a, b)) & (self.of[i + 1 :] != self.of[i])) + i + 1
        score = (self.sketches[near] == self.sketches[i]).mean(1)
        near, score = near[score >= self.least], score[score >= self.least]
        return near[np.argsort(-score, kind="stable")]

    def join(self, i: int, others: np.ndarray) -> None:
        self.of[np.isin(self.of, self.of[others])] = self.of[i]


def _matrix(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(table.num_rows, -1)


def _candidates(threshold: float):
    """For each leaf the groups of members that candidate pairs hold together, named by their content."""

    def leaf(table: pa.Table) -> pa.RecordBatch | None:
        ids, sizes = table.column("doc_id").to_numpy(), table.column("n_shingles").to_numpy()
        groups = _Hanging(_matrix(table), sizes, threshold)
        for i in range(len(ids) - 1):
            if len(near := groups.near(i)):
                groups.join(i, near)
        members = [np.flatnonzero(groups.of == g) for g in np.flatnonzero(np.bincount(groups.of) > 1)]
        if not members:
            return None
        names, docs = [], []
        for group in members:
            own = np.sort(ids[group])
            name = mix(mix(own.astype(np.uint64)) * np.arange(1, 2 * len(own), 2, dtype=np.uint64)).sum(dtype=np.uint64, keepdims=True)
            names += name.view(np.int64).tolist() * len(own)
            docs += own.tolist()
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(docs, pa.int64())], names=["party", "doc_id"])

    return lambda batches: by_run(batches, "leaf", leaf)


FILTER_WORDS = 1 << 18


def _bits(ids: np.ndarray) -> np.ndarray:
    """Two places of each id in a filter of FILTER_WORDS * 64 bits."""
    h = mix(ids.astype(np.uint64) ^ np.uint64(0x1234567))
    return np.stack([h % np.uint64(64 * FILTER_WORDS), (h >> np.uint64(32)) % np.uint64(64 * FILTER_WORDS)])


def _bloom(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size over doc_id: what it lets through is still joined exactly, so it only saves
    work, and none once there are too many ids for it."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _bits(batch.column("doc_id").to_numpy(zero_copy_only=False)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bits"])

    rows = ids.mapInArrow(words, "word int, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect()  # FILTER_WORDS rows at most
    out = np.zeros(FILTER_WORDS, np.uint64)
    if rows:
        out[[r["word"] for r in rows]] = np.array([r["bits"] for r in rows], np.int64).view(np.uint64)
    return out


def _sets(width: int, bloom):
    """The shingle sets of documents that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bloom.value
        for whole in batches:
            ids = whole.column("doc_id")
            at = _bits(ids.fill_null(0).to_numpy(zero_copy_only=False))
            hit = ((table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(0)
            whole = whole.filter(pa.array(hit & ~ids.is_null().to_numpy(zero_copy_only=False)))
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sets = [shingle_set(t.as_py(), width) for t in batch.column("text")]
                names = [int(_signature(s)[0]) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "of_sig1", "shingles"])

    return run


def _links(percent: int):
    """A spanning forest of the confirmed links of each group."""

    def party(table: pa.Table) -> pa.RecordBatch | None:
        ids, sizes = table.column("doc_id").to_numpy(), table.column("n_shingles").to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in table.column("shingles").to_pylist()]
        groups, us, vs = _Hanging(_matrix(table), sizes, percent / 100), [], []
        for i in range(len(ids) - 1):
            for j in groups.near(i).tolist():
                if groups.of[i] == groups.of[j]:
                    continue
                both = np.concatenate([sets[i], sets[j]])
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * common >= percent * (len(both) - common):
                    groups.join(i, np.array([j]))
                    us.append(int(ids[i]))
                    vs.append(int(ids[j]))
        return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"]) if us else None

    return lambda batches: by_run(batches, "party", party)


def _classes(all_rows: DataFrame, filled: DataFrame) -> DataFrame:
    """One row, that of the smallest id, for each distinct set."""
    reps = filled.select(F.col("class_id").alias("doc_id"), "sig1", "sig2")
    rows = all_rows.join(reps, ["doc_id", "sig1", "sig2"], "left_semi")
    least = F.min_by(F.struct("n_shingles", "sig1", "minwise", "sketch"), F.struct("n_shingles", "sig1", "sig2"))
    return cut(rows.groupBy("doc_id").agg(least.alias("r")).select("doc_id", "r.*"))


def _parties(classes: DataFrame, percent: int) -> DataFrame:
    """(party, doc_id): groups of classes that candidate pairs hold together, each content once."""
    in_leaves = _leaves(classes).join(classes.select("doc_id", "n_shingles", "sketch"), "doc_id").repartition("leaf").sortWithinPartitions("leaf", "doc_id")
    return cut(in_leaves.select("leaf", "doc_id", "n_shingles", "sketch").mapInArrow(_candidates(percent / 100), "party bigint, doc_id bigint").distinct())


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable) for every row of ``docs``."""
    spark = ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    all_rows = cut(docs.mapInArrow(_signatures(width), _SIGNATURE))
    members = all_rows.select("doc_id", "n_shingles", "sig1", "sig2")
    filled = cut(members.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("sig1", "sig2", "n_shingles").agg(F.min("doc_id").alias("class_id")))
    classes = _classes(all_rows, filled)
    parties = _parties(classes, percent)
    bloom = spark.sparkContext.broadcast(_bloom(parties.select("doc_id").distinct()))
    small = classes.select("doc_id", "n_shingles", "sig1", "sketch").join(parties.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = docs.mapInArrow(_sets(width, bloom), "doc_id bigint, of_sig1 bigint, shingles binary").join(small, "doc_id").filter("of_sig1 = sig1")
    sets = sets.dropDuplicates(["doc_id"])
    ready = parties.join(sets, "doc_id").repartition("party").sortWithinPartitions("party", "doc_id")
    edges = ready.select("party", "doc_id", "n_shingles", "sketch", "shingles").mapInArrow(_links(percent), "u bigint, v bigint")
    labels = connected(edges).select(F.col("doc_id").alias("class_id"), "component_id")
    named = cut(filled.join(labels, "class_id", "left").select("sig1", "sig2", F.coalesce("component_id", "class_id").alias("component_id")))
    out = members.join(named, ["sig1", "sig2"], "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def first_of_each(docs: DataFrame, components: DataFrame) -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their component, and those without an id."""
    first = components.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_lexmill_first")).distinct()
    return docs.join(first, docs.doc_id.cast("bigint") == F.col("_lexmill_first"), "left_semi").unionByName(docs.filter(docs.doc_id.isNull()))
