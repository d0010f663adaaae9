"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score is the logistic of ``w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``, computed in linear time
as ``(|sum v_i x_i|^2 - sum |v_i|^2 x_i^2) / 2``.  Words are hashed to a fixed number of buckets; each
statistic and the recorded length fall into bins that are features of their own.  It is trained by AdaGrad
in numpy on a bounded sample of labelled rows (``max_labels``, chosen by a hash of the id).

Scoring reads whole texts, has no shuffle, and its model has a fixed size.  Null texts count as empty and
get a score as all texts do; a null ``n_chars`` counts as the text's own length; repeated rows are scored
each; texts of any length are taken whole; a null doc_id is scored; of several labels of one document the largest
counts, and equal scores need no order; with no label at all every score is 0.5; other columns are ignored, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import words
from lexmill.llm.memory import claim
from lexmill.shipping import ship

WORD_BUCKETS = 1 << 17
BINS = 16
STATISTICS = (
    "log_words", "mean_word_chars", "distinct_words", "top_word", "repeated_lines", "upper", "digits",
    "symbols", "punctuation", "letters", "log_lines", "words_a_line", "ends_with_stop", "repeated_next",
    "log_recorded_chars", "longest_word", "repeated_triples", "words_with_sign",
)
SIZE = WORD_BUCKETS + BINS * len(STATISTICS)
_UPPER, _DIGIT, _SYMBOL, _STOP = re.compile("[A-ZÀ-ÖØ-Þ]"), re.compile("[0-9]"), re.compile("[#*$%&|<>@{}\\[\\]\\\\^~_=+/]"), re.compile("[.,;:!?'\"()-]")
_CACHE: dict[str, int] = {}


def _bucket(word: str) -> int:
    k = _CACHE.get(word)
    if k is None:
        k = zlib.crc32(word.lower().encode()) & (WORD_BUCKETS - 1)
        if len(_CACHE) < 150_000 and len(word) <= 40:
            _CACHE[word] = k
    return k


def statistics(text: str, ws: list[str], recorded: float) -> np.ndarray:
    """The statistics, each scaled to 0..1, in the order of STATISTICS."""
    n, chars = len(ws), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    counts = Counter(ws)
    triples = n - 2 - len(set(zip(ws, ws[1:], ws[2:]))) if n > 2 else 0
    signs = len(_SYMBOL.findall(text))
    upper, digits, stops = len(_UPPER.findall(text)), len(_DIGIT.findall(text)), len(_STOP.findall(text))
    in_words = sum(map(len, ws))
    return np.array([
        np.log1p(n) / 12, in_words / max(1, n) / 24, len(counts) / max(1, n), max(counts.values(), default=0) / max(1, n),
        1 - len(set(lines)) / max(1, len(lines)), upper / chars, digits / chars * 4, signs / chars * 4, stops / chars * 4,
        (in_words - digits - signs - stops) / chars, np.log1p(len(lines)) / 8, np.log1p(n / max(1, len(lines))) / 10,
        sum(x.rstrip()[-1] in ".!?" for x in lines) / max(1, len(lines)), sum(map(str.__eq__, ws, ws[1:])) / max(1, n),
        np.log1p(max(0.0, recorded)) / 16, np.log1p(max(map(len, ws), default=0)) / 8, triples / max(1, n),
        sum(not w[-1].isalnum() for w in ws) / max(1, n),
    ])


def vector(text: str | None, recorded: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features of one document: distinct indexes and their values."""
    claim("word buckets", _CACHE.clear)
    text = text or ""
    ws = words(text)
    keys, counts = np.unique(np.fromiter(map(_bucket, ws), np.int64, len(ws)), return_counts=True)
    value = np.sqrt(counts)
    stats = statistics(text, ws, float(len(text) if recorded is None else recorded))
    bins = np.minimum((np.clip(stats, 0, 1) ** 0.5 * BINS).astype(np.int64), BINS - 1)
    at = WORD_BUCKETS + np.arange(len(STATISTICS)) * BINS + bins
    scale = np.sqrt(np.sum(value**2)) or 1.0
    return np.concatenate([keys, at]), np.concatenate([value / scale, np.full(len(at), len(at) ** -0.5)]).astype(np.float32)


@dataclass(frozen=True)
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[at] * x[:, None]
        s = v.sum(0)
        z = self.bias + float(self.linear[at] @ x) + 0.5 * float(s @ s - np.sum(v * v))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [vector(t, n) for t, n in zip(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([f[0].astype(np.int32).tobytes() for f in found], pa.binary()), pa.array([f[1].tobytes() for f in found], pa.binary())], names=["doc_id", "quality", "at", "x"])


def _inputs(docs: DataFrame, *more: Column) -> DataFrame:
    recorded = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"), recorded.alias("n_chars"), *more)


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = 12_000, rank: int = 8, epochs: int = 6, rate: float = 0.15, decay: float = 1e-5, seed: int = 5) -> Machine | None:
    """Train on the documents that ``labels`` (doc_id, quality) marks; several labels of one document: the largest."""
    ship(docs.sparkSession)
    labels = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    total = labels.count()
    share = min(1.0, max_labels / max(1, total))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(29)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = labels.filter(draw < share).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = F.broadcast(chosen.orderBy(draw, "doc_id").limit(2 * max_labels))  # so many rows at most, of 12 bytes; always the same
    rows = _inputs(docs).join(chosen, "doc_id").select("doc_id", "text", "n_chars", "quality")
    rows = rows.mapInArrow(_features, "doc_id bigint, quality int, at binary, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["doc_id"], r["quality"], r["at"]))
    y = np.array([float(r["quality"] > 0) for r in rows])
    at = [np.frombuffer(r["at"], np.int32) for r in rows]
    xs = [np.frombuffer(r["x"], np.float32) for r in rows]
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3)) ** 0.5
    rng = np.random.default_rng(seed)
    linear, factors = np.zeros(SIZE, np.float32), rng.normal(0, 0.02, (SIZE, rank)).astype(np.float32)
    g_linear, g_factors, g_bias, bias = np.full(SIZE, 1e-3, np.float32), np.full((SIZE, rank), 1e-3, np.float32), 1e-3, 0.0
    for _ in range(epochs):
        for i in rng.permutation(len(at)):
            k, x = at[i], xs[i]
            v = factors[k]
            vx = v * x[:, None]
            s = vx.sum(0)
            z = bias + float(linear[k] @ x) + 0.5 * float(s @ s - np.sum(vx * vx))
            g = float(weight[i] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]))
            if abs(g) < 1e-4:
                continue
            gl = g * x + decay * linear[k]
            gf = g * (x[:, None] * (s - vx)) + decay * v
            g_bias += g * g
            g_linear[k] += gl * gl
            g_factors[k] += gf * gf
            bias -= rate * g / g_bias**0.5
            linear[k] -= rate * gl / np.sqrt(g_linear[k])
            factors[k] = v - rate * gf / np.sqrt(g_factors[k])
    return Machine(bias, linear, factors)


def score(docs: DataFrame, machine: Machine | None, held_out: Column) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    model = ship(docs.sparkSession).sparkContext.broadcast(machine)  # of fixed size, about 5 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = model.value
        for batch in batches:
            found = [fm.score(*vector(t.as_py(), n)) if fm else 0.5 for t, n in zip(batch.column("text"), batch.column("n_chars").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return _inputs(docs, held_out.alias("held_out")).mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """The rows of ``docs`` whose text is predicted to be of quality 1, with all their columns; no shuffle."""
    model = ship(docs.sparkSession).sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = model.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = batch.column("text")
                recorded = batch.column("n_chars").to_pylist() if "n_chars" in batch.schema.names else [None] * batch.num_rows
                yield batch.filter(pa.array([fm is None or fm.score(*vector(t.as_py(), n)) >= 0.5 for t, n in zip(texts, recorded)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
