"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is lower-cased, everything but letters becomes a space, and its character 1- to 4-grams are hashed
to buckets.  The mean of the buckets' embeddings goes through a linear softmax.  Both are trained by
stochastic gradient descent in numpy on a bounded sample of labelled documents (``per_language`` of each
language, chosen by a hash of the id).  As the softmax is linear, embeddings and weights fold into one row
of logits for each bucket, which is all that scoring needs.  A temperature and a rejection threshold are
calibrated on a part of the sample that is not trained on.

Scoring reads whole texts, has no shuffle, and its model has a fixed number of rows.  A text that is null
or has no letter gets ``und`` and score 0; with no labelled row at all every text does.  A null doc_id is kept and
counts as an id of its own in the sample.  Repeated rows are
scored each; texts of any length are taken whole; of languages with equal scores the first in alphabetical order is
predicted; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.shipping import ship

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    logits: np.ndarray  # BUCKETS x languages
    temperature: float
    reject_below: float


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])


def subwords(text: str) -> np.ndarray:
    """Bucket of every 1- to 4-gram that starts with or holds a letter; empty if there is no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    codes = np.where(_letters()[codes], codes, np.uint32(32))
    keep = codes != 32
    if not keep.any():
        return np.zeros(0, np.uint32)
    keep[1:] |= keep[:-1].copy()  # one space after each word
    codes = np.concatenate([np.array([32], np.uint32), codes[keep]])
    parts = []
    mixed = codes * np.uint32(2654435761)
    h = mixed.copy()
    for n in ORDERS:
        if n > 1:
            if len(codes) < n:
                break
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(2246822519) + mixed[n - 1 :]
        parts.append((h ^ (h >> np.uint32(13))) * np.uint32(3266489917) >> np.uint32(16))
    return np.concatenate(parts)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, counts = [], []
        for text in batch.column("text"):
            k, c = np.unique(subwords(text.as_py() or ""), return_counts=True)
            keys.append(k.astype(np.uint16).tobytes())
            counts.append(c.astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "lang", "keys", "counts"])


def sample(docs: DataFrame, per_language: int) -> DataFrame:
    """About ``per_language`` documents of each language, by a hash of their ids."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = labelled.groupBy("lang").count().collect()  # a row for each language
    if not sizes:
        return labelled.limit(0)
    rate = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, per_language / r["count"]))])
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return labelled.filter(draw < rate[F.col("lang")])


def fit(docs: DataFrame, per_language: int = 800, dim: int = 16, epochs: int = 6, rate: float = 0.6, seed: int = 7) -> Model | None:
    """Train on ``docs`` (doc_id, text, lang); rows without text or lang teach nothing."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"), F.col("lang").cast("string").alias("lang"))
    rows = sample(docs, per_language).mapInArrow(_features, "doc_id bigint, lang string, keys binary, counts binary").collect()
    rows = sorted((r for r in rows if len(r["keys"])), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["lang"]))
    if not rows:
        return None
    languages = tuple(sorted({r["lang"] for r in rows}))
    target = np.searchsorted(np.array(languages), [r["lang"] for r in rows])
    keys = [np.frombuffer(r["keys"], np.uint16) for r in rows]
    weights = [np.frombuffer(r["counts"], np.float32) for r in rows]
    weights = [w / w.sum() for w in weights]
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    out = np.zeros((dim, len(languages)), np.float32)
    held = np.arange(len(keys)) % 5 == 4 if len(keys) >= 50 else np.zeros(len(keys), bool)
    train = np.flatnonzero(~held)
    for epoch in range(epochs):
        step = np.float32(rate * (1 - epoch / epochs))
        for i in rng.permutation(train):
            x = weights[i] @ emb[keys[i]]
            z = x @ out
            p = np.exp(z - z.max())
            p /= p.sum()
            p[target[i]] -= 1
            back = out @ p
            out -= step * np.outer(x, p)
            emb[keys[i]] -= step * len(keys[i]) ** 0.5 * np.outer(weights[i], back)
    table = emb @ out
    held = np.flatnonzero(held) if held.any() else train
    z = np.stack([weights[i] @ table[keys[i]] for i in held])
    temperature = min(np.geomspace(0.05, 20, 60), key=lambda t: _loss(z / t, target[held]))
    p = _softmax(z / temperature)
    right = p.argmax(1) == target[held]
    best = p.max(1)
    # the lowest confidence at which 99 % of what is accepted is right
    order = np.argsort(-best)
    precision = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(precision >= 0.99)
    return Model(languages, table.astype(np.float32), float(temperature), float(best[order[good[-1]]]) if len(good) else 1.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _loss(z: np.ndarray, target: np.ndarray) -> float:
    return float(-np.log(np.maximum(_softmax(z)[np.arange(len(z)), target], 1e-12)).mean())


def _score(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [np.ascontiguousarray(model.logits[:, j]) for j in range(len(model.languages))] if model else []
        for batch in batches:
            names, scores, rejected = [], [], []
            for text in batch.column("text"):
                keys = subwords(text.as_py() or "") if model else ()
                if not len(keys):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                z = np.array([[c[keys].mean(dtype=np.float64) for c in columns]])
                p = _softmax(z / model.temperature)[0]
                names.append(model.languages[int(p.argmax())])
                scores.append(float(p.max()))
                rejected.append(scores[-1] < model.reject_below)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model: Model | None, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected (confidence below the calibrated threshold)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out.alias("held_out"), F.col("text"))
    return rows.mapInArrow(_score(model), "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean")
