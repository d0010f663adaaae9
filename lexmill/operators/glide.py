"""Trajectories against a vocabulary: prune by end keys and length, resample, normalise, score, rank."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lexmill.config import key_centers

POINTS, RADIUS = 200, 1.0
SHAPE_SD, LOCATION_SD, LENGTH_LIMIT = 22.08, 0.5109, 8.42


def centers() -> Column:
    """Map from letter to struct(x, y)."""
    return F.create_map(*[c for k, (x, y) in sorted(key_centers().items()) for c in (F.lit(k), F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")))])


def ideal_path(word: Column) -> Column:
    """The key centres of a word's letters, a letter twice in a row once; null if a letter has no key."""
    letters = F.filter(F.split(word, ""), lambda c: c != "")
    single = F.filter(letters, lambda c, i: (i == 0) | (c != F.get(letters, i - 1)))
    at = F.transform(single, lambda c: F.try_element_at(centers(), c))
    return F.when(F.forall(at, lambda p: p.isNotNull()), at)


def thinned(points: Column, least: float = 0.25) -> Column:
    """The points of a stroke that lie further than ``least`` key widths from the last one kept; the first stays."""
    def step(kept: Column, p: Column) -> Column:
        last = F.element_at(kept, -1)
        far = F.hypot(p["x"] - last["x"], p["y"] - last["y"]) > least
        return F.when(far, F.concat(kept, F.array(p))).otherwise(kept)

    return F.aggregate(points, F.slice(points, 1, 1), step)


def path_length(path: Column) -> Column:
    steps = F.transform(F.slice(path, 2, 100_000), lambda p, i: F.hypot(p["x"] - F.get(path, i)["x"], p["y"] - F.get(path, i)["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda a, s: a + s)


def near_keys(points: Column, count: int = 2) -> Column:
    """The keys nearest to a point, nearest first."""
    keys = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(k).alias("k")) for k, (x, y) in sorted(key_centers().items())])
    far = F.transform(keys, lambda k: F.struct((F.pow(k["x"] - points["x"], F.lit(2.0)) + F.pow(k["y"] - points["y"], F.lit(2.0))).alias("d"), k["k"].alias("k")))
    return F.transform(F.slice(F.array_sort(far), 1, count), lambda k: k["k"])


def pruned(gestures: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """gesture_id, word, frequency, points and path of words that begin and end near the gesture's ends and are
    about as long: an equi-join on first and last letter."""
    words = vocabulary.withColumn("path", ideal_path(F.col("word"))).filter(F.col("path").isNotNull() & (F.size("path") > 1))
    words = words.select("word", "frequency", "path", path_length(F.col("path")).alias("ideal"), F.left("word", F.lit(1)).alias("first"), F.right("word", F.lit(1)).alias("last"))
    ends = gestures.select("gesture_id", "points", path_length(F.col("points")).alias("drawn"), F.explode(near_keys(F.get("points", 0))).alias("first"), near_keys(F.element_at("points", -1)).alias("lasts"))
    ends = ends.select("gesture_id", "points", "drawn", "first", F.explode("lasts").alias("last"))
    return ends.join(words, ["first", "last"]).filter(F.abs(F.col("drawn") - F.col("ideal")) < LENGTH_LIMIT * RADIUS)


def _resample(points: np.ndarray) -> np.ndarray:
    along = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(points, axis=0).T))])
    at = np.linspace(0, along[-1], POINTS)
    return np.stack([np.interp(at, along, points[:, 0]), np.interp(at, along, points[:, 1])], 1)


def _normalised(points: np.ndarray) -> np.ndarray:
    low, high = points.min(0), points.max(0)
    return (points - (low + high) / 2) / max(float((high - low).max()), 1e-9)


@F.pandas_udf(ArrayType(DoubleType()))
def distances(gesture_id: pd.Series, points: pd.Series, word: pd.Series, path: pd.Series) -> pd.Series:
    """[shape, location]: summed distance of the normalised curves, mean city-block distance of the curves.

    A gesture or word that recurs in a batch is resampled once."""
    seen: dict = {}

    def curve(kind: int, name, raw) -> tuple[np.ndarray, np.ndarray]:
        if (kind, name) not in seen:
            p = _resample(np.array([(r["x"], r["y"]) for r in raw], float))
            seen[kind, name] = p, _normalised(p)
        return seen[kind, name]

    def one(g, a, w, b):
        (p, pn), (q, qn) = curve(0, g, a), curve(1, w, b)
        d = pn - qn
        return [float(np.sqrt(d[:, 0] ** 2 + d[:, 1] ** 2).sum()), float(np.abs(p - q).sum() / POINTS / 2)]

    return pd.Series([one(*x) for x in zip(gesture_id, points, word, path)])


def _gauss(x: Column, sd: float) -> Column:
    return F.exp(-0.5 * F.pow(x / sd, F.lit(2.0))) / (sd * (2 * np.pi) ** 0.5)


def classified(gestures: DataFrame, vocabulary: DataFrame, limit: int = 8) -> DataFrame:
    """The best words of each gesture; a word counts once, with its best score."""
    rows = pruned(gestures, vocabulary).dropDuplicates(["gesture_id", "word"]).withColumn("d", distances("gesture_id", "points", "word", "path"))
    score = 1 / (_gauss(F.get("d", 0), SHAPE_SD) * _gauss(F.get("d", 1), LOCATION_SD * RADIUS) * 255 * F.col("frequency"))
    order = Window.partitionBy("gesture_id").orderBy(F.col("score"), "word")
    return rows.withColumn("score", score).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("gesture_id", "word", "score", "rank")
