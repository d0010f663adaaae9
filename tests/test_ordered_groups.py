"""Lane posteriors and decaying moments of groups that spread over tasks, against the plain folds."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from lexmill.operators import learning, model, ordering


@pytest.fixture
def ranges(spark):
    """Many ranges and small batches, so that groups are cut everywhere."""
    keys = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "23"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_long_sessions(ranges):
    rng = random.Random(1)
    sizes = {("a", 1): 1200, ("b", None): 1, (None, 2): 40, ("c", 3): 77, ("d", 4): 2}
    rows = [(g, h, t, None if rng.random() < 0.1 else rng.choice([0.0, rng.uniform(-1.1, 1.1), 800.0 if g == "c" else 1.1, -5.0])) for (g, h), n in sizes.items() for t in range(n)]
    want = {}
    for g, h, t, e in sorted(rows, key=lambda r: r[2]):
        p = want.get((g, h), 0.5)
        if e is None:
            p = 0.5 + (p - 0.5) * 0.8
        else:
            m = 0.92 * p + 0.08 * (1 - p)
            up, down = m * math.exp(min(e, 0)), (1 - m) * math.exp(min(-e, 0))
            p = min(max(up / (up + down), 0.1), 0.9)
        want[g, h] = p
    rng.shuffle(rows)
    frame = ranges.createDataFrame(rows, "g string, h int, t long, evidence double")
    got = {(r.g, r.h): r.p_primary for r in model.lane_posterior(frame, ["g", "h"], "t").collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert model.lane_posterior(frame.limit(0), ["g", "h"], "t").count() == 0


def plain(rows, limit, factor):
    n = mx = my = sx = sy = c = 0.0
    for x, y in rows:
        n += 1
        ox, oy = x - mx, y - my
        mx, my = mx + ox / n, my + oy / n
        sx, sy, c = sx + ox * (x - mx), sy + oy * (y - my), c + ox * (y - my)
        if n > limit:
            n, sx, sy, c = n * factor, sx * factor, sy * factor, c * factor
    return (n, mx, my, *(v / (n - 1) if n > 1 else None for v in (sx, sy, c)))


@pytest.mark.parametrize("limit,factor,block", [(500, 0.5, 1000), (20, 0.5, 2), (7, 0.3, 3), (10, 0.9, 4), (1, 0.5, 5)])
def test_decaying_moments(ranges, limit, factor, block):
    rng = random.Random(limit)
    sizes = {"hot": 1300, "one": 1, "two": 2, None: 30} | {f"k{n}": n for n in (limit, limit + 1, limit + 2, 2 * limit, 2 * limit + 1, 3 * limit + 5)}
    rows = [(k, t, rng.gauss(5, 1), rng.gauss(-3, 2)) for k, n in sizes.items() for t in range(n)]
    frame = ranges.createDataFrame(rows + [("hot", 5, None, 1.0)], "key string, seq long, dx double, dy double")
    got = {r.key: tuple(r)[1:] for r in learning.decaying_moments(frame, limit, factor, block).collect()}
    assert set(got) == set(sizes)
    for k in sizes:
        want = plain([(x, y) for key, _, x, y in rows if key == k], limit, factor)
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-8 * max(1, abs(b))) for a, b in zip(got[k], want)), (k, got[k], want)


@pytest.mark.parametrize("limit,factor", [(500, 0.5), (20, 0.5), (7, 0.3), (10, 0.9), (1, 0.5)])
def test_places_of_cuts(limit, factor):
    """The periodic places are those of a fold, also after thousands of cuts."""
    cuts, again = learning.halvings(limit, factor)
    weight, n, want = 0.0, 0, [0]
    for _ in range(40_000):
        weight += 1
        if weight > limit:
            weight, n = weight * factor, n + 1
        want.append(n)
    assert learning.cuts_until(np.arange(40_001), cuts, again).tolist() == want


def test_numbered_groups(ranges):
    rng = random.Random(2)
    rows = [(k, t, rng.random()) for k, n in (("x", 900), (None, 30), ("y", 1), ("", 12)) for t in range(n)]
    frame = ranges.createDataFrame(rows, "k string, t long, v double").repartition(3)
    got = ordering.numbered(frame, ["k"], ["v"]).collect()
    assert len(got) == len(rows)
    for k in {r.k for r in got}:
        own = sorted((r.v, r.pos) for r in got if r.k == k)
        assert [p for _, p in own] == list(range(len(own)))
