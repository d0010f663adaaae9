"""Batch edit distances against row-by-row versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.config import ACUTE, CONFUSIONS, LANE_CONFUSIONS, substitution_cost
from lexmill.operators import alignment
from lexmill.operators import candidates as C

INSERTION, DELETION, TRANSPOSITION = 4.0, 4.0, 2.0


def plain(a, b, substituted, omitted, inserted, swapped):
    add = lambda s, c: tuple(x + y for x, y in zip(s, c))
    row, before = [(0.0, 0, 0)], None
    for y in b:
        row.append(add(row[-1], omitted(y)))
    for i, x in enumerate(a, 1):
        new = [add(row[0], (inserted, 1, 0))]
        for j, y in enumerate(b, 1):
            best = min(add(row[j - 1], substituted(x, y)), add(row[j], (inserted, 1, 0)), add(new[-1], omitted(y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != a[i - 2]:
                best = min(best, add(before[j - 2], (swapped, 1, 0)))
            new.append(best)
        before, row = row, new
    return row[-1]


def plain_channel(a, b, p):
    t, u = min(max((p - 0.5) / 0.25, 0.0), 1.0), min(max((1 - p - 0.5) / 0.25, 0.0), 1.0)
    w, v = t * t * (3 - 2 * t), u * u * (3 - 2 * u)

    def substituted(x, y):
        if x == y:
            return 0.0, 0, 0
        if ACUTE.get(y) == x:
            return max(0.02, 0.35 * (1 - w)), 0, 1
        if x + y in LANE_CONFUSIONS:
            return max(0.02, 1.5 * (1 - 0.5 * w)), 0, 1
        return substitution_cost(x, y), 1, 0

    return plain(a, b, substituted, lambda y: (max(0.02, min(DELETION, DELETION * (1 - v))), 0, 1) if y in "'’" else (DELETION, 1, 0), INSERTION, TRANSPOSITION)


FREE = {a + b for b, a in ACUTE.items()} | {b + a for b, a in ACUTE.items()} | set(CONFUSIONS)


def pairs(n=400):
    rng = random.Random(9)
    letters = "aábdðeéioóöþtv'’nñ日😀z "
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 7))) for _ in range(n)]
    out = [(w, "".join(rng.choice([c, c, c, c + c, "", rng.choice(letters)]) for c in w)) for w in words]
    out += [(w[::-1], w) for w in words[:40]] + [(w[1::-1] + w[2:], w) for w in words[:80]] + [(rng.choice(words), rng.choice(words)) for _ in range(100)] + [("", ""), ("", "a"), ("b", "")]
    return out, [rng.choice([0.0, 0.3, 0.5, 0.6, 0.7, 0.9, 1.0]) for _ in out]


def test_batches_equal_single_pairs():
    both, p = pairs()
    typed, words = [a for a, _ in both], [b for _, b in both]
    cost = alignment.typing_costs(typed, words, INSERTION, DELETION, TRANSPOSITION)
    edits = alignment.rewrite_distances(typed, words)
    total, errors, restored = alignment.channel_costs(typed, words, np.array(p), INSERTION, DELETION, TRANSPOSITION)
    for k, (a, b) in enumerate(both):
        assert cost[k] == plain(a, b, lambda x, y: (substitution_cost(x, y), 0, 0), lambda y: (DELETION, 0, 0), INSERTION, TRANSPOSITION)[0], (a, b)
        assert edits[k] == plain(a, b, lambda x, y: (float(x != y and x + y not in FREE), 0, 0), lambda y: (float(y not in "'’"), 0, 0), 1.0, 1.0)[0], (a, b)
        assert (total[k], errors[k], restored[k]) == plain_channel(a, b, p[k]), (a, b, p[k])


def test_columns_with_nulls(spark):
    both, p = pairs(60)
    rows = [(a, b, q) for (a, b), q in zip(both, p)] + [(None, "a", 0.5), ("a", None, 0.5), ("a", "b", None)]
    frame = spark.createDataFrame(rows, "a string, b string, p double")
    got = frame.select("*", C.typing_cost("a", "b").alias("t"), C.rewrite_distance("a", "b").alias("r"), C.channel_cost("a", "b", "p").alias("c")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.a is None or r.b is None:
            assert r.t is None and r.r is None and r.c.total is None
        else:
            assert r.t is not None and r.r is not None and (r.c.error_ops is None) == (r.p is None)
            if r.p is not None:
                assert (r.c.total, r.c.error_ops, r.c.restoration_ops) == plain_channel(r.a, r.b, r.p)
    assert frame.limit(0).select(C.typing_cost("a", "b"), F.lit(1)).count() == 0


@pytest.mark.parametrize("typed,word,cost", [("teh", "the", 2.0), ("the", "the", 0.0), ("", "ab", 8.0), ("abc", "", 12.0)])
def test_literal_costs(typed, word, cost):
    assert alignment.typing_costs([typed], [word], INSERTION, DELETION, TRANSPOSITION)[0] == cost
