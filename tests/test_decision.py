"""The decision to apply a suggestion: each rule and gate by itself."""

from __future__ import annotations

import pytest

from lexmill.operators import decision as D

BASE = {"typed": "typedword", "word": "typeword", "cost": 4.0, "margin": 2.0, "z": 0.5, "lift": None, "runner_lift": None, "single_cost": 4.0, "rewrite": 1, "context": False, "valid": False, "personal": False, "capital": False, "stem_primary": False, "stem_secondary": False, "confidence": None}
SCHEMA = "typed string, word string, cost double, margin double, z double, lift double, runner_lift double, single_cost double, rewrite int, context boolean, valid boolean, personal boolean, capital boolean, stem_primary boolean, stem_secondary boolean, confidence double"
CASES = [
    ({}, "ordinary", 1.15, set()),
    ({"margin": None}, "ordinary", 1.15, set()),
    ({"margin": 1.1}, "ordinary", 1.15, {"ahead"}),
    ({"typed": "x", "word": "y"}, "ordinary", 1.15, {"long_enough", "typical"}),
    ({"cost": 6.5}, "ordinary", 1.15, {"cheap"}),
    ({"typed": "it's"}, "ordinary", 1.15, {"marks_kept"}),
    ({"typed": "“word"}, "ordinary", 1.15, {"marks_kept"}),
    ({"valid": True}, "none", 1.15, {"open_rule"}),
    ({"valid": True, "rewrite": 0, "margin": 0.6, "z": -9.0}, "restoration of a word", 0.5, set()),
    ({"rewrite": 0, "margin": 0.6}, "restoration", 0.5, set()),
    ({"z": -1.5}, "ordinary", 3.45, {"ahead"}),
    ({"z": -2.6, "margin": 9.0}, "ordinary", 3.45, {"typical"}),
    ({"z": None, "margin": 9.0}, "ordinary", 3.45, {"typical"}),
    ({"z": None, "personal": True}, "ordinary", 1.15, set()),
    ({"rewrite": 3, "z": -0.1}, "ordinary", 1.15, {"typical"}),
    ({"lift": 0.8, "margin": 0.9}, "ordinary", 0.805, set()),
    ({"lift": 0.8, "margin": 0.9, "runner_lift": 0.1}, "ordinary", 1.15, {"ahead"}),
    ({"lift": 0.8, "z": -1.5, "margin": 3.5}, "ordinary", 3.45, set()),
    ({"typed": "abc", "word": "abd", "context": True}, "ordinary", 1.15, {"typical"}),
    ({"typed": "abc", "word": "abd", "context": True, "lift": 0.3}, "ordinary", 1.15, set()),
    ({"typed": "ab", "word": "abd", "z": 2.0}, "ordinary", 1.15, {"no_short_completion"}),
    ({"word": "typed word", "rewrite": None, "margin": 2.5, "z": None}, "split", 2.5, set()),
    ({"word": "typed word", "rewrite": None, "margin": 2.6, "single_cost": 2.0}, "split", 2.5, {"no_single_word"}),
    ({"word": "typed word", "rewrite": None, "margin": 2.6, "single_cost": None, "valid": True}, "none", 2.5, {"open_rule"}),
    ({"typed": "Annas", "capital": True, "stem_primary": True}, "ordinary", 1.15, {"no_name"}),
    ({"typed": "Annas", "capital": True, "stem_primary": True, "stem_secondary": True}, "ordinary", 1.15, set()),
    ({"typed": "Annas", "capital": True}, "ordinary", 1.15, set()),
    ({"confidence": 0.75}, "ordinary", 2.875, {"ahead"}),
    ({"confidence": 1.0, "margin": 4.6}, "ordinary", 4.6, set()),
    ({"confidence": 1.0, "rewrite": 0, "margin": 0.5}, "restoration", 0.5, set()),
]


def test_rules_and_gates(spark):
    rows = [tuple((BASE | change).values()) for change, *_ in CASES]
    got = D.decide(spark.createDataFrame(rows, SCHEMA)).collect()
    for (change, rule, required, closed), r in zip(CASES, got):
        assert (r.rule, round(r.required, 9), {g for g in D.GATES if not r[g]}, r.apply) == (rule, required, closed, not closed), change


def test_winners(spark):
    rows = [("a", "x", 4.0, -2.0, 0.1), ("a", "y z", 5.0, -1.0, None), ("a", "w", 2.0, -2.0, 0.7), ("b", "q", 1.0, 0.0, None)]
    got = {r.typed: r for r in D.winners(spark.createDataFrame(rows, "typed string, word string, cost double, score double, lift double")).collect()}
    assert (got["a"].word, got["a"].margin, got["a"].runner_lift, got["a"].single_cost) == ("y z", 1.0, 0.7, 2.0)
    assert (got["b"].word, got["b"].margin, got["b"].single_cost) == ("q", None, 1.0)


@pytest.mark.parametrize("shift,low,high", [(0.0, 0.3, 0.36), (0.5, 0.22, 0.3), (1.0, 0.0, 0.2)])
def test_tap_confidence(spark, shift, low, high):
    """Taps on a key's centre speak for it, taps between two keys for neither."""
    taps = spark.createDataFrame([("fg", 1, "f", 3.5 + shift, 1.0), ("fg", 2, "g", 4.5 + shift, 1.0), ("é", 1, "é", 2.0, 0.0)], "typed string, pos int, letter string, x double, y double")
    got = {r.typed: r.confidence for r in D.tap_confidence(taps).collect()}
    assert set(got) == {"fg"} and low < got["fg"] < high
