from __future__ import annotations

import pytest

from millrace.llm import fingerprint, queries

TEXTS = [
    ("a", "one two three four five six seven eight nine"), ("a", "one two three four five six"), ("b", "two three four five six seven"), ("b", "quite another text that nobody else has"),
    ("c", "nothing of this is anywhere but here"), (None, None), ("", "  "),
]


def _shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_pairs_are_those_of_the_sets(spark):
    """Small groups, whose sketches hold everything: the estimates are exact."""
    assert "op4_source_pairs" in queries.QUERIES
    sets = {}
    for source, text in TEXTS:
        sets.setdefault(source or "", set()).update(_shingles(text))
    got = {(r.source, r.other): r for r in fingerprint.source_pairs(spark.createDataFrame(TEXTS, "source string, text string")).collect()}
    assert set(got) == {(x, y) for x in sets for y in sets if x != y}
    for (x, y), r in got.items():
        a, b = sets[x], sets[y]
        assert (r.distinct, r.other_distinct, r.n_sampled) == (len(a), len(b), len(a))
        assert r.resemblance == pytest.approx(len(a & b) / len(a | b), abs=1e-9)
        assert r.containment == pytest.approx(len(a & b) / len(a) if a else 1, abs=1e-9)
    assert 0 < got["a", "b"].containment < 1 and got["c", "a"].containment == 0


def test_no_hash_low_enough_is_unknown(spark):
    """A single shingle above the last hash of a full sketch says nothing about its containment, unlike an empty group."""
    big = [("big", " ".join(f"w{i}" for i in range(40_000)))]
    rows = big + [(f"s{i}", f"only these five words {i}") for i in range(4)] + [("none", "")]
    got = {(r.source, r.other): r for r in fingerprint.source_pairs(spark.createDataFrame(rows, "source string, text string")).collect()}
    assert all(r.containment is None for r in got.values() if r.source != "none" and r.n_sampled == 0)
    assert any(r.n_sampled == 0 for (x, y), r in got.items() if x != "none" and y == "big")
    assert got["none", "big"].containment == 1 and got["big", "none"].containment == 0
