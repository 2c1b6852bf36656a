"""Least-cost matching of keys as a whole, and of crowded ones by components."""

import itertools
import random

import pytest

from sceneloom.operators import matching
from sceneloom.operators.matching import cheapest_matching, least_cost


def _pairs(spark):
    rng = random.Random(6)
    rows = [(f, a, b, rng.random()) for f in range(20) for a, b in itertools.product(range(6), range(5)) if rng.random() < 0.15 + 0.04 * f]
    want = set()
    for f in range(20):
        here = [(a, b, c) for g, a, b, c in rows if g == f and c < 0.8]
        want |= {(f, *here[i]) for i in cheapest_matching(here, 0.8)}
    again = [(f, a, b, c + 0.01) for f, a, b, c in rows[::3]]  # dearer copies count for nothing
    return spark.createDataFrame(rows + again, "f int, a long, b long, cost double"), want


def test_small_keys_need_no_components(spark, monkeypatch):
    def never(*_):
        pytest.fail("components of keys that one task can hold")

    monkeypatch.setattr(matching, "components", never)
    pairs, want = _pairs(spark)
    assert {tuple(r) for r in least_cost(pairs, ["f"], "a", "b", "cost", 0.8).collect()} == want


@pytest.mark.parametrize("whole", [0, 9])
def test_crowded_keys_fall_into_components(spark, whole):
    pairs, want = _pairs(spark)
    got = [tuple(r) for r in least_cost(pairs, ["f"], "a", "b", "cost", 0.8, whole=whole).collect()]
    assert set(got) == want and len(got) == len(want)
