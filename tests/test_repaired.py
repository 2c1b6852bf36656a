"""A matching carried on when pairs come in, against one from the beginning."""

import math
import random

import pytest

from sceneloom.operators.matching import priced_matching, repaired_matching


@pytest.mark.parametrize("seed", range(60))
def test_as_cheap_as_from_the_beginning(seed):
    rng = random.Random(seed)
    na, nb, digits = rng.randint(1, 12), rng.randint(1, 12), rng.choice([1, 6])
    every = [(a, b, round(rng.random(), digits)) for a in range(na) for b in range(nb) if rng.random() < 0.7]
    limit = rng.choice([0.2, 0.5, 0.9])
    had, chosen, pays, takes = [], [], {}, {}
    for part in range(4):
        more = [p for p in every if p not in had and (part == 3 or rng.random() < 0.4)]
        kept = {had[i] for i in chosen}
        had = sorted([*had, *more])
        chosen, pays, takes = repaired_matching(had, limit, [i for i, p in enumerate(had) if p in kept], pays, takes)
        want = priced_matching(had, limit)[0]
        got = [had[i] for i in chosen]
        assert len({a for a, _, _ in got}) == len({b for _, b, _ in got}) == len(got)
        assert math.isclose(sum(p[2] - limit for p in got), sum(had[i][2] - limit for i in want), abs_tol=1e-9)
        # prices that show it: no pair costs less than both ends are charged, and the charges add up
        assert all(c >= pays[a] + takes[b] - 1e-9 for a, b, c in had if c <= limit)
        assert all(p <= limit + 1e-9 for p in pays.values()) and all(t <= 1e-9 for t in takes.values())
        assert math.isclose(sum(p[2] - limit for p in got), sum(p - limit for p in pays.values()) + sum(takes.values()), abs_tol=1e-9)


def test_only_what_is_cheaper_moves():
    had = [(i, i, 0.5) for i in range(50)]
    chosen, pays, takes = priced_matching(had, 1.0)
    more = [*had, (3, 4, 0.1), (4, 3, 0.1), (7, 8, 0.9)]
    got, pays, takes = repaired_matching(more, 1.0, chosen, pays, takes)
    assert sorted(more[i][:2] for i in got) == sorted([(i, i) for i in range(50) if i not in (3, 4)] + [(3, 4), (4, 3)])
