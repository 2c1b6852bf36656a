"""Least-cost matching against all matchings, and cells of space against all pairs."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from sceneloom.operators import relations, visibility
from sceneloom.operators.matching import cheapest_matching, least_cost


def best_total(pairs, limit):
    """The least sum of (cost - limit) over all matchings, by trying each."""
    if not pairs:
        return 0.0
    a, b, cost = pairs[0]
    rest = pairs[1:]
    return min(best_total(rest, limit), cost - limit + best_total([p for p in rest if p[0] != a and p[1] != b], limit))


@pytest.mark.parametrize("seed", range(40))
def test_cheapest_of_all_matchings(seed):
    rng = random.Random(seed)
    pairs = [(a, b, round(rng.random(), rng.choice([1, 6]))) for a in range(4) for b in range(4) if rng.random() < 0.8]
    rng.shuffle(pairs)
    got = [pairs[i] for i in cheapest_matching(pairs, 0.7)]
    assert len({a for a, _, _ in got}) == len({b for _, b, _ in got}) == len(got)
    assert math.isclose(sum(c - 0.7 for _, _, c in got), best_total([p for p in pairs if p[2] < 0.7], 0.7), abs_tol=1e-9)


def test_a_long_alternating_chain():
    """Greedy takes the cheap middle pairs; the optimum shifts the whole chain."""
    n = 200
    pairs = [(i, i, 0.5) for i in range(n)] + [(i + 1, i, 0.499) for i in range(n - 1)]
    assert sorted(pairs[i][:2] for i in cheapest_matching(pairs, 1.0)) == [(i, i) for i in range(n)]


def test_least_cost_of_many_frames(spark):
    rng = random.Random(9)
    rows = [(f, a, b, rng.random()) for f in range(30) for a, b in itertools.product(range(4), range(3)) if rng.random() < 0.6]
    odd = [(0, 0, 0, None), (99, 1, 1, 0.1), (99, 1, 1, 0.05), (98, 1, 1, 0.8)]
    frame = spark.createDataFrame(rows + odd, "f int, a long, b long, cost double")
    got = {}
    for r in least_cost(frame, ["f"], "a", "b", "cost", 0.8).collect():
        got.setdefault(r.f, []).append((r.a, r.b, r.cost))
    assert got.pop(99) == [(1, 1, 0.05)] and 98 not in got
    for f in range(30):
        want = best_total([(a, b, c) for g, a, b, c in rows if g == f and c < 0.8], 0.8)
        assert math.isclose(sum(c - 0.8 for _, _, c in got.get(f, [])), want, abs_tol=1e-9)
    assert least_cost(frame.limit(0), ["f"], "a", "b", "cost", 0.8).count() == 0


def test_visible_points_are_the_valid_ones(spark):
    rng = random.Random(2)
    pts = spark.createDataFrame([(v, i, rng.gauss(0, 30), rng.gauss(0, 30), rng.gauss(0, 30)) for v in range(2) for i in range(800)] + [(0, 9000, 0.0, 0.0, 0.0)],
                                "video_id long, point_id long, x double, y double, z double")
    cams = []
    for v in range(2):
        for c in range(12):
            w, x, y, z = (lambda q: [e / math.sqrt(sum(t * t for t in q)) for e in q])([rng.gauss(0, 1) for _ in range(4)])
            r = [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
                 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]
            t = [rng.gauss(0, 10) for _ in range(3)] if c else [0.0] * 3
            cams.append((v, c, [*r[:3], t[0], *r[3:6], t[1], *r[6:], t[2], 0.0, 0.0, 0.0, 1.0], [50.0, 0.0, 32.0, 0.0, 50.0, 24.0, 0.0, 0.0, 1.0]))
    cams = spark.createDataFrame(cams, "video_id long, cam long, t_wc array<double>, k array<double>")
    want = relations.project_points(pts, cams, 48, 64, keys=["video_id"]).filter("valid").drop("valid")
    got = visibility.visible_points(pts, cams, 48, 64, ["video_id"], cell=2.0)
    key = lambda df: sorted(tuple(r) for r in df.select("video_id", "point_id", "cam", "img_x", "img_y").collect())
    assert key(got) == key(want) and len(key(want)) > 300
    # few more pairs than are seen
    assert visibility.visible_candidates(pts, cams, 48, 64, ["video_id"], cell=2.0).count() < 2.5 * want.count()
    assert visibility.visible_points(pts.filter(F.lit(False)), cams, 48, 64, ["video_id"]).count() == 0
