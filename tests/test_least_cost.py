"""Least-cost matching as a stream of components, and from few candidates."""

import itertools
import math
import random

from sceneloom.operators import relations as R
from sceneloom.operators.matching import cheapest_matching, least_cost


def test_components_pass_in_a_stream(spark):
    """A call for each component took half of associate_least_cost."""
    rng = random.Random(3)
    rows = [(f, a, b, rng.random()) for f in range(8) for a, b in itertools.product(range(6), range(5)) if f % 2 or a == b]
    pairs = spark.createDataFrame(rows, "f int, a long, b long, cost double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = least_cost(pairs, ["f"], "a", "b", "cost", 0.8)
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = {tuple(r) for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    want = set()
    for f in range(8):
        here = [(a, b, c) for g, a, b, c in rows if g == f and c < 0.8]
        want |= {(f, *here[i]) for i in cheapest_matching(here, 0.8)}
    assert got == want


def test_views_matched_from_few_candidates(spark):
    """Crowded frames with a surplus on one side, copies of a place, and a view of its own: the least total of all pairs."""
    rng = random.Random(4)
    spot = lambda: [rng.choice([rng.gauss(0, 2), rng.gauss(0, 2), 1.5]) for _ in range(3)]
    pts = [(0, f, i, (0 if i % 5 < 3 else 1) if f < 2 else f, *spot()) for f in range(3) for i in range(90)] + [(0, 0, 999, 1, float("nan"), 0.0, 0.0), (0, 0, 998, 0, None, 0.0, 0.0)]
    obs = spark.createDataFrame(pts, "video_id long, frame_idx long, object_id long, view int, x double, y double, z double")
    got = {}
    for r in R.match_views(obs, 5.0, matching="least").collect():
        got.setdefault(r.frame_idx, []).append((r.l_id, r.r_id, r.dist))
    assert set(got) == {0, 1}
    for f, found in got.items():
        side = lambda s: [(p[2], p[4:]) for p in pts if p[1] == f and p[3] == s and p[2] < 900]  # noqa: B023,E731
        every = [(a, b, math.dist(p, q)) for a, p in side(0) for b, q in side(1) if math.dist(p, q) < 5.0]
        want = sum(every[i][2] - 5.0 for i in cheapest_matching(every, 5.0))
        assert len({a for a, _, _ in found}) == len({b for _, b, _ in found}) == len(found)
        assert math.isclose(sum(c - 5.0 for _, _, c in found), want, abs_tol=1e-6)
        assert {(a, b) for a, b, _ in found} <= {(a, b) for a, b, _ in every}
