"""Views matched by mutual best distance, block by block, against all pairs."""

import math
import random

from sceneloom.operators import blocks, relations


def _shuffled_rows(plan):
    """Rows of each shuffle of an executed plan."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _shuffled_rows(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _shuffled_rows(plan.plan())
    below = [n for i in range(plan.children().size()) for n in _shuffled_rows(plan.children().apply(i))]
    return below + ([plan.metrics().apply("shuffleRecordsWritten").value()] if kind == "ShuffleExchangeExec" else [])


def _mutual(table, radius):
    """(frame, views, ids) of the mutual best pairs, by trying all."""
    out = []
    good = [r for r in table if None not in r and all(math.isfinite(c) for c in r[3:])]
    for frame in {r[0] for r in good}:
        here = [r for r in good if r[0] == frame]
        for p in {r[2] for r in here}:
            for q in {r[2] for r in here if r[2] > p}:
                pairs = [(math.sqrt(sum((a[c] - b[c]) * (a[c] - b[c]) for c in (3, 4, 5))), a[1], b[1])
                         for a in here if a[2] == p for b in here if b[2] == q]
                pairs = [x for x in pairs if x[0] < radius]
                left, right = {}, {}
                for d, a, b in pairs:
                    left[a] = min(left.get(a, (d, b)), (d, b))
                    right[b] = min(right.get(b, (d, a)), (d, a))
                out += [(frame, p, q, a, b) for a, (_, b) in left.items() if right[b][1] == a]
    return sorted(out)


def _obs(spark, table):
    df = spark.createDataFrame([(0, *r) for r in table], "video_id long, frame_idx long, object_id string, view string, x double, y double, z double")
    return df


def test_mutual_best_of_all_pairs(spark, monkeypatch):
    """Ties, crowded cells cut into blocks, far points, rows without an id, a view or a place."""
    rng = random.Random(8)
    spot = lambda: [rng.choice([rng.gauss(0, 4), float(rng.randint(-2, 2))]) for _ in range(3)]
    table = [(f, f"{i:03d}", "abc"[i % 3], *spot()) for f in range(2) for i in range(120)]
    table += [(2, "1", "a", 1e300, 0.0, 0.0), (2, "2", "b", 1e300, 1.0, 0.0), (2, "3", "b", -1e300, 0.0, 0.0), (2, "4", "b", math.inf, 0.0, 0.0),
              (2, "5", None, 1e300, 0.0, 0.0), (2, None, "b", 1e300, 0.0, 0.0), (2, "6", "b", None, 0.0, 0.0), (2, "7", "b", math.nan, 0.0, 0.0), (3, "1", "a", 0.0, 0.0, 0.0)]
    want = _mutual(table, 3.0)
    assert (2, "a", "b", "1", "2") in want and len(want) > 40
    for block, step in ((4096, 1 << 16), (7, 20)):
        monkeypatch.setattr(blocks, "_AT_ONCE", step)
        monkeypatch.setattr(relations, "meetings", lambda p, keys, n=block: blocks.meetings(p, keys, n))
        got = relations.match_views(_obs(spark, table), 3.0)
        assert sorted(tuple(r) for r in got.select("frame_idx", "l_view", "r_view", "l_id", "r_id").collect()) == want
    assert relations.match_views(_obs(spark, table).limit(0), 3.0).count() == 0


def test_pairs_of_a_crowded_frame_stay_in_their_task(spark):
    rng = random.Random(9)
    df = relations.match_views(_obs(spark, [(0, f"{i:03d}", "ab"[i % 2], *(rng.uniform(0, 2) for _ in range(3))) for i in range(400)]), 5.0)
    assert df.collect()
    assert max(_shuffled_rows(df._jdf.queryExecution().executedPlan())) <= 800  # of 40,000 pairs
