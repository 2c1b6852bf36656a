"""The first edges of crowded and of sparse frames."""

import math
import random

from conftest import rows
from pyspark.sql import functions as F

from sceneloom.operators import relations as R


def _edges(spark):
    rng = random.Random(5)
    table = [(0, 0, i, *(rng.uniform(0, 9) for _ in range(3))) for i in range(150)]  # crowded: nearly all pairs
    table += [(0, 1, i, 100.0 * i, 0.0, 0.0) for i in range(90)] + [(0, 1, 200 + i, 8950.0 + i, 0.0, 0.0) for i in range(3)]
    table += [(0, 2, 7, 0.0, 0.0, 0.0), (0, 2, 7, 1.0, 0.0, 0.0), (0, 2, 9, 0.0, 0.0, 1.0), (0, 2, None, 0.0, 0.0, 0.0), (1, 0, 1, 0.0, 0.0, 0.0)]
    return spark.createDataFrame(table, "video_id long, frame_idx long, object_id long, x double, y double, z double"), table


def test_first_edges_equal_the_first_of_all_pairs(spark):
    pts, table = _edges(spark)
    got = rows(R.first_edges(pts, 5, 60.0, "notebook"), "video_id", "frame_idx", "src", "dst", "dist")
    want = []
    for key in {r[:2] for r in table}:
        own = [r for r in table if r[:2] == key and r[2] is not None]
        pairs = [(*key, a[2], b[2], sum((p - q) ** 2 for p, q in zip(a[3:], b[3:])) ** 0.5) for a in own for b in own if a[2] < b[2]]
        want += sorted(p for p in pairs if p[4] < 60)[:5]
    assert [r[:4] for r in got] == [r[:4] for r in sorted(want)]
    assert all(abs(a[4] - b[4]) < 1e-9 for a, b in zip(got, sorted(want)))


def test_a_crowded_frame_does_not_make_all_its_edges(spark, monkeypatch):
    made = []
    kept = R.grid_join
    monkeypatch.setattr(R, "grid_join", lambda *a: made.append(kept(*a)) or made[-1])
    crowd = _edges(spark)[0].filter("video_id = 0 and frame_idx = 0")
    assert R.first_edges(crowd, 5, 60.0).count() == 5
    assert sum(m.count() for m in made) <= 5 * 150  # of 11,175


def test_a_crowded_cell_spreads_and_each_pair_comes_once(spark):
    rng = random.Random(5)
    pts = [(0, f, i, rng.uniform(-3, 3), rng.uniform(-3, 3), rng.uniform(-3, 3)) for f in range(2) for i in range(60)]
    pts += [(0, 0, 100, 1e300, 0.0, 1e300), (0, 0, 101, 1e300, 1.0, 1e300), (0, 0, 102, math.inf, 0.0, 0.0), (0, 0, 103, math.nan, 0.0, 0.0),
            (0, 0, 104, None, 0.0, 0.0), (0, 0, None, 0.0, 0.0, 0.0), (0, 1, 7, 0.0, 0.0, 0.0), (0, 1, 7, 0.0, 0.0, 1.6)]
    df = spark.createDataFrame(pts, "video_id long, frame_idx long, object_id long, x double, y double, z double")
    for radius in (1.5, 50.0):
        want = sorted((a[1], a[2], b[2]) for a in pts for b in pts
                      if None not in a + b and a[1] == b[1] and a[2] < b[2] and math.sqrt(sum((p - q) ** 2 if abs(p - q) < 1e150 else math.inf for p, q in zip(a[3:], b[3:]))) < radius)
        met = R.near_pairs(df, radius, block=8)
        got = [tuple(r) for r in met.select("frame_idx", "s.id", "t.id").collect()]
        assert sorted(got) == want
    # one cell a frame, but not one task
    assert met.filter("frame_idx = 0").select(F.spark_partition_id()).distinct().count() > 2
