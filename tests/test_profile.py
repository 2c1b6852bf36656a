"""Depth profiles against plain loops, on ragged lines with missing and odd values."""

import math
from collections import defaultdict

from pyspark.sql import functions as F

from sceneloom import schema
from sceneloom.operators import quality as Q
from sceneloom.plans.scene_view import EVENTS_A_TASK, SceneView


def _lines(spark):
    table = []
    for idx in range(2):
        for v in range(8):
            line = [None if (u + v) % 5 == 0 else 1e6 + (u * 3 + v + idx) % 7 / 8 for u in range(8 - v % 3)]
            table.append((0, idx, v, line, None))
    table += [(1, 0, 0, [None, None], None), (1, 0, 1, [], None), (2, 0, 0, None, None)]
    # several tasks share a frame
    return spark.createDataFrame(table, schema.DEPTH_ROWS).repartition(5), table


def test_profiles_equal_plain_means(spark):
    lines, table = _lines(spark)
    got = Q.depth_profile(lines, 8, 8)
    groups = {n: defaultdict(list) for n in got}
    for video, idx, v, line, _ in table:
        for u, d in enumerate(line or []):
            key = (video, idx)
            groups["overall"][key].append(d)
            groups["rows"][(*key, v)].append(d)
            groups["columns"][(*key, u)].append(d)
            groups["bands"][(*key, "top" if v < 2 else "middle" if v < 6 else "bottom")].append(d)
            for a in ("top" if v < 4 else "bottom", "all"):
                for b in ("left" if u < 4 else "right", "all"):
                    groups["quadrants"][(*key, a, b)].append(d)
    mean = lambda x: sum(x) / len(x) if x else None
    for name, want in groups.items():
        keys = {"rows": ["v"], "columns": ["u"], "bands": ["band"], "quadrants": ["vertical", "horizontal"]}.get(name, [])
        found = {tuple(r[k] for k in ["video_id", "frame_idx", *keys]): r for r in got[name].collect()}
        assert set(found) == set(want), name
        for key, values in want.items():
            have = [d for d in values if d is not None]
            if name == "overall":
                r = found[key]
                assert (r["min"], r["max"], r["n_values"]) == (min(have, default=None), max(have, default=None), len(set(have)))
            else:
                assert (found[key]["mean"] is None) == (not have)
                assert not have or math.isclose(found[key]["mean"], mean(have), rel_tol=1e-12)
            if name in ("overall", "rows") and have:
                m = mean(have)
                assert math.isclose(found[key]["std"], math.sqrt(sum((d - m) ** 2 for d in have) / len(have)), rel_tol=1e-6, abs_tol=1e-9)


def test_no_pixel_is_a_row_and_videos_are_dealt(spark, tmp_path):
    plan = Q.depth_profile(_lines(spark)[0], 8, 8)["quadrants"]._jdf.queryExecution().toString()
    assert "posexplode" not in plan and "MapInArrow" in plan
    n = 3 * spark.sparkContext.defaultParallelism
    e = spark.range(n * EVENTS_A_TASK).select(F.col("id").alias("user_id"))
    e.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    videos = SceneView(spark, str(tmp_path)).videos
    videos.count()
    assert videos.rdd.getNumPartitions() == n  # however few bytes the ids are


def test_shared_lines_move_once(spark):
    from sceneloom.plans import align_queries as Q2
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = Q2.shared_lines(SceneView(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    lines = plan.splitlines()
    below = [lines[i + 1] for i, line in enumerate(lines[:-1]) if line in moved]
    assert sum("depth" in line for line in below) == 1  # the lines of depth, shuffled by frame once


def test_unweighted_line_sums(spark):
    from sceneloom.operators import align as A
    from sceneloom.plans import align_queries as Q2
    met = Q2.shared_lines(SceneView(spark, "/root/testdata/sf0.001")).filter("video_id = 0 and pair_id < 2")
    want = {r["pair_id"]: r for r in A.line_pairs(met).groupBy("video_id", "pair_id").agg(
        F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.col("sx") - F.col("sa0")).alias("x")).collect()}
    got = A.line_moments(met, weighted=False).collect()
    assert {r["pair_id"] for r in got} == {0, 1}
    for r in got:
        w = want[r["pair_id"]]
        assert r["n"] == w["n"] and math.isclose(r["sw"], w["w"], rel_tol=1e-9) and math.isclose(r["ms0"], w["x"], rel_tol=1e-9, abs_tol=1e-9)
