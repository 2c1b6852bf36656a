"""Scenes end to end, lives of objects, files and live operators."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_geometry import EYE

from sceneloom import schema
from sceneloom.operators import fuse as Fu
from sceneloom.operators import lift as L
from sceneloom.operators import masks as M
from sceneloom.operators import quality as Q
from sceneloom.operators import relations as Rel
from sceneloom.operators import sampling as S
from sceneloom.operators import scene as Sc
from sceneloom.operators import tracks as T
from sceneloom.sources import readers as R
from sceneloom.streaming import live


def small_scene(spark, n=6, window=3):
    """One object seen by two runs in frames 0..n-2, nothing in the last frame."""
    k = [10.0, 0.0, 4.0, 0.0, 10.0, 4.0, 0.0, 0.0, 1.0]
    frames = spark.createDataFrame([(0, t, float(t), True, k, EYE) for t in range(n)], schema.FRAMES)
    lines = spark.createDataFrame([(0, t, v, [2.0] * 8, None) for t in range(n) for v in range(8)], schema.DEPTH_ROWS)
    dets, spans = [], []
    for t in range(n - 1):
        for r in range(2):
            dets.append((0, t, 2 * t + r, f"run{r}", 0, 0.9 - 0.1 * r))
            spans += [(0, t, 2 * t + r, v, 2, 6, 8, 8) for v in range(2 + r, 6)]
    dets = spark.createDataFrame(dets, schema.DETECTIONS)
    spans = spark.createDataFrame(spans, schema.SPANS)
    states = L.object_state(spans, lines, frames, grid=4, min_points=1).checkpoint()
    pairs = M.mask_iou_pairs(spans.join(dets.select(*schema.DET, "run_id"), schema.DET), differ="run_id")
    gated = Fu.merge_gate(pairs, states)
    obs = Fu.fuse_tracks(dets, gated, frames)
    meta, ego, steps = Sc.scene_tables(obs, states, frames, grid=4, window=window)
    return obs, states, frames, meta, ego, steps.checkpoint()


def test_scene_document(spark, tmp_path):
    obs, _states, _frames, meta, ego, steps = small_scene(spark)
    anchors = spark.createDataFrame([(0, 0, "a.jpg"), (0, 3, "b.jpg")], "video_id long, frame_idx long, path string")
    parts = Sc.scene_json_parts(meta, ego, Sc.track_documents(steps), anchors, grid=4)
    Sc.write_parts(parts, str(tmp_path / "scene"))
    files = sorted((tmp_path / "scene" / "video_id=0").glob("part-*"))
    doc = json.loads("".join(f.read_text().replace("\n", "") for f in files))
    assert doc["metadata"]["grid"] == "4x4" and doc["metadata"]["num_frames"] == 6 and doc["metadata"]["num_tracks"] == 1
    assert [a["frame_idx"] for a in doc["metadata"]["visual_anchor"]] == [0, 3]
    assert [e["t"] for e in doc["ego"]] == list(range(6)) and doc["ego"][0]["xyz"] == [0, 0, 0]
    (track,) = doc["tracks"]
    assert track["object_id"] == 0
    assert [s["t"] for s in track["F_k"]] == [2, 3, 4]
    step = track["F_k"][0]
    assert step["theta"] == [0, 4]
    assert step["c"] == pytest.approx([-0.1, -0.1, 2.0], abs=1e-6)
    assert step["s"]["z"] == {"mu": 2.0, "sigma": 0.0, "min": 2.0, "max": 2.0}
    assert [(p["row"], p["col"]) for p in step["tau"]] == [(1, 1), (1, 2), (2, 1), (2, 2)]
    plain = Sc.scene_json_parts(meta, ego, Sc.track_documents(steps), grid=4).orderBy("section", "major", "minor")
    doc = json.loads("".join(r.text for r in plain.collect()))
    assert "visual_anchor" not in doc["metadata"]
    assert Q.duplicate_ids(obs).count() == 0


def test_scene_text(spark):
    _obs, _states, _frames, meta, ego, steps = small_scene(spark)
    parts = Sc.scene_text_parts(meta, ego, steps).orderBy("section", "major", "minor").collect()
    text = "\n".join(r.text for r in parts)
    assert "Grid: 4x4, Frames: 6, Tracks: 1" in text
    assert "[EGO POSES]\n  t=0: xyz=[0.0, 0.0, 0.0]\n  t=1:" in text
    assert "=== Object 0 (F_k, 3 frames) ===\n  t=2: tau=[(1, 1, 1.0), (1, 2, 1.0), (2, 1, 1.0), (2, 2, 1.0)] c=[" in text
    assert text.endswith("theta=[0, 4]\n")
    at = steps.select(*schema.FRAME, "object_id", *[F.col("step.c")[i].alias(a) for i, a in enumerate("xyz")])
    summary = Sc.scene_summary_parts(ego, steps, Rel.spatial_edges(at, 50.0, "notebook")).orderBy("section", "major", "minor")
    text = "\n".join(r.text for r in summary.collect())
    assert "Objects (1 tracked):" in text and "    Visible: frames 0-4" in text


@pytest.mark.parametrize("fps,target", [(30.0, 10.0), (29.97, 10.0), (24.0, 10.0), (5.0, 2.5), (60.0, 7.3), (10.0, 30.0)])
def test_sampling_equals_the_greedy_rule(spark, fps, target):
    want, due = [], 0.0
    for i in range(400):
        t = i / fps
        if t + 1e-9 >= due:
            want.append(i)
            while due <= t + 1e-9:
                due += 1.0 / target
    df = spark.range(400).select(F.lit(0).alias("video_id"), F.col("id").alias("source_idx"), F.lit(fps).alias("fps"))
    assert [r[0] for r in rows(S.sample_fps(df, target), "source_idx")] or want
    assert sorted(r.source_idx for r in S.sample_fps(df, target).collect()) == want


def test_sampling_and_cap(spark):
    df = spark.range(6).select(F.lit(0).alias("video_id"), F.col("id").alias("source_idx"), F.lit(5.0).alias("fps"))
    assert sorted(r.source_idx for r in S.cap_frames(S.sample_fps(df, 2.5), 2).collect()) == [0, 2]
    assert S.cap_frames(df, 2000).count() == 6 and S.cap_frames(df, None).count() == 6
    with pytest.raises(ValueError):
        S.sample_fps(df, 0)


@pytest.mark.parametrize("total,n", [(100, 32), (7, 7), (7, 3), (10, 1), (1000, 999), (64, 10)])
def test_even_sampling_equals_linspace(spark, total, n):
    import numpy as np
    want = list(range(total)) if n >= total else np.linspace(0, total - 1, n, dtype=int).tolist()
    df = spark.range(total).select(F.lit(1).alias("k"), F.col("id").alias("p"))
    assert sorted(r.p for r in S.sample_even(df, ["k"], "p", n, bucket=13).collect()) == sorted(set(want))


def test_lives_count_processed_frames(spark):
    """Frames in strides of ten: five missed frames end a life, four do not."""
    frames = spark.createDataFrame([(0, 10 * i) for i in range(30)], "video_id long, frame_idx long")
    seen = spark.createDataFrame([(0, 1, 10 * i) for i in (0, 1, 6, 12, 13)], "video_id long, local_obj_id long, frame_idx long")
    d = T.track_segments(seen, frames, 2, 3, bucket=4)
    assert rows(d, "frame_idx", "segment") == [(0, 0), (10, 0), (60, 0), (120, 1), (130, 1)]
    status = T.track_status(d, frames, 2, 3)
    assert rows(status, "segment", "missing_streak", "status") == [(0, 23, "archived"), (1, 16, "archived")]


def test_window_keeps_the_whole_span(spark):
    obs = spark.createDataFrame([(0, 1, t) for t in range(25)], "video_id long, object_id long, frame_idx long")
    w = T.track_window(obs, 10)
    assert rows(w, "frame_idx", "t_start", "t_end") == [(t, 0, 24) for t in range(15, 25)]
    assert T.track_window(obs, 0).count() == 25


def test_motion(spark):
    obs = spark.createDataFrame([(0, 1, 10 * i, 5.0 + d, float(s)) for i, (d, s) in enumerate([(0, 0), (0.1, 0), (0.2, 0), (9, 0), (0, 0), (0, 40)])],
                                "video_id long, object_id long, frame_idx long, dist double, side double")
    got = [r[1] for r in rows(T.motion_label(obs, 3, motion=0.011, lateral=0.5), "frame_idx", "motion")]
    assert got == ["unknown", "unknown", "static", "receding", "static", "approaching"]


def reanchor_model(frames, threshold):
    streak, out = 0, []
    for f, (masks, dets) in enumerate(frames):
        streak = streak + 1 if masks == 0 else 0
        if masks == 0 and streak >= threshold and dets > 0:
            out.append(f)
            streak = 0
    return out


@pytest.mark.parametrize("threshold", [1, 2, 3, 7])
def test_reanchors_equal_a_loop(spark, threshold):
    import random
    rnd = random.Random(2)
    vids = {v: [(int(rnd.random() < 0.15), int(rnd.random() < (1.0 if v % 2 else 0.6))) for _ in range(120)] for v in range(8)}
    df = spark.createDataFrame([(v, f, f, m, d) for v, fr in vids.items() for f, (m, d) in enumerate(fr)],
                               "video_id long, frame_idx long, ord long, n_masks long, n_dets long")
    got = T.reanchors(T.empty_streaks(df, bucket=16), threshold)
    assert rows(got, "video_id", "frame_idx") == sorted(
        ((v, f) for v, fr in vids.items() for f in reanchor_model(fr, threshold)))


def test_nearest_is_exact(spark):
    import random
    rnd = random.Random(4)
    pts = [(0, f, i, *(rnd.choice([rnd.gauss(0, 0.01), rnd.gauss(0, 20)]) for _ in range(3))) for f in range(3) for i in range(1 + 40 * f)]
    df = spark.createDataFrame(pts, "video_id long, frame_idx long, object_id long, x double, y double, z double")
    got = {(r.frame_idx, r.src, r["rank"]): (r.dst, r.dist) for r in Rel.nearest(df, 4).collect()}
    want = {}
    for f in range(3):
        mine = [p for p in pts if p[1] == f]
        for p in mine:
            near = sorted((sum((a - b) ** 2 for a, b in zip(p[3:], q[3:])) ** 0.5, q[2]) for q in mine if q is not p)[:4]
            want.update({(f, p[2], i + 1): (j, d) for i, (d, j) in enumerate(near)})
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_files_round_trip(spark, tmp_path):
    lines = spark.createDataFrame([(v, t, r, [1.0, 2.0], [0.5, 1.0]) for v in range(2) for t in range(3) for r in range(2)], schema.DEPTH_ROWS)
    R.write_depth_rows(lines, str(tmp_path / "depth"))
    one = R.read_depth_rows(spark, str(tmp_path / "depth")).filter("video_id = 1")
    assert one.count() == 6
    assert "video_id" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:60]
    assert R.read_depth_rows(spark, str(tmp_path / "depth"), ("depth",)).columns == ["video_id", "frame_idx", "v", "depth"]
    spark.createDataFrame([(1, 3, 2.0, "p")], schema.MANIFEST).write.parquet(str(tmp_path / "m"))
    assert R.read_frames(spark, str(tmp_path / "m")).first().ts == 1.5
    (tmp_path / "stills" / "clip").mkdir(parents=True)
    (tmp_path / "stills" / "clip" / "000012.jpg").write_bytes(b"x")
    still = R.read_stills(spark, str(tmp_path / "stills")).first()
    assert (still.video, still.source_idx) == ("clip", 12)


def test_sessions_merge_at_exactly_one_gap(spark):
    obs = spark.createDataFrame([(0, 1, t) for t in (0, 6, 13)], "video_id long, local_obj_id long, frame_idx long").withColumn(
        "event_ts", F.timestamp_seconds("frame_idx"))
    assert rows(live.session_tracks(obs, 2, 4, fps=1.0), "t_start", "t_end", "n_obs") == [(0, 6, 2), (13, 13, 1)]
