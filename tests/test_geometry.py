"""Lifting, poses, bearings and rasters on hand-computed cases."""

import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sceneloom import schema
from sceneloom.functions import geometry as g
from sceneloom.operators import align as A
from sceneloom.operators import lift as L
from sceneloom.operators import raster as R
from sceneloom.operators import relations as Rel

EYE = [1.0 if i % 5 == 0 else 0.0 for i in range(16)]


def frame(spark, k=(100.0, 0, 32.0, 0, 100.0, 32.0, 0, 0, 1.0), t=EYE, metric=True, idx=0):
    return spark.createDataFrame([(0, idx, 0.0, metric, [float(x) for x in k], [float(x) for x in t])], schema.FRAMES)


def depth(spark, value, h=64, w=64, conf=None, idx=0):
    line = value if callable(value) else (lambda v: [float(value)] * w)
    c = conf if callable(conf) else (lambda v: None if conf is None else [float(conf)] * w)
    return spark.createDataFrame([(0, idx, v, line(v), c(v)) for v in range(h)], schema.DEPTH_ROWS)


def rect(spark, y0, y1, x0, x1, h=64, w=64, det=0, idx=0):
    return spark.createDataFrame([(0, idx, det, v, x0, x1, h, w) for v in range(y0, y1)], schema.SPANS)


def test_single_pixel(spark):
    o = L.object_state(rect(spark, 32, 33, 42, 43), depth(spark, 5), frame(spark), min_points=1).first()
    assert (o.cx, o.cy, o.cz) == pytest.approx((0.5, 0.0, 5.0), abs=1e-6)
    assert o.x_sigma == 0 and o.n_points == 1 and o.tau == []


def test_moving_camera_shifts_the_world(spark):
    t = list(EYE)
    t[3] = 2.0
    o = L.object_state(rect(spark, 32, 33, 32, 33), depth(spark, 5), frame(spark, t=t), min_points=1).first()
    assert o.cx == pytest.approx(-2.0)


def test_exact_and_plain_moments_agree(spark):
    args = rect(spark, 10, 50, 10, 50), depth(spark, lambda v: [5 + v / 64 * 0.5] * 64), frame(spark)
    a = L.object_moments(*args).first().asDict()
    b = L.object_moments(*args, exact=True).first().asDict()
    for name, x in a.items():
        assert b[name] == pytest.approx(x, abs=2e-6), name


def test_population_deviation(spark):
    o = L.object_moments(rect(spark, 32, 33, 32, 34), depth(spark, 10), frame(spark)).first()
    assert (o.cx, o.x_sigma, o.x_min, o.x_max) == pytest.approx((0.05, 0.05, 0.0, 0.1), abs=1e-6)


def test_invalid_depth_and_confidence(spark):
    line = lambda v: [float("nan"), float("inf"), 0.0, -1.0, float("-inf"), 2.0, 2.0]
    conf = lambda v: [1.0] * 6 + [0.4]
    px = L.masked_pixels(rect(spark, 0, 1, 0, 7, 1, 7), depth(spark, line, 1, 7, conf))
    assert [(r.u, r.d) for r in px.collect()] == [(5, 2.0)]
    trusted = L.masked_pixels(rect(spark, 0, 1, 0, 7, 1, 7), depth(spark, line, 1, 7))
    assert trusted.count() == 2


def test_confidence_threshold_is_inclusive(spark):
    assert L.masked_pixels(rect(spark, 0, 1, 0, 2), depth(spark, 1, conf=0.5)).count() == 2


def test_small_and_large_objects(spark):
    spans, lines = rect(spark, 0, 64, 0, 64), depth(spark, 100)
    assert L.object_state(spans, lines, frame(spark), max_extent=30).count() == 0
    assert L.object_state(spans, lines, frame(spark, metric=False), max_extent=30).count() == 1
    assert L.object_state(rect(spark, 0, 7, 0, 7), depth(spark, 1), frame(spark)).count() == 0
    assert L.object_state(rect(spark, 0, 5, 0, 10), depth(spark, 1), frame(spark)).count() == 1


def test_skewed_intrinsics(spark):
    f = frame(spark, k=(100, 10, 32, 0, 100, 32, 0, 0, 1))
    px = spark.createDataFrame([(0, 0, 42, 52, 2.0)], "video_id long, frame_idx long, v int, u int, d float")
    a = L.backproject(px, f).first()
    y = (42 - 32) / 100
    assert (a.x, a.y, a.z) == pytest.approx((((52 - 32) - 10 * y) / 100 * 2, y * 2, 2), abs=1e-6)


def test_pose_inverse_round_trip(spark):
    a = 0.3
    t = [math.cos(a), -math.sin(a), 0, 1, math.sin(a), math.cos(a), 0, -2, 0, 0, 1, 3, 0, 0, 0, 1]
    df = frame(spark, t=t)
    r = df.select(g.pose_product(F.col("t_wc"), g.pose_inverse(F.col("t_wc"))).alias("m")).first().m
    assert r == pytest.approx(EYE, abs=1e-12)
    staged = g.with_pose_inverse(df, "t_wc", "i").select(F.col("i"), g.pose_inverse(F.col("t_wc")).alias("j")).first()
    assert staged.i == staged.j


def test_pose_shapes(spark):
    df = spark.createDataFrame([([1.0] * 12,)], "t array<double>")
    assert df.select(g.pose_to_4x4(F.col("t")).alias("t")).first().t[12:] == [0, 0, 0, 1]
    with pytest.raises(Exception, match="12 or 16"):
        spark.createDataFrame([([1.0] * 9,)], "t array<double>").select(g.pose_to_4x4(F.col("t"))).collect()


@pytest.mark.parametrize("deg,name", [
    (0, "front"), (-22.5, "front"), (22.5, "front-left"), (22.4, "front"), (45, "front-left"), (67.5, "left"), (90, "left"),
    (112.5, "back-left"), (157.5, "back"), (180, "back"), (-180, "back"), (-157.5, "back-right"), (-112.5, "right"),
    (-90, "right"), (-67.5, "front-right"), (-45, "front-right"), (-22.6, "front-right"), (360, "front")])
def test_bearings(spark, deg, name):
    assert spark.range(1).select(g.bearing_8way(F.lit(float(deg))).alias("b")).first().b == name


@pytest.mark.parametrize("dz,thr,name", [(0.5, 0.5, "level"), (0.501, 0.5, "above"), (-0.5, 0.5, "level"),
                                         (-0.501, 0.5, "below"), (1.5, 2.0, "level"), (2.5, 2.0, "above")])
def test_elevation(spark, dz, thr, name):
    assert spark.range(1).select(g.elevation(F.lit(dz), thr).alias("e")).first().e == name


def test_ego_relation_of_an_object_ahead_and_left(spark):
    obs = spark.createDataFrame([(0, 0, 1, -3.0, -2.0, 3.0)], "video_id long, frame_idx long, object_id long, x double, y double, z double")
    r = Rel.ego_relations(obs, frame(spark)).first()
    assert (r.bearing, r.elev) == ("front-left", "above")
    assert r.dist_m == pytest.approx(math.sqrt(22))


def test_normalised_poses_start_at_identity(spark):
    t = list(EYE)
    t[3], t[11] = 4.0, 1.0
    two = frame(spark, t=t).unionByName(frame(spark, t=EYE, idx=1))
    got = {r.frame_idx: r.t_wc for r in A.normalise_poses(two).collect()}
    assert got[0] == EYE
    assert got[1][3] == -4.0 and got[1][11] == -1.0


def test_crop_is_padded_back(spark):
    lines = spark.createDataFrame([(0, 0, v, [float(10 * v + u) for u in range(2)], [1.0, 1.0]) for v in range(2)], schema.DEPTH_ROWS)
    got = {r.v: (r.depth, r.conf) for r in R.pad_raster(lines, 1, 1, 1, 2, 2).collect()}
    assert got[0] == ([0, 0, 1, 1, 1], [0] * 5)
    assert got[1] == ([0, 0, 1, 1, 1], [0, 1, 1, 0, 0])
    assert got[3] == ([10, 10, 11, 11, 11], [0] * 5) and len(got) == 4


def test_bilinear_doubling(spark):
    lines = spark.createDataFrame([(0, 0, v, [0.0, 4.0], [1.0, 1.0]) for v in range(2)], schema.DEPTH_ROWS)
    got = rows(R.resample_raster(lines, (2, 2), (4, 4)), "v", "depth")
    assert got == [(v, [0.0, 1.0, 3.0, 4.0]) for v in range(4)]


def test_project_behind_and_outside(spark):
    pts = spark.createDataFrame([(0, 0, i, *p) for i, p in enumerate([(0., 0., 2.), (0., 0., -2.), (9., 0., 2.), (0., 0., 0.)])],
                                "video_id long, frame_idx long, point_id long, x double, y double, z double")
    got = Rel.project_points(pts, frame(spark).select(*schema.FRAME, "k", "t_wc"), 64, 64)
    assert [r.valid for r in got.orderBy("point_id").collect()] == [True, False, False, False]


def test_known_similarity_is_recovered_despite_outliers(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    a = 0.4
    rot = np.array([[math.cos(a), 0, math.sin(a)], [0, 1, 0], [-math.sin(a), 0, math.cos(a)]])
    src = rng.normal(size=(400, 3)) * 3
    dst = 1.7 * src @ rot.T + np.array([1.0, -2.0, 0.5])
    dst[:20] += 30.0
    pairs = spark.createDataFrame([(0, 0, *map(float, s), *map(float, d), 1.0) for s, d in zip(src, dst)],
                                  "video_id long, pair_id long, sx double, sy double, sz double, tx double, ty double, tz double, w double")
    plain = A.estimate_similarity(pairs, robust=False).first()
    robust = A.estimate_similarity(pairs, max_iters=5).first()
    assert abs(robust.s - 1.7) < abs(plain.s - 1.7)
    clean = A.estimate_similarity(pairs.filter("tx < 15 or ty < 15"), robust=True)
    exact = A.estimate_similarity(spark.createDataFrame(
        [(0, 0, *map(float, s), *map(float, d), 1.0) for s, d in zip(src[20:], dst[20:])], pairs.schema)).first()
    assert clean.count() == 1
    assert exact.s == pytest.approx(1.7, abs=1e-9)
    assert exact.r == pytest.approx(list(rot.ravel()), abs=1e-9)
    assert exact.t == pytest.approx([1.0, -2.0, 0.5], abs=1e-9)


def test_too_few_pairs_mean_identity(spark):
    pts = spark.createDataFrame([(0, c, 0, v, 0, 1.0 * v, 2.0, 3.0, 1.0) for c in (0, 1) for v in range(5)],
                                "video_id long, chunk_id long, frame_idx long, v int, u int, x double, y double, z double, conf float")
    r = A.align_chunks(pts).first()
    assert (r.n, r.s, r.t) == (5, 1.0, [0.0, 0.0, 0.0])


def test_chunks_cover_every_frame_once(spark):
    frames = spark.createDataFrame([(0, 3 * i) for i in range(51)], "video_id long, frame_idx long")
    chunks = A.chunk_frames(frames, 20, 5, bucket=8)
    bounds = chunks.groupBy("chunk_id").agg((F.min("frame_idx") / 3).cast("int"), (F.max("frame_idx") / 3 + 1).cast("int"))
    assert rows(bounds) == [(0, 0, 20), (1, 15, 35), (2, 30, 50), (3, 45, 51)]
    assert A.frame_cover(A.chunk_owner(chunks, 20, 5), frames).count() == 0
    assert A.frame_cover(chunks, frames).count() == 15


def test_chain_of_similarities(spark):
    """Products across stretches equal the products in one go."""
    import numpy as np
    rng = np.random.default_rng(1)
    sims = []
    for i in range(11):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        q *= np.sign(np.linalg.det(q))
        sims.append((0, i, float(rng.uniform(0.5, 2)), [float(x) for x in q.ravel()], [float(x) for x in rng.normal(size=3)]))
    df = spark.createDataFrame(sims, "video_id long, pair_id long, s double, r array<double>, t array<double>")
    one = {r.chunk_id: r for r in A.accumulate_similarity(df, bucket=100).collect()}
    many = {r.chunk_id: r for r in A.accumulate_similarity(df, bucket=3).collect()}
    assert sorted(one) == sorted(many) == list(range(12))
    for i in one:
        assert one[i].s == pytest.approx(many[i].s) and one[i].r == pytest.approx(many[i].r) and one[i].t == pytest.approx(many[i].t)
    s, r, t = sims[0][2:]
    s1, r1, t1 = sims[1][2:]
    r, r1 = np.array(r).reshape(3, 3), np.array(r1).reshape(3, 3)
    assert one[2].t == pytest.approx(list(s * (r @ np.array(t1)) + np.array(t)))


def test_untrusted_and_missing_confidence(spark):
    """NaN is no trust, null is full trust; padding and resampling keep that."""
    from sceneloom.operators.raster import pad_raster, resample_raster
    nan = float("nan")
    rows = spark.createDataFrame([(0, 0, 0, [1.0, 2.0], [nan, 0.9]), (0, 0, 1, [1.0, 2.0], None)],
                                 "video_id long, frame_idx long, v int, depth array<float>, conf array<float>")
    runs = rect(spark, 0, 2, 0, 2, 1, 7)
    assert sorted((r.v, r.u) for r in L.masked_pixels(runs, rows).collect()) == [(0, 1), (1, 0), (1, 1)]
    padded = {r.v: r.conf for r in pad_raster(rows, 0, 1, 1, 0, 2).collect()}
    assert padded[1] == [0.0, 1.0, 1.0] and padded[2] == [0.0, 0.0, 0.0]
    assert [r.conf for r in resample_raster(rows.filter("v = 1").withColumn("v", F.lit(0)), (1, 2), (1, 4)).collect()] == [[1.0] * 4]


def test_exact_moments_of_far_pixels(spark):
    """A pixel a thousand kilometres away is measured, not an overflow; depth beyond all bounds counts as very far."""
    import numpy as np
    pts = spark.createDataFrame([(1, x, y, 5.0) for x, y in ((0.25, 1e6), (1.5, -1e6), (-3.0, 12.0), (2e5, 7.5))] + [(2, 1e30, 0.0, 1.0)],
                                "k int, x double, y double, z double")
    got = {r.k: r for r in L.point_moments(pts, ["k"], exact=True).collect()}
    xs, ys = np.array([0.25, 1.5, -3.0, 2e5]), np.array([1e6, -1e6, 12.0, 7.5])
    assert np.isclose(got[1].x_sigma, xs.std(), rtol=1e-12) and np.isclose(got[1].y_sigma, ys.std(), rtol=1e-12)
    assert got[1].z_sigma == 0 and got[2].x_max == 1e30 and got[2].x_sigma == 0


def clip_views(spark, far=0.0, chunks=3, n=12, size=6, overlap=2, h=6, w=8):
    """A turning, moving camera over rough depth, seen by chunks that differ by known similarities."""
    import numpy as np
    rng = np.random.default_rng(5)
    frames, lines, world = [], [], {}
    k = [20.0, 0.0, w / 2, 0.0, 20.0, h / 2, 0.0, 0.0, 1.0]

    def turn(a):
        return np.array([[math.cos(a), 0, math.sin(a)], [0, 1, 0], [-math.sin(a), 0, math.cos(a)]])

    depth = {f: np.float32(rng.uniform(2, 6, size=(h, w))) for f in range(n)}
    for f in range(n):
        world[f] = (turn(0.1 * f), np.array([0.3 * f + far, 0.1 * f - far, far]))
    for c in range(chunks):
        s, r, t = 1.5 ** -c, turn(0.7 * c), np.array([1.0, -2.0, 0.5]) * c
        for local, f in enumerate(range(c * (size - overlap), min(n, c * (size - overlap) + size))):
            rot, pos = r @ world[f][0], s * (r @ world[f][1]) + t
            pose = np.eye(4)
            pose[:3, :3], pose[:3, 3] = rot.T, -rot.T @ pos
            frames.append((0, f, float(f), True, k, [float(x) for x in pose.ravel()], c, local, chunks))
            lines += [(0, f, v, [float(x) for x in depth[f][v] * np.float32(s)], [float((v * 3 + u + f) % 10) / 10 for u in range(w)], c)
                      for v in range(h)]
    more = ", chunk_id long, local long, n_chunks long"
    frames = spark.createDataFrame(frames, "video_id long, frame_idx long, ts double, is_metric boolean, k array<double>, t_wc array<double>" + more)
    lines = spark.createDataFrame(lines, "video_id long, frame_idx long, v int, depth array<float>, conf array<float>, chunk_id long")
    return frames, lines, depth, world


def test_lines_side_by_side_hold_the_point_pairs(spark):
    frames, lines, _, _ = clip_views(spark)
    by_line = A.line_pairs(A.overlap_lines(lines, frames))
    # the same pixels through rows of points; a chunk's frames are told apart by their number
    apart = lambda d: d.withColumn("frame_idx", F.col("frame_idx") + 100 * F.col("chunk_id"))
    pts = L.backproject_frame(apart(lines), apart(frames)).withColumn("chunk_id", F.expr("frame_idx div 100")).withColumn("frame_idx", F.col("frame_idx") % 100)
    by_point = A.overlap_pairs(pts)
    sums, plain = (d.orderBy("pair_id").collect() for d in (A.line_moments(A.overlap_lines(lines, frames)), A.umeyama_moments(by_line)))
    assert [tuple(r) for r in sums] == [pytest.approx(tuple(r), abs=1e-9) for r in plain]
    key = ["pair_id", "frame_idx", "v", "u"]
    cols = [f"{n}{c}" for n in "st" for c in "xyz"] + ["w"]
    a, b = rows(by_line, *key, *cols), rows(by_point, *key, *cols)
    assert len(a) == len(b) > 50 and [r[:4] for r in a] == [r[:4] for r in b]
    assert all(x[4:] == pytest.approx(y[4:], abs=1e-4) for x, y in zip(a, b))


@pytest.mark.parametrize("robust", [False, True])
def test_chunks_come_back_to_one_world(spark, robust):
    import numpy as np
    frames, lines, depth, world = clip_views(spark)
    got, scaled = A.align_video(frames, lines, 6, 2, robust)
    poses = {r.frame_idx: np.array(r.t_wc).reshape(4, 4) for r in got.collect()}
    assert sorted(poses) == sorted(world) and got.count() == len(world)
    for f, pose in poses.items():
        rot, pos = pose[:3, :3].T, -pose[:3, :3].T @ pose[:3, 3]
        first, start = world[0]
        assert np.allclose(rot, first.T @ world[f][0], atol=1e-5) and np.allclose(pos, first.T @ (world[f][1] - start), atol=1e-4)
    found = {(r.frame_idx, r.v): r.depth for r in scaled.collect()}
    assert len(found) == len(world) * 6
    assert all(np.allclose(d, depth[f][v], rtol=1e-5) for (f, v), d in found.items())


def test_one_chunk_and_no_chunk(spark):
    frames, lines, _, world = clip_views(spark, chunks=1, n=6)
    got, scaled = A.align_video(frames, lines, 6, 2)
    assert got.count() == 6 and scaled.count() == 36
    none, empty = A.align_video(frames.filter("false"), lines.filter("false"), 6, 2)
    assert none.count() == 0 and empty.count() == 0


def test_similarity_far_from_the_origin(spark):
    """A scene at 1e5 m gives the similarity of the scene at 0."""
    import numpy as np
    rng = np.random.default_rng(4)
    src = rng.normal(size=(200, 3))
    fields = "video_id long, pair_id long, " + ", ".join(f"{n}{c} double" for n in "st" for c in "xyz") + ", w double"
    dst = 1.25 * src[:, [2, 1, 0]] * np.array([1.0, 1.0, -1.0])
    for far in (0.0, 1e5):
        pairs = spark.createDataFrame([(0, 0, *map(float, s + far), *map(float, d - far), 1.0) for s, d in zip(src, dst)], fields)
        got = A.estimate_similarity(pairs, robust=False).first()
        assert got.s == pytest.approx(1.25, abs=1e-8)
        assert got.r == pytest.approx([0, 0, 1, 0, 1, 0, -1, 0, 0], abs=1e-8)


def test_whole_rasters_are_lifted_in_tasks_that_follow_the_pixels(spark, monkeypatch):
    monkeypatch.setattr(L, "_A_TASK", 32)
    lines = spark.createDataFrame([(0, f, v, [2.0] * 4, [1.0] * 4) for f in range(50) for v in range(4)], schema.DEPTH_ROWS)
    k, pose = [100.0, 0.0, 0.0, 0.0, 100.0, 0.0, 0.0, 0.0, 1.0], [float(i % 5 == 0) for i in range(16)]
    frames = spark.createDataFrame([(0, f, float(f), True, k, pose) for f in range(50)], "video_id long, frame_idx long, ts double, is_metric boolean, k array<double>, t_wc array<double>")
    pts = L.backproject_frame(lines, frames)
    assert rows(pts.filter("frame_idx = 7"), "v", "u", "x", "y", "z") == [
        (v, u, pytest.approx(u / 50, abs=1e-7), pytest.approx(v / 50, abs=1e-7), 2.0) for v in range(4) for u in range(4)]
    assert pts.count() == 800
    assert pts.rdd.getNumPartitions() == 25  # 800 pixels
