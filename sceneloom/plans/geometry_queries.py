"""Queries over frames, poses, depth lines and points."""

from __future__ import annotations

from pyspark.sql import functions as F

from sceneloom.functions import geometry as g
from sceneloom.operators import align as A
from sceneloom.operators import lift as L
from sceneloom.operators import raster as R
from sceneloom.operators import relations as Rel
from sceneloom.operators import sampling as S
from sceneloom.operators import visibility as Vi
from sceneloom.plans.registry import query
from sceneloom.schema import DET, FRAME
from sceneloom.sources.readers import frame_times


@query("frame_times", "select video_id, source_idx, case when fps > 0 then source_idx / fps else 0e0 end as ts from manifest")
def times(v):
    return frame_times(v.manifest).select("video_id", "source_idx", "ts")


def _bucket(target: str) -> str:
    return f"""select video_id, source_idx from (select *, coalesce(lag(b) over (partition by video_id order by source_idx), -1) as p
        from (select *, case when fps > 0 then floor((source_idx / fps + 1e-9) / (1 / {target})) end as b from manifest))
        where fps <= 0 or b > p"""


@query("sample_fps", "select * from kept", kept=_bucket("10e0"))
def sample_fps(v):
    return S.sample_fps(v.manifest, 10).select("video_id", "source_idx")


@query("sample_fps_slow", "select * from kept", kept=_bucket("25e-1"))
def sample_fps_slow(v):
    return S.sample_fps(v.manifest, 2.5).select("video_id", "source_idx")


@query("cap_frames", """select video_id, source_idx from (select *, row_number() over (
    partition by video_id order by source_idx) as rn from kept) where rn <= 17""", kept=_bucket("25e-1"))
def cap_frames(v):
    return S.cap_frames(S.sample_fps(v.manifest, 2.5), 17).select("video_id", "source_idx")


@query("sample_even", """select video_id, frame_idx, det_seq from (
    select *, row_number() over (partition by video_id order by frame_idx, det_seq) - 1 as r,
        count(*) over (partition by video_id) as n from dets)
    where n <= 32 or r in (select case when i = 31 then n - 1 else floor(i * ((n - 1) / 31e0))::bigint end
        from (select unnest(range(32)) as i))""")
def sample_even(v):
    return S.sample_even(v.detections, ["video_id"], "frame_idx", 32, ["det_seq"], bucket=16).select(*DET)


@query("sample_stride", """select video_id, source_idx from (select *, round_even(fps / 7e0, 0)::bigint as s from manifest)
    where source_idx % greatest(1, s) = 0""")
def sample_stride(v):
    return S.sample_stride(v.manifest, 7.0).select("video_id", "source_idx")


@query("slice_frames", "select video_id, frame_idx from frames where frame_idx between 11 and 101 and (frame_idx - 11) % 6 = 0")
def slice_frames(v):
    return S.slice_frames(v.frames, 11, 101, 6).select(*FRAME)


# ---- poses

_TURNS = """select f.video_id, f.frame_idx, r, 5e-1 * f.frame_idx as t0, -25e-2 * f.frame_idx as t1, 2e0 * (f.video_id % 3) as t2
    from (select *, [[1e0,0e0,0e0,0e0,1e0,0e0,0e0,0e0,1e0], [0e0,0e0,1e0,0e0,1e0,0e0,-1e0,0e0,0e0],
        [1e0,0e0,0e0,0e0,6e-1,-8e-1,0e0,8e-1,6e-1], [-1e0,0e0,0e0,0e0,1e0,0e0,0e0,0e0,-1e0]][1 + frame_idx % 4] as r
        from frames) f"""
_INV = """select video_id, frame_idx, r, t0, t1, t2, i, 0e0 - (i[1] * t0 + i[2] * t1 + i[3] * t2) as p0,
    0e0 - (i[4] * t0 + i[5] * t1 + i[6] * t2) as p1, 0e0 - (i[7] * t0 + i[8] * t1 + i[9] * t2) as p2 from (
    select *, [(r[5]*r[9]-r[6]*r[8])/d, (r[3]*r[8]-r[2]*r[9])/d, (r[2]*r[6]-r[3]*r[5])/d,
               (r[6]*r[7]-r[4]*r[9])/d, (r[1]*r[9]-r[3]*r[7])/d, (r[3]*r[4]-r[1]*r[6])/d,
               (r[4]*r[8]-r[5]*r[7])/d, (r[2]*r[7]-r[1]*r[8])/d, (r[1]*r[5]-r[2]*r[4])/d] as i from (
    select *, r[1]*(r[5]*r[9]-r[6]*r[8]) + r[2]*(r[6]*r[7]-r[4]*r[9]) + r[3]*(r[4]*r[8]-r[5]*r[7]) as d from turns))"""


@query("pose_to_4x4", """select video_id, frame_idx, r[1] as m00, t0 as m03, r[6] as m12, t2 as m23, 0e0 as m30, 1e0 as m33
    from turns""", turns=_TURNS)
def pose_to_4x4(v):
    cut = F.when(F.col("frame_idx") % 2 == 0, F.slice("t_wc", 1, 12)).otherwise(F.col("t_wc"))
    t = F.col("full")
    return v.turning_frames.select(*FRAME, g.pose_to_4x4(cut).alias("full")).select(
        *FRAME, t[0].alias("m00"), t[3].alias("m03"), t[6].alias("m12"), t[11].alias("m23"), t[12].alias("m30"), t[15].alias("m33"))


@query("pose_inverse", "select video_id, frame_idx, i[1] as r0, i[2] as r1, i[6] as r5, i[8] as r7, p0, p1, p2 from inv",
       turns=_TURNS, inv=_INV)
def pose_inverse(v):
    t = F.col("inv")
    return v.turning_frames.select(*FRAME, g.pose_inverse(F.col("t_wc")).alias("inv")).select(
        *FRAME, t[0].alias("r0"), t[1].alias("r1"), t[6].alias("r5"), t[9].alias("r7"),
        t[3].alias("p0"), t[7].alias("p1"), t[11].alias("p2"))


@query("ego_track", "select video_id, frame_idx, p0 as x, p1 as y, p2 as z from inv", turns=_TURNS, inv=_INV)
def ego_track(v):
    return L.ego_track(v.turning_frames)


@query("normalise_poses", """select t.video_id, t.frame_idx,
    case when t.frame_idx = 0 then 1e0 else t.r[1]*o.i[1] + t.r[2]*o.i[4] + t.r[3]*o.i[7] end as r00,
    case when t.frame_idx = 0 then 0e0 else t.r[4]*o.i[2] + t.r[5]*o.i[5] + t.r[6]*o.i[8] - 1e0 + 1e0 end as r11x,
    case when t.frame_idx = 0 then 0e0 else t.r[1]*o.p0 + t.r[2]*o.p1 + t.r[3]*o.p2 + t.t0 end as tx,
    case when t.frame_idx = 0 then 0e0 else t.r[7]*o.p0 + t.r[8]*o.p1 + t.r[9]*o.p2 + t.t2 end as tz
    from turns t join inv o on o.video_id = t.video_id and o.frame_idx = 0""", turns=_TURNS, inv=_INV)
def normalise_poses(v):
    t = F.col("t_wc")
    first = F.col("frame_idx") == 0
    return A.normalise_poses(v.turning_frames).select(
        *FRAME, t[0].alias("r00"), F.when(first, 0.0).otherwise(t[5] - 1.0 + 1.0).alias("r11x"),
        t[3].alias("tx"), t[11].alias("tz"))


def _sized(v):
    """Frames with original and processed raster sizes."""
    wide = F.col("video_id") % 2 == 0
    return v.frames.withColumn("orig_w", F.when(wide, 1920).otherwise(854)).withColumn(
        "orig_h", F.when(wide, 1080).otherwise(480)).withColumn("proc_w", F.lit(504)).withColumn(
        "proc_h", F.when(wide, 280).otherwise(266))


@query("rescale_intrinsics", """select video_id, frame_idx, 5e2 * sx as fx, 32e0 * sx as cx, 5e2 * sy as fy, 32e0 * sy as cy from (
    select *, case when video_id % 2 = 0 then 1920 else 854 end / 504e0 as sx,
        case when video_id % 2 = 0 then 1080 / 280e0 else 480 / 266e0 end as sy from frames)""")
def rescale_intrinsics(v):
    k = F.col("k")
    return R.rescale_intrinsics(_sized(v)).select(*FRAME, k[0].alias("fx"), k[2].alias("cx"), k[4].alias("fy"), k[5].alias("cy"))


@query("rescale_intrinsics_crop", """select video_id, frame_idx, 5e2 * sx as fx, (32 + cx0) * sx as cx, 5e2 * sy as fy, (32 + cy0) * sy as cy
    from (select *, floor((rw - 504) / 2e0) as cx0, floor((rh - ph) / 2e0) as cy0, ow / rw as sx, oh / rh as sy from (
        select *, greatest(1, round_even(ow * (504e0 / oh), 0)::int) as rw, greatest(1, round_even(oh * (504e0 / oh), 0)::int) as rh from (
            select *, case when video_id % 2 = 0 then 1920 else 854 end as ow, case when video_id % 2 = 0 then 1080 else 480 end as oh,
                case when video_id % 2 = 0 then 280 else 266 end as ph from frames)))""")
def rescale_intrinsics_crop(v):
    k = F.col("k")
    return R.rescale_intrinsics(_sized(v), "lower_bound_crop").select(
        *FRAME, k[0].alias("fx"), k[2].alias("cx"), k[4].alias("fy"), k[5].alias("cy"))


# ---- depth lines and pixels

_LINES = "select video_id, frame_idx, v from frames, (select unnest(range(64)) as v)"
_RASTER = """select video_id, frame_idx, v, u, 5e0 + v / 64e0 * 5e-1 as d,
    cast(((u * 31 + v * 17 + frame_idx) % 100) / 1e2 as float) as conf
    from frames, (select unnest(range(64)) as v), (select unnest(range(64)) as u)"""


@query("valid_depth_pixels", """select video_id, frame_idx, det_seq, count(*) as n, sum(u)::bigint as su, sum(v)::bigint as sv
    from pixels where (u + v + frame_idx) % 97 > 3 and ((u * 31 + v * 17 + frame_idx) % 100) >= 50 group by all""")
def valid_depth_pixels(v):
    return L.masked_pixels(v.spans, v.flawed_depth_rows).groupBy(*DET).agg(
        F.count(F.lit(1)).alias("n"), F.sum("u").alias("su"), F.sum("v").alias("sv"))


@query("missing_confidence", """select video_id, frame_idx, det_seq, count(*) as n from pixels
    where (u + v + frame_idx) % 97 > 3 group by all""")
def missing_confidence(v):
    lines = v.flawed_depth_rows.withColumn("conf", F.lit(None).cast("array<float>"))
    return L.masked_pixels(v.spans, lines).groupBy(*DET).agg(F.count(F.lit(1)).alias("n"))


# M = R K^-1 for K = (500, 0, 32; 0, 500, 32; 0, 0, 1)
_POINTS = """select video_id, frame_idx, v, u, cast((i[1] * kf * u + i[2] * kf * v + (i[1] * kc + i[2] * kc + i[3])) * d + p0 as float)::double as x,
    cast((i[4] * kf * u + i[5] * kf * v + (i[4] * kc + i[5] * kc + i[6])) * d + p1 as float)::double as y,
    cast((i[7] * kf * u + i[8] * kf * v + (i[7] * kc + i[8] * kc + i[9])) * d + p2 as float)::double as z
    from (select *, 1e0 / 5e2 as kf, -32e0 / 5e2 as kc from raster) join inv using (video_id, frame_idx)"""
_SUMS = """count(*) as n, sum(floor(x * 1e6)::bigint)::bigint as sx, sum(floor(y * 1e6)::bigint)::bigint as sy,
    sum(floor(z * 1e6)::bigint)::bigint as sz, min(x) as x_min, max(y) as y_max, max(z) as z_max"""


def _point_sums(pts, keys):
    q = lambda c: F.sum(F.floor(F.col(c) * F.lit(1e6)))
    return pts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), q("x").alias("sx"), q("y").alias("sy"), q("z").alias("sz"),
                                  F.min("x").alias("x_min"), F.max("y").alias("y_max"), F.max("z").alias("z_max"))


@query("backproject_frame", f"select video_id, frame_idx, {_SUMS} from points3 group by all",
       turns=_TURNS, inv=_INV, raster=_RASTER, points3=_POINTS)
def backproject_frame(v):
    return _point_sums(L.backproject_frame(v.depth_rows, v.turning_frames), FRAME)


@query("backproject", f"""select video_id, frame_idx, det_seq, {_SUMS} from points3 join pixels using (video_id, frame_idx, v, u)
    where ((u * 31 + v * 17 + frame_idx) % 100) >= 50 group by all""",
       turns=_TURNS, inv=_INV, raster=_RASTER, points3=_POINTS)
def backproject(v):
    return _point_sums(L.backproject_masked(v.spans, v.depth_rows, v.turning_frames), DET)


@query("centroid_shape", "select video_id, frame_idx, det_seq, n_points, cx, cy, cz, x_sigma, y_sigma, z_sigma from moments")
def centroid_shape(v):
    pts = L.backproject_masked(v.spans, v.depth_rows, v.frames)
    return L.point_moments(pts, DET, exact=True).select(*DET, "n_points", "cx", "cy", "cz", "x_sigma", "y_sigma", "z_sigma")


@query("filter_min_points", "select video_id, frame_idx, det_seq, n_points from moments where n_points >= 80")
def filter_min_points(v):
    m = L.object_moments(v.spans, v.depth_rows, v.frames, exact=True)
    return L.filter_min_points(m, 80).select(*DET, "n_points")


@query("filter_extent", """select video_id, frame_idx, det_seq, n_points from moments
    where not is_metric or greatest(x_max - x_min, y_max - y_min, z_max - z_min) <= 15e-2""")
def filter_extent(v):
    m = L.object_moments(v.spans, v.depth_rows, v.frames, exact=True)
    return L.filter_extent(m, 0.15).select(*DET, "n_points")


@query("filter_implausible", """select video_id, frame_idx, det_seq from (select *, list_max(e) as big,
        coalesce(list_min(list_filter(e, lambda x : x > 1e-2)), 1e0) as small from (
            select *, [x_max - x_min, y_max - y_min, z_max - z_min] as e from moments))
    where big <= 18e-2 and big / small <= 25e-1 and greatest(x_sigma, y_sigma, z_sigma) <= 5e-2""")
def filter_implausible(v):
    m = L.object_moments(v.spans, v.depth_rows, v.frames, exact=True)
    return L.filter_implausible(m, 0.18, 2.5, 0.05).select(*DET)


@query("resample_bilinear", """select video_id, frame_idx, v, count(*) as n, sum(floor(d * 1e6)::bigint)::bigint as sd,
        sum(floor(c * 1e6)::bigint)::bigint as sc from (
    select a.video_id, a.frame_idx, v, u,
        cast((1e0 - wy) * ((1e0 - wx) * d00 + wx * d01) + wy * ((1e0 - wx) * d10 + wx * d11) as float)::double as d,
        cast((1e0 - wy) * ((1e0 - wx) * c00 + wx * c01) + wy * ((1e0 - wx) * c10 + wx * c11) as float)::double as c from (
        select f.video_id, f.frame_idx, v, u, y - floor(y) as wy, x - floor(x) as wx,
            (5e0 + floor(y) / 64e0 * 5e-1)::float as d00, (5e0 + floor(y) / 64e0 * 5e-1)::float as d01,
            (5e0 + least(floor(y) + 1, 63) / 64e0 * 5e-1)::float as d10, (5e0 + least(floor(y) + 1, 63) / 64e0 * 5e-1)::float as d11,
            (((floor(x)::bigint * 31 + floor(y)::bigint * 17 + f.frame_idx) % 100) / 1e2)::float as c00,
            (((least(floor(x)::bigint + 1, 63) * 31 + floor(y)::bigint * 17 + f.frame_idx) % 100) / 1e2)::float as c01,
            (((floor(x)::bigint * 31 + least(floor(y)::bigint + 1, 63) * 17 + f.frame_idx) % 100) / 1e2)::float as c10,
            (((least(floor(x)::bigint + 1, 63) * 31 + least(floor(y)::bigint + 1, 63) * 17 + f.frame_idx) % 100) / 1e2)::float as c11
        from frames f, (select v, least(greatest((v + 5e-1) * (64e0 / 48e0) - 5e-1, 0e0), 63e0) as y from (select unnest(range(48)) as v)),
            (select u, least(greatest((u + 5e-1) * (64e0 / 96e0) - 5e-1, 0e0), 63e0) as x from (select unnest(range(96)) as u))) a)
    group by all""")
def resample_bilinear(v):
    r = R.resample_raster(v.depth_rows, (64, 64), (48, 96))
    px = r.select(*FRAME, "v", F.explode(F.arrays_zip("depth", "conf")).alias("p"))
    q = lambda c: F.sum(F.floor(F.col(f"p.{c}").cast("double") * F.lit(1e6)))
    return px.groupBy(*FRAME, "v").agg(F.count(F.lit(1)).alias("n"), q("depth").alias("sd"), q("conf").alias("sc"))


@query("resample_nearest", """select video_id, frame_idx, v, sum(floor(((((floor(u * (64e0 / 40e0))::bigint * 31
        + floor(v * (64e0 / 90e0))::bigint * 17 + frame_idx) % 100) / 1e2)::float)::double * 1e6)::bigint)::bigint as sc
    from frames, (select unnest(range(90)) as v), (select unnest(range(40)) as u) group by all""")
def resample_nearest(v):
    r = R.resample_raster(v.depth_rows, (64, 64), (90, 40), "nearest", ("conf",))
    return r.select(*FRAME, "v", F.aggregate("conf", F.lit(0).cast("bigint"), lambda a, c: a + F.floor(
        c.cast("double") * F.lit(1e6))).alias("sc"))


@query("pad_raster", """select video_id, frame_idx, pv as v, (5e0 + least(greatest(pv - 3, 0), 63) / 64e0 * 5e-1) * 71 as sd,
        case when pv < 3 or pv > 66 then 0 else 1 end as lit from frames, (select unnest(range(69)) as pv)""")
def pad_raster(v):
    r = R.pad_raster(v.depth_rows, 3, 2, 4, 3, 64)
    total = F.aggregate("depth", F.lit(0.0), lambda a, d: a + d.cast("double"))
    return r.select(*FRAME, "v", total.alias("sd"), F.exists("conf", lambda c: c > 0).cast("int").alias("lit"))


# ---- points, cameras and labels

@query("bearing_8way", """select video_id, frame_idx, det_seq, deg, ['front','front-left','left','back-left','back','back-right','right',
    'front-right'][1 + ((floor((deg + 225e-1) / 45e0)::bigint % 8) + 8) % 8] as sector
    from (select *, (det_seq % 1441 - 720) * 5e-1 as deg from dets)""")
def bearing_8way(v):
    d = v.detections.withColumn("deg", (F.col("det_seq") % 1441 - 720) * F.lit(0.5))
    return d.select(*DET, "deg", g.bearing_8way(F.col("deg")).alias("sector"))


@query("elevation", """select det_seq, case when dz > 5e-1 then 'above' when dz < -5e-1 then 'below' else 'level' end as elev
    from (select det_seq, (det_seq % 9 - 4) * 25e-2 as dz from dets)""")
def elevation(v):
    return v.detections.select("det_seq", g.elevation((F.col("det_seq") % 9 - 4) * F.lit(0.25)).alias("elev"))


_PROJ = """select point_id, cam, ix, iy, pz > 0 and ix >= 0 and ix < 64 and iy >= 0 and iy < 48 as valid from (
    select point_id, cam, pz, (5e1*px + 0e0*py + 32e0*pz) / case when pz = 0 then 1e-8 else pz end as ix,
        (0e0*px + 5e1*py + 24e0*pz) / case when pz = 0 then 1e-8 else pz end as iy from (
    select p.object_id as point_id, f.frame_idx as cam, r[1]*x + r[2]*y + r[3]*z + t0 as px, r[4]*x + r[5]*y + r[6]*z + t1 as py,
        r[7]*x + r[8]*y + r[9]*z + t2 as pz from points p join turns f on f.video_id = p.video_id))"""


def _all_cameras(v):
    k = F.array(*[F.lit(x) for x in (50.0, 0.0, 32.0, 0.0, 50.0, 24.0, 0.0, 0.0, 1.0)])
    return v.turning_frames.select(
        "video_id", F.col("frame_idx").alias("cam"), "t_wc", k.alias("k"))


def _named_points(v):
    return v.points.select("video_id", F.col("object_id").alias("point_id"), "x", "y", "z")


@query("project_points", "select point_id, cam, ix as img_x, iy as img_y, valid from proj", turns=_TURNS, proj=_PROJ)
def project_points(v):
    return Rel.project_points(_named_points(v), _all_cameras(v), 48, 64, keys=["video_id"]).select("point_id", "cam", "img_x", "img_y", "valid")


@query("visible_points", "select point_id, cam, ix as img_x, iy as img_y from proj where valid", turns=_TURNS, proj=_PROJ)
def visible_points(v):
    """Only the points a camera sees meet it, through cells of space."""
    d = Vi.visible_points(_named_points(v), _all_cameras(v), 48, 64, ["video_id"], cell=1.0)
    return d.select("point_id", "cam", "img_x", "img_y")


@query("assign_points", """select p.point_id, p.cam as frame_idx, coalesce(min(s.det_seq), -1) as det_seq
    from (select *, trunc(ix)::bigint as u, trunc(iy)::bigint as v from proj where valid) p
    left join (select * from spans where video_id = 0) s on s.frame_idx = p.cam and s.v = p.v and s.u0 <= p.u and p.u < s.u1
    group by all""", turns=_TURNS, proj=_PROJ)
def assign_points(v):
    pts = Vi.visible_points(_named_points(v), _all_cameras(v), 48, 64, ["video_id"], cell=1.0).withColumn("frame_idx", F.col("cam"))
    return Rel.assign_points(pts, v.spans, tile=16).select("point_id", "frame_idx", "det_seq")
