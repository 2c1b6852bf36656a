"""Queries over relations between objects, across frames and across views."""

from __future__ import annotations

from pyspark.sql import functions as F

from sceneloom.functions import geometry as g
from sceneloom.operators import components as Cc
from sceneloom.operators import lift as L
from sceneloom.operators import masks as M
from sceneloom.operators import relations as R
from sceneloom.operators import tracks as T
from sceneloom.plans.geometry_queries import _INV, _TURNS
from sceneloom.plans.registry import query
from sceneloom.schema import DET, FRAME

_PAIRS = """select a.frame_idx, a.object_id as src, b.object_id as dst, b.x - a.x as dx, b.y - a.y as dy, b.z - a.z as dz,
    sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)) as dist
    from points a join points b on a.frame_idx = b.frame_idx and a.object_id < b.object_id"""
_PAPER = """case when abs(dx) > abs(dy) then case when dx > 0 then 'right' else 'left' end
    when dy > 0 then 'front' else 'back' end || '_' || case when dz > 5e-1 then 'above' when dz < -5e-1 then 'below' else 'level' end"""
_NOTEBOOK = """case when dx > 0 then 'right' when abs(dx) > abs(dy) then 'left' when dy > 0 then 'front' else 'back' end || '_' ||
    case when dz > 3e-1 then 'above' when dz < -3e-1 then 'below' else 'level' end || '_' ||
    case when dist < 3 then 'near' when dist < 8 then 'medium' else 'far' end"""


@query("spatial_edges", f"""select frame_idx, src, dst, dist, {_PAPER} as relation, dx / (dist + 1e-8) as ux,
    dy / (dist + 1e-8) as uy, dz / (dist + 1e-8) as uz from pairs where dist < 4e0""", pairs=_PAIRS)
def spatial_edges(v):
    return R.spatial_edges(v.points, 4.0).drop("video_id")


@query("spatial_edges_notebook", f"select frame_idx, src, dst, dist, {_NOTEBOOK} as relation from pairs where dist < 5e1",
       pairs=_PAIRS)
def spatial_edges_notebook(v):
    return R.spatial_edges(v.points, 50.0, "notebook").select("frame_idx", "src", "dst", "dist", "relation")


@query("relation_label", f"select src, dst, {_PAPER} as paper, {_NOTEBOOK} as notebook from pairs where dist < 1e1", pairs=_PAIRS)
def relation_label(v):
    p = R.near_pairs(v.points, 10.0)
    d = [F.col(f"t.{c}") - F.col(f"s.{c}") for c in "xyz"]
    return p.select(F.col("s.id").alias("src"), F.col("t.id").alias("dst"),
                    g.relation_label(*d, F.col("dist"), "paper").alias("paper"),
                    g.relation_label(*d, F.col("dist"), "notebook").alias("notebook"))


@query("top_k_edges", """select frame_idx, src, dst, dist from (select *, row_number() over (
    partition by frame_idx order by src, dst) as rn from pairs where dist < 5e1) where rn <= 20""", pairs=_PAIRS)
def top_k_edges(v):
    return R.first_edges(v.points, 20, 50.0, "notebook").select("frame_idx", "src", "dst", "dist")


@query("relations_at", "select src, dst, dist from pairs where dist < 4e0 and frame_idx = 1", pairs=_PAIRS)
def relations_at(v):
    return R.relations_at(R.spatial_edges(v.points, 4.0), 1).select("src", "dst", "dist")


_BOTH = """select frame_idx, src, dst, dx, dy, dz, dist from pairs union all
    select frame_idx, dst, src, -dx, -dy, -dz, dist from pairs"""
_NEAR = """select * from (select *, row_number() over (partition by frame_idx, src order by dist, dst) as rank from both_ways)
    where rank <= 3"""


@query("nearest", "select frame_idx, src, dst, rank, dist from near", pairs=_PAIRS, both_ways=_BOTH, near=_NEAR)
def nearest(v):
    return R.nearest(v.points, 3).select("frame_idx", "src", "dst", "rank", "dist")


_SECTORS = "['front','front-left','left','back-left','back','back-right','right','front-right']"
_SECTOR = f"{_SECTORS}[1 + ((floor((degrees(atan2(-dx, dz)) + 225e-1) / 45e0)::bigint % 8) + 8) % 8]"


@query("knn_edges", f"""select frame_idx, rn as "order", src, dst, dist, {_SECTOR} as dir,
    case when -dy > 5e-1 then 'above' when -dy < -5e-1 then 'below' else 'level' end as elev from (
    select *, row_number() over (partition by frame_idx order by dist, src, dst) as rn from near) where rn <= 20""",
       pairs=_PAIRS, both_ways=_BOTH, near=_NEAR)
def knn_edges(v):
    return R.knn_edges(v.points, 3, 20).drop("video_id")


_EGO = f"""select p.frame_idx, object_id, {_SECTOR} as bearing, case when -dy > 5e-1 then 'above' when -dy < -5e-1 then 'below'
        else 'level' end as elev, sqrt(dx * dx + dy * dy + dz * dz) as dist_m from (
    select p.*, r[1]*x + r[2]*y + r[3]*z + t0 as dx, r[4]*x + r[5]*y + r[6]*z + t1 as dy, r[7]*x + r[8]*y + r[9]*z + t2 as dz
    from points p join turns t on t.video_id = 0 and t.frame_idx = p.frame_idx) p"""


@query("ego_relations", "select * from ego", turns=_TURNS, ego=_EGO)
def ego_relations(v):
    return R.ego_relations(v.points, v.turning_frames).drop("video_id", "side")


@query("ego_relations_latest", "select * from ego where frame_idx = (select max(frame_idx) from points)", turns=_TURNS, ego=_EGO)
def ego_relations_latest(v):
    return R.ego_relations(R.latest_frame(v.points), v.turning_frames).drop("video_id", "side")


# distance and sideways offset of tracked objects, in eighths
_PATHS = """select video_id, local_obj_id as object_id, frame_idx, min(det_seq) as det_seq,
    (min(det_seq) % 97) / 8e0 as dist, (min(det_seq) % 61) / 8e0 as side from dets group by all"""


def paths(v):
    d = v.detections.groupBy("video_id", F.col("local_obj_id").alias("object_id"), "frame_idx").agg(F.min("det_seq").alias("det_seq"))
    return d.withColumn("dist", (F.col("det_seq") % 97) / F.lit(8.0)).withColumn("side", (F.col("det_seq") % 61) / F.lit(8.0))


@query("motion_label", """select video_id, object_id, frame_idx, case when f is null then 'unknown'
        when (dist - d) / (frame_idx - f) > 1e0 then 'receding' when (dist - d) / (frame_idx - f) < -1e0 then 'approaching'
        when (side - s) / (frame_idx - f) > 5e-1 then 'moving-left' when (side - s) / (frame_idx - f) < -5e-1 then 'moving-right'
        else 'static' end as motion from (
    select *, lag(frame_idx, 2) over w as f, lag(dist, 2) over w as d, lag(side, 2) over w as s from paths
    window w as (partition by video_id, object_id order by frame_idx))""", paths=_PATHS)
def motion_label(v):
    return T.motion_label(paths(v), 3, 1.0, 0.5, bucket=16).select("video_id", "object_id", "frame_idx", "motion")


@query("filter_motion_outliers", """select video_id, object_id, f as from_frame, frame_idx, sqrt((dist - d) * (dist - d) + (side - s) * (side - s)
        + (4e0 - 4e0) * (4e0 - 4e0)) / (frame_idx - f) as step_speed from (
    select *, lag(frame_idx) over w as f, lag(dist) over w as d, lag(side) over w as s from paths
    window w as (partition by video_id, object_id order by frame_idx))
    where sqrt((dist - d) * (dist - d) + (side - s) * (side - s)) / (frame_idx - f) > 3e0""", paths=_PATHS)
def filter_motion_outliers(v):
    p = paths(v).select("video_id", "object_id", "frame_idx", F.col("dist").alias("x"), F.col("side").alias("y"), F.lit(4.0).alias("z"))
    return T.filter_motion_outliers(p, 3.0, bucket=16)


# ---- matching

_CAND = """select a.video_id, a.frame_idx as prev_frame, b.frame_idx, a.det_seq as prev_id, b.det_seq as object_id,
        5e-1 * (dist + 1e-1 * sqrt(dsq + (b.x_sigma - a.x_sigma) ** 2 + (b.x_min - a.x_min) ** 2 + (b.x_max - a.x_max) ** 2
            + (b.y_sigma - a.y_sigma) ** 2 + (b.y_min - a.y_min) ** 2 + (b.y_max - a.y_max) ** 2
            + (b.z_sigma - a.z_sigma) ** 2 + (b.z_min - a.z_min) ** 2 + (b.z_max - a.z_max) ** 2))
        + 5e-1 * (1e0 - coalesce(len(list_intersect(a.tau, b.tau)) / len(list_distinct(a.tau || b.tau)), 0e0)) as cost
    from (select * from aobs) a join (select * from aobs) b on a.video_id = b.video_id and b.frame_idx = a.frame_idx + 1,
        lateral (select sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) + (a.cz - b.cz) * (a.cz - b.cz)) as dist,
            (b.cx - a.cx) ** 2 + (b.cy - a.cy) ** 2 + (b.cz - a.cz) ** 2 as dsq) where dist < 1e0"""
_AOBS = """select o.*, coalesce(c.tau, []) as tau from obs o left join (
    select det_seq, list(row * 16 + col) as tau from cells group by all) c using (det_seq)"""


@query("associate_frames", """select video_id, prev_frame, frame_idx, prev_id, object_id, cost from (select *,
        row_number() over (partition by video_id, frame_idx, prev_id order by cost, object_id) as ra,
        row_number() over (partition by video_id, frame_idx, object_id order by cost, prev_id) as rb from cand where cost < 5e-1)
    where ra = 1 and rb = 1""", cand=_CAND, aobs=_AOBS)
def associate_frames(v):
    s = L.object_state(v.spans, v.depth_rows, v.frames, min_points=30, exact=True)
    return R.associate_frames(v.settle(s).withColumnRenamed("det_seq", "object_id"), v.frames, threshold=0.5)


@query("associate_least_cost")
def associate_least_cost(v):
    """The same pairs matched at the least total cost; tests compare it with all matchings."""
    s = L.object_state(v.spans, v.depth_rows, v.frames, min_points=30, exact=True)
    return R.associate_frames(v.settle(s).withColumnRenamed("det_seq", "object_id"), v.frames, threshold=0.5, matching="least")


_VIEWS = """select frame_idx, a.object_id % 3 as l_view, b.object_id % 3 as r_view, a.object_id as l_id, b.object_id as r_id,
    sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)) as dist
    from points a join points b using (frame_idx) where a.object_id % 3 < b.object_id % 3"""
_MATCHED = """select * from (select *, row_number() over (partition by frame_idx, l_view, r_view, l_id order by dist, r_id) as ra,
        row_number() over (partition by frame_idx, l_view, r_view, r_id order by dist, l_id) as rb from view_pairs where dist < 5e0)
    where ra = 1 and rb = 1"""


@query("match_views", "select frame_idx, l_view, r_view, l_id, r_id, dist from matched", view_pairs=_VIEWS, matched=_MATCHED)
def match_views(v):
    return R.match_views(v.points.withColumn("view", F.col("object_id") % 3), 5.0).drop("video_id")


@query("match_views_least_cost")
def match_views_least_cost(v):
    return R.match_views(v.points.withColumn("view", F.col("object_id") % 3), 5.0, matching="least").drop("video_id")


@query("merge_views", """select coalesce(l.label, p.object_id) as pooled_id, count(*) as n_points,
        sum(floor(x * 1e6)::bigint)::bigint as sx
    from points p left join (select node, min(hit) as label from walk group by all) l on l.node = p.object_id group by all""",
       view_pairs=_VIEWS, matched=_MATCHED, reach="select l_id as a, r_id as b from matched union select r_id, l_id from matched",
       walk="select a as node, a as hit from reach union select w.node, r.b from walk w join reach r on r.a = w.hit")
def merge_views(v):
    m = R.match_views(v.points.withColumn("view", F.col("object_id") % 3), 5.0)
    pooled = Cc.merge_views(v.points, m.select("video_id", F.col("l_id").alias("a"), F.col("r_id").alias("b")))
    return pooled.groupBy("pooled_id").agg(F.count(F.lit(1)).alias("n_points"),
                                           F.sum(F.floor(F.col("x") * F.lit(1e6))).alias("sx"))


# ---- rankings by depth

@query("foreground", """select video_id, frame_idx, object_id, median_z, rank from (select *, row_number() over (
    partition by frame_idx order by median_z, object_id) as rank from (
        select 0::bigint as video_id, frame_idx, object_id % 7 as object_id, quantile_cont(z, 5e-1) as median_z from points group by all))
    where rank <= 4""")
def foreground(v):
    p = v.points.withColumn("object_id", F.col("object_id") % 7)
    return R.foreground(p, 4, FRAME)


_RANKED = """select frame_idx, object_id, row_number() over (partition by frame_idx order by z, object_id) as z_rank,
    row_number() over (partition by frame_idx order by x, object_id) as x_order from points
    where frame_idx in (select frame_idx from points group by all having count(*) >= 5)"""


@query("depth_rank", "select * from ranked", ranked=_RANKED)
def depth_rank(v):
    return R.depth_rank(v.points, 5).select("frame_idx", "object_id", "z_rank", "x_order")


@query("rank_changes", """select frame_idx, ranking, coalesce(p <> ranking, false) as changed from (
    select *, lag(ranking) over (order by frame_idx) as p from (
        select frame_idx, string_agg(z_rank, ',' order by x_order) as ranking from ranked group by all))""",
       ranked=_RANKED)
def rank_changes(v):
    return R.rank_changes(R.depth_rank(v.points, 5), bucket=4).drop("video_id")
