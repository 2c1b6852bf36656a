"""Queries over object lives, identity fusion and scenes."""

from __future__ import annotations

from pyspark.sql import functions as F

from sceneloom.operators import fuse as Fu
from sceneloom.operators import lift as L
from sceneloom.operators import masks as M
from sceneloom.operators import quality as Q
from sceneloom.operators import scene as Sc
from sceneloom.operators import tracks as T
from sceneloom.plans.mask_queries import TAU, pixel_boxes, tau_text
from sceneloom.plans.registry import query
from sceneloom.schema import DET, FRAME
from sceneloom.session import written

LOST, ARCHIVE = 2, 4

# one observation per (video, object, frame): the best over all event types
_SEEN = """select video_id, local_obj_id, frame_idx, min(det_seq) as det_seq from dets group by all"""
_SEGS = """select *, sum(case when frame_idx - p - 1 >= 6 then 1 else 0 end) over (
    partition by video_id, local_obj_id order by frame_idx)::bigint as segment from (
    select *, lag(frame_idx) over (partition by video_id, local_obj_id order by frame_idx) as p from seen)"""
# processed frames: every third frame is skipped, so indices are strided
_STRIDED = """select *, row_number() over (partition by video_id order by frame_idx) - 1 as ord from frames where frame_idx % 3 < 2"""


def seen(v):
    return v.detections.groupBy("video_id", "local_obj_id", "frame_idx").agg(F.min("det_seq").alias("det_seq"))


@query("frame_ordinals", "select video_id, frame_idx, ord from strided", strided=_STRIDED)
def frame_ordinals(v):
    return T.frame_ordinals(v.frames.filter("frame_idx % 3 < 2"), bucket=16)


@query("track_segments", "select video_id, local_obj_id, frame_idx, segment from segs", seen=_SEEN, segs=_SEGS)
def track_segments(v):
    return T.track_segments(seen(v), v.frames, LOST, ARCHIVE).select("video_id", "local_obj_id", "frame_idx", "segment")


@query("track_segments_strided", """select video_id, local_obj_id, frame_idx, sum(case when ord - p - 1 >= 5 then 1 else 0 end) over (
        partition by video_id, local_obj_id order by ord)::bigint as segment from (
    select s.*, o.ord, lag(o.ord) over (partition by s.video_id, s.local_obj_id order by o.ord) as p
    from seen s join strided o using (video_id, frame_idx))""", seen=_SEEN, strided=_STRIDED)
def track_segments_strided(v):
    d = T.track_segments(seen(v), v.frames.filter("frame_idx % 3 < 2"), 2, 3, bucket=16)
    return d.select("video_id", "local_obj_id", "frame_idx", "segment")


@query("track_status", """select video_id, local_obj_id, segment, min(frame_idx) as t_start, max(frame_idx) as t_end,
    119 - max(frame_idx) as missing_streak, case when 119 - max(frame_idx) >= 6 then 'archived'
        when 119 - max(frame_idx) >= 2 then 'lost' else 'active' end as status from segs group by all""",
       seen=_SEEN, segs=_SEGS)
def track_status(v):
    return T.track_status(T.track_segments(seen(v), v.frames, LOST, ARCHIVE), v.frames, LOST, ARCHIVE)


@query("track_summary", """select video_id, local_obj_id, min(frame_idx) as t_start, max(frame_idx) as t_end, count(*) as n_obs
    from seen group by all""", seen=_SEEN)
def track_summary(v):
    return T.track_summary(seen(v), ["video_id", "local_obj_id"])


@query("track_window", """select video_id, local_obj_id, frame_idx, t_start, t_end from (select *,
    row_number() over (partition by video_id, local_obj_id order by frame_idx desc) as rn,
    min(frame_idx) over (partition by video_id, local_obj_id) as t_start,
    max(frame_idx) over (partition by video_id, local_obj_id) as t_end from seen) where rn <= 10""", seen=_SEEN)
def track_window(v):
    w = T.track_window(seen(v), 10, ["video_id", "local_obj_id"])
    return w.select("video_id", "local_obj_id", "frame_idx", "t_start", "t_end")


@query("merge_observations", """select video_id, local_obj_id, frame_idx, coalesce(min(case when run_id = 'click' then det_seq end),
    min(case when run_id = 'view' then det_seq end)) as det_seq from dets where run_id in ('click', 'view') group by all""")
def merge_observations(v):
    key = ["video_id", "local_obj_id", "frame_idx"]
    side = lambda r: v.detections.filter(F.col("run_id") == r).groupBy(*key).agg(F.min("det_seq").alias("det_seq"))
    return T.merge_observations(side("click"), side("view"), key)


# ---- fusion

_SINGLE = """select video_id, frame_idx, det_seq, local_obj_id, score, first_value(det_seq) over w as born,
        first_value(frame_idx) over w as born_frame, segment,
        row_number() over (partition by video_id, local_obj_id, frame_idx order by score desc, det_seq) as rn from (
    select *, sum(case when frame_idx - p - 1 >= 6 then 1 else 0 end) over (
        partition by video_id, local_obj_id order by frame_idx, det_seq) as segment from (
        select *, lag(frame_idx) over (partition by video_id, local_obj_id order by frame_idx, det_seq) as p
        from dets where run_id = 'click'))
    window w as (partition by video_id, local_obj_id, segment order by frame_idx, det_seq)"""


@query("fuse_single_run", """select video_id, frame_idx, det_seq, object_id from (
    select *, dense_rank() over (partition by video_id order by born_frame, born) - 1 as object_id from single)
    where rn = 1""", single=_SINGLE)
def fuse_single_run(v):
    c = v.detections.filter("run_id = 'click'")
    none = v.spark.createDataFrame([], "video_id long, frame_idx long, det_seq_a long, det_seq_b long")
    return Fu.fuse_tracks(c, none, v.frames, LOST, ARCHIVE)


_GATED = """select p.video_id, p.frame_idx, p.a, p.b, p.iou,
        sqrt((x.cx - y.cx) * (x.cx - y.cx) + (x.cy - y.cy) * (x.cy - y.cy) + (x.cz - y.cz) * (x.cz - y.cz)) as centroid_dist
    from iou_pairs p join obs x on x.det_seq = p.a join obs y on y.det_seq = p.b where p.iou > 5e-1"""


def fusion_inputs(v):
    """Object states of the deduplicated detections, with their gated pairs."""
    best = v.settle(v.best_boxes)
    # read by the lift and by the gate
    masks = written(M.pack_masks(v.spans_of(best, "run_id"), True, "run_id"))
    states = v.settle(L.object_state(masks, v.depth_rows, v.frames, min_points=30, exact=True))
    pairs = M.mask_iou_pairs(masks, differ="run_id")
    cands = best.select(*DET, "run_id", "local_obj_id", "score").join(states.select(*DET), DET, "left_semi")
    return states, cands, Fu.merge_gate(pairs, states.select(*DET, "cx", "cy", "cz"))


@query("merge_gate", "select * from gated where centroid_dist < 2e0", gated=_GATED)
def merge_gate(v):
    _, _, gated = fusion_inputs(v)
    return gated.select(*FRAME, F.col("det_seq_a").alias("a"), F.col("det_seq_b").alias("b"), "iou", "centroid_dist")


def fused(v):
    states, cands, gated = fusion_inputs(v)
    return Fu.fuse_tracks(cands, gated, v.frames, LOST, ARCHIVE), states


# With a patience and a gap longer than any video nothing is archived and every gated pair
# merges: the objects are then the connected components of the tracker objects.
FOREVER = 1000
_WHOLE = """select video_id, min(frame_idx) as first_frame, max(frame_idx) as last_frame,
        string_agg(distinct frame_idx, ',' order by frame_idx) as frames
    from cand join part using (video_id, k) group by video_id, label"""
WHOLE_PARTS = {
    "gated": _GATED,
    "cand": """select b.video_id, b.frame_idx, b.det_seq, b.run_id || '/' || b.local_obj_id as k
        from best b join obs o using (video_id, frame_idx, det_seq)""",
    "met": """select distinct x.video_id, x.k as p, y.k as q from gated g join cand x on x.det_seq = g.a join cand y on y.det_seq = g.b
        where g.centroid_dist < 2e0""",
    "linked": "select video_id, p, q from met union select video_id, q, p from met",
    "reach": "select distinct video_id, k, k as other from cand union select r.video_id, r.k, l.q from reach r join linked l on l.video_id = r.video_id and l.p = r.other",
    "part": "select video_id, k, min(other) as label from reach group by all",
}


def whole_objects(fused_rows):
    return fused_rows.groupBy("video_id", "object_id").agg(
        F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"),
        F.array_join(F.array_sort(F.collect_set("frame_idx")), ",").alias("frames")).drop("object_id")


@query("fuse_tracks_no_archive", _WHOLE, **WHOLE_PARTS)
def fuse_tracks_no_archive(v):
    _, cands, gated = fusion_inputs(v)
    return whole_objects(Fu.fuse_tracks(cands, gated, v.frames, FOREVER, FOREVER, gap=FOREVER))


@query("fuse_tracks")
def fuse_tracks(v):
    return fused(v)[0]


@query("duplicate_ids", """select video_id, local_obj_id as object_id, frame_idx, count(*) as n from dets
    group by all having count(*) > 1""")
def duplicate_ids(v):
    return Q.duplicate_ids(v.detections.withColumnRenamed("local_obj_id", "object_id"))


@query("duplicate_rate", """select video_id, count(*) as ids, count_if(n > 1) as repeated, count_if(n > 1) / count(*) as rate from (
    select video_id, local_obj_id, frame_idx, count(*) as n from dets group by all) group by all""")
def duplicate_rate(v):
    return Q.duplicate_rate(v.detections.withColumnRenamed("local_obj_id", "object_id"))


# ---- scenes, over the tracks of one run (their ids are known in SQL)

_TRACKS = """select video_id, frame_idx, det_seq, object_id from (
    select *, dense_rank() over (partition by video_id order by born_frame, born) - 1 as object_id from single) where rn = 1"""
_STEPS = f"""select t.*, o.* exclude (video_id, frame_idx, det_seq, n_points, is_metric), coalesce(c.tau, '') as tau from (
        select *, row_number() over (partition by video_id, object_id order by frame_idx desc) as rn,
            min(frame_idx) over (partition by video_id, object_id) as t_start,
            max(frame_idx) over (partition by video_id, object_id) as t_end from tracks) t
    join obs o using (det_seq)
    left join (select det_seq, {TAU} as tau from cells group by all) c using (det_seq) where rn <= 4"""


def single_run_scene(v, window: int = 4):
    c = v.detections.filter("run_id = 'click'")
    none = v.spark.createDataFrame([], "video_id long, frame_idx long, det_seq_a long, det_seq_b long")
    obs = Fu.fuse_tracks(c, none, v.frames, LOST, ARCHIVE)
    states = L.object_state(v.spans_of(v.boxes_raw.filter("run_id = 'click'"), "run_id"), v.depth_rows, v.frames,
                            min_points=1, exact=True)
    obs = v.settle(obs)
    meta, ego, steps = Sc.scene_tables(obs, states, v.frames, window=window)
    return obs, meta, ego, v.settle(steps)


def whole_scene(v):
    """The scene of all runs, nothing archived, so that SQL knows its objects."""
    from sceneloom.operators.build import build_scene
    return build_scene(v.frames, v.depth_rows, v.spans, v.boxes_raw.select(*DET, "run_id", "local_obj_id", "score"), min_points=30,
                       gap=FOREVER, lost=FOREVER, archive=FOREVER, window=4, exact=True)


@query("scene_metadata", """select f.video_id, '16x16' as grid, count(distinct f.frame_idx) as num_frames,
    count(distinct p.label) as num_tracks from frames f
    left join (select distinct video_id, label from cand join part using (video_id, k)) p using (video_id) group by all""", **WHOLE_PARTS)
def scene_metadata(v):
    return whole_scene(v).metadata


def _flat(step):
    s = F.col(step)
    cols = [s["t"].alias("t"), tau_text(s["tau"]).alias("tau"), s["theta"][0].alias("t_start"), s["theta"][1].alias("t_end")]
    for i, a in enumerate("xyz"):
        cols += [s["c"][i].alias(f"c{a}"), s["s"][a]["mu"].alias(f"{a}_mu"), s["s"][a]["sigma"].alias(f"{a}_sigma"),
                 s["s"][a]["min"].alias(f"{a}_min"), s["s"][a]["max"].alias(f"{a}_max")]
    return cols


_FLAT = """select video_id, object_id, frame_idx as t, tau, t_start, t_end, cx, cx as x_mu, x_sigma, x_min, x_max,
    cy, cy as y_mu, y_sigma, y_min, y_max, cz, cz as z_mu, z_sigma, z_min, z_max from steps"""


@query("ordered_scene", """select video_id, string_agg(frame_idx, ',' order by frame_idx) as frames, count(*) as n_steps from (
        select video_id, label, frame_idx, row_number() over (partition by video_id, label order by frame_idx desc) as rn from (
            select distinct video_id, label, frame_idx from cand join part using (video_id, k))) where rn <= 4
    group by video_id, label""", **WHOLE_PARTS)
def ordered_scene(v):
    d = Sc.track_documents(whole_scene(v).steps)
    return d.select("video_id", F.array_join(F.transform("F_k", lambda s: s["t"].cast("string")), ",").alias("frames"),
                    F.size("F_k").cast("bigint").alias("n_steps"))


@query("scene_to_json", _FLAT, single=_SINGLE, tracks=_TRACKS, steps=_STEPS, obs="select * from moments")
def scene_to_json(v):
    """The track parts of the scene JSON, parsed back: nothing may be lost on the way."""
    _, meta, ego, steps = single_run_scene(v)
    parts = Sc.scene_json_parts(meta, ego, Sc.track_documents(steps))
    tracks = parts.filter("section = 6").select("video_id", F.regexp_replace("text", "^,", "").alias("j"))
    doc = ("object_id long, F_k array<struct<t:long,tau:array<struct<row:int,col:int,iou:double>>,c:array<double>,"
           "s:struct<x:struct<mu:double,sigma:double,min:double,max:double>,y:struct<mu:double,sigma:double,min:double,"
           "max:double>,z:struct<mu:double,sigma:double,min:double,max:double>>,theta:array<long>>>")
    flat = tracks.select("video_id", F.from_json("j", doc).alias("d")).select(
        "video_id", "d.object_id", F.explode("d.F_k").alias("step"))
    return flat.select("video_id", "object_id", *_flat("step"))


@query("scene_ego_json", "select video_id, frame_idx as t, 0e0 - (1e0 * tx + 0e0 + 0e0) as x from frames")
def scene_ego_json(v):
    ego = L.ego_track(v.frames)
    meta = Sc.scene_metadata(v.detections.withColumnRenamed("local_obj_id", "object_id"), v.frames)
    none = v.spark.createDataFrame([], "video_id long, object_id long, F_k array<int>")
    parts = Sc.scene_json_parts(meta, ego, none).filter("section = 4")
    d = parts.select("video_id", F.from_json(F.regexp_replace("text", "^,", ""), "t long, xyz array<double>").alias("d"))
    return d.select("video_id", "d.t", F.col("d.xyz")[0].alias("x"))


@query("render_scene_text")
def render_scene_text(v):
    _, meta, ego, steps = single_run_scene(v)
    return Sc.scene_text_parts(meta, ego, steps)


@query("render_scene_summary")
def render_scene_summary(v):
    from sceneloom.operators.relations import spatial_edges
    obs, meta, ego, steps = single_run_scene(v)
    at = steps.select(*FRAME, "object_id", *[F.col("step.c")[i].alias(a) for i, a in enumerate("xyz")])
    return Sc.scene_summary_parts(ego, steps, spatial_edges(at, 50.0, "notebook"))


@query("keyframe_refs", """select video_id, frame_idx, 'frames/' || video_id || '/' || frame_idx || '.jpg' as path from frames
    where (frame_idx + video_id) % 4 > 0""")
def keyframe_refs(v):
    path = F.format_string("frames/%d/%d.jpg", "video_id", "frame_idx")
    refs = v.frames.select(*FRAME, path.alias("path"))
    listing = refs.filter((F.col("frame_idx") + F.col("video_id")) % 4 > 0).select("path")
    return Sc.keyframe_refs(refs, listing)


@query("token_budget", "select video_id, count(*) as observations, count(*) * 184 + 800 as text_tokens from seen group by all",
       seen=_SEEN)
def token_budget(v):
    return Q.token_budget(seen(v))


@query("object_history", "select video_id, frame_idx, det_seq from dets where local_obj_id = 7")
def object_history(v):
    from sceneloom.operators.relations import object_history as f
    return f(v.detections.withColumnRenamed("local_obj_id", "object_id"), 7).select(*DET)


@query("objects_at", "select video_id, local_obj_id, det_seq from dets where frame_idx = 5")
def objects_at(v):
    from sceneloom.operators.relations import objects_at as f
    return f(v.detections, 5).select("video_id", "local_obj_id", "det_seq")


# ---- runs of empty frames, classes, switches

_COUNTS = """select f.local_obj_id as video_id, f.frame_idx, count(d.det_seq) as n_masks, any_value(coalesce(e.n, 0)) as n_dets
    from (select distinct d.local_obj_id, f.frame_idx, f.video_id as v from dets d join frames f using (video_id)) f
    left join dets d using (local_obj_id, frame_idx)
    left join (select video_id as v, frame_idx, count(*) as n from dets where run_id = 'error' group by all) e using (v, frame_idx) group by all"""
_STREAKS = """select *, case when n_masks > 0 then 0 else frame_idx - coalesce(max(case when n_masks > 0 then frame_idx end)
    over (partition by video_id order by frame_idx), -1) end as streak from counts"""


def streaks(v):
    """Masks of every object in the frames of its video, and the video's detections of one kind."""
    from sceneloom.plans.quality_queries import by_object
    found, shown = by_object(v)
    masks = Q.masks_per_frame(found, shown)
    errors = v.detections.filter("run_id = 'error'").join(
        found.select(F.col("video_id").alias("_o"), F.expr("video_id div 15").alias("video_id")).distinct(), "video_id")
    dets = Q.masks_per_frame(errors.withColumn("video_id", F.col("_o")), shown, "n_dets")
    return T.empty_streaks(T.frame_ordinals(shown).join(masks, FRAME).join(dets, FRAME))


@query("empty_streaks", """select video_id, frame_idx, streak, (streak >= 1)::int + (streak >= 5)::int + (streak >= 10)::int
    + (streak >= 20)::int + (streak >= 50)::int as alert from streaks""", counts=_COUNTS, streaks=_STREAKS)
def empty_streaks(v):
    return streaks(v).select(*FRAME, "streak", "alert")


@query("reanchor_dense", "select video_id, frame_idx, streak from streaks where streak > 0 and streak % 3 = 0",
       counts=_COUNTS, streaks=_STREAKS)
def reanchor_dense(v):
    return T.reanchors(streaks(v).withColumn("n_dets", F.lit(1)), 3).select(*FRAME, "streak")


# the next prompt after each place of an empty run, then the walk over them from the run's start
_PROMPTS = {
    "shown": "select video_id, frame_idx - streak as run, streak, frame_idx from streaks where streak > 0 and n_dets > 0",
    "places": "select video_id, run, streak from shown union select video_id, run, 0 from shown",
    "leaps": "select p.video_id, p.run, p.streak, min(s.streak) as reached from places p join shown s on s.video_id = p.video_id and s.run = p.run and s.streak >= p.streak + 3 group by all",
    "walked": "select distinct video_id, run, 0 as streak from shown union all select w.video_id, w.run, l.reached from walked w join leaps l on l.video_id = w.video_id and l.run = w.run and l.streak = w.streak",
}


@query("reanchor_sparse", "select s.video_id, s.frame_idx, s.streak from shown s join walked w using (video_id, run, streak)",
       counts=_COUNTS, streaks=_STREAKS, **_PROMPTS)
def reanchor_sparse(v):
    return T.reanchors(streaks(v), 3).select(*FRAME, "streak")


_CLASSES = """select video_id, run_id as class_name, min(frame_idx) as frame_idx from dets group by all"""


@query("cumulative_classes", """select f.video_id, f.frame_idx, coalesce(string_agg(c.class_name, ',' order by c.class_name), '') as classes
    from frames f left join firsts c on c.video_id = f.video_id and c.frame_idx <= f.frame_idx group by all""", firsts=_CLASSES)
def cumulative_classes(v):
    d = T.cumulative_classes(pixel_boxes(v), v.frames)
    return d.select(*FRAME, F.array_join("classes", ",").alias("classes"))


@query("id_switches", """select video_id, truth, sum((p_id is not null and p_id <> object_id)::int)::bigint as switches,
        sum((p_frame is not null and frame_idx - p_frame > 1)::int)::bigint as fragments,
        sum((p_id is not null and p_id <> object_id)::int) * 1e3 / 120 as switches_per_1k,
        sum((p_frame is not null and frame_idx - p_frame > 1)::int) * 1e3 / 120 as fragments_per_1k from (
    select *, lag(object_id) over w as p_id, lag(frame_idx) over w as p_frame from (
        select video_id, local_obj_id as truth, frame_idx, arg_max(length(run_id), det_seq) as object_id from dets group by all)
    window w as (partition by video_id, truth order by frame_idx)) group by all""")
def id_switches(v):
    a = v.detections.groupBy("video_id", F.col("local_obj_id").alias("truth"), "frame_idx").agg(
        F.max_by(F.length("run_id"), "det_seq").cast("bigint").alias("object_id"))
    return T.id_switches(a, v.frames)
