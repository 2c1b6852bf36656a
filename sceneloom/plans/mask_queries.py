"""Queries over masks, detections, boxes and tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from sceneloom.operators import detections as D
from sceneloom.operators import lift as L
from sceneloom.operators import masks as M
from sceneloom.plans.registry import query
from sceneloom.schema import DET, FRAME


def tau_text(tau):
    """Tokens as text; sixteenths are whole numbers for 4x4 cells."""
    return F.array_join(F.transform(tau, lambda p: F.concat_ws(
        ":", p["row"].cast("string"), p["col"].cast("string"), F.round(p["iou"] * 16).cast("int").cast("string"))), " ")


TAU = "string_agg(row || ':' || col || ':' || cast(round(iou * 16) as int), ' ' order by row, col)"


@query("object_moments", "select * exclude (is_metric) from moments")
def object_moments(v):
    return L.object_moments(v.spans, v.depth_rows, v.frames, exact=True).drop("is_metric")


@query("object_state", f"""select o.* exclude (is_metric), coalesce(c.tau, '') as tau from obs o left join (
    select video_id, frame_idx, det_seq, {TAU} as tau from cells group by all) c using (video_id, frame_idx, det_seq)""")
def object_state(v):
    o = L.object_state(v.spans, v.depth_rows, v.frames, min_points=30, exact=True)
    return o.withColumn("tau", tau_text("tau")).drop("is_metric")


@query("mask_to_spans", "select video_id, frame_idx, det_seq, v, u0, u1 from spans")
def mask_to_spans(v):
    bits = v.spans.select(*DET, "v", F.transform(
        F.sequence(F.lit(0), F.col("w") - 1), lambda u: (u >= F.col("u0")) & (u < F.col("u1"))).alias("bits"))
    return M.mask_to_spans(bits).select(*DET, "v", "u0", "u1")


@query("pixels_to_spans", """select video_id, frame_idx, det_seq, v, min(u) as u0, max(u) + 1 as u1 from (
    select *, u - row_number() over (partition by det_seq, v order by u) as island
    from pixels where (u + v) % 5 > 0) group by video_id, frame_idx, det_seq, v, island""")
def pixels_to_spans(v):
    holed = M.spans_to_pixels(v.spans).filter((F.col("u") + F.col("v")) % 5 > 0)
    return M.pixels_to_spans(holed)


@query("spans_to_pixels", """select video_id, frame_idx, det_seq, count(*) as n, sum(u * 1000 + v)::bigint as code
    from pixels group by all""")
def spans_to_pixels(v):
    return M.spans_to_pixels(v.spans).groupBy(*DET).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("u") * 1000 + F.col("v")).alias("code"))


@query("mask_stats", """select video_id, frame_idx, det_seq, area, sv / area as row_mean, su2 / (area * 2) as col_mean
    from area""")
def mask_stats(v):
    return M.mask_stats(v.spans)


@query("mask_bbox", """select video_id, frame_idx, det_seq, x0 / 64e0 as x, y0 / 64e0 as y, bw / 64e0 as bw,
    bh / 64e0 as bh from dets""")
def mask_bbox(v):
    return M.mask_bbox(v.spans)


@query("mask_iou_pairs", "select video_id, frame_idx, a, b, inter, iou from iou_pairs")
def mask_iou_pairs(v):
    p = M.mask_iou_pairs(v.spans_of(v.best_boxes, "run_id"), differ="run_id")
    return p.select(*FRAME, F.col("det_seq_a").alias("a"), F.col("det_seq_b").alias("b"), "inter", "iou")


@query("patch_tokens", "select * from cells")
def patch_tokens(v):
    return M.patch_cells(v.spans).withColumn("row", F.col("row").cast("bigint")).withColumn(
        "col", F.col("col").cast("bigint"))


_CELLS7 = """select video_id, frame_idx, det_seq, least(v // 9, 6) as row, least(u // 9, 6) as col,
    count(*) / ((case when v // 9 >= 6 then 10e0 else 9e0 end) * (case when u // 9 >= 6 then 10e0 else 9e0 end)) as iou
    from pixels group by video_id, frame_idx, det_seq, least(v // 9, 6), least(u // 9, 6),
    case when v // 9 >= 6 then 10e0 else 9e0 end, case when u // 9 >= 6 then 10e0 else 9e0 end"""


@query("patch_tokens_remainder", "select * from cells7 where iou > 25e-2", cells7=_CELLS7)
def patch_tokens_remainder(v):
    c = M.patch_cells(v.spans, grid=7, threshold=0.25)
    return c.withColumn("row", F.col("row").cast("bigint")).withColumn("col", F.col("col").cast("bigint"))


@query("top_tau", """select video_id, frame_idx, det_seq, string_agg(row || ':' || col, ' '
        order by case when n > 3 then -iou else 0 end, row, col) as tau from (select *, row_number() over (partition by det_seq order by iou desc, row, col) as rn,
        count(*) over (partition by det_seq) as n from cells7 where iou > 25e-2)
    where n <= 3 or rn <= 3 group by all""", cells7=_CELLS7)
def top_tau(v):
    t = M.patch_tokens(v.spans, grid=7, threshold=0.25)
    best = M.top_tau(F.col("tau"), 3)
    return t.select(*DET, F.array_join(F.transform(best, lambda p: F.concat_ws(
        ":", p["row"].cast("string"), p["col"].cast("string"))), " ").alias("tau"))


@query("patch_jaccard", """select a.video_id, a.frame_idx, a.a, a.b, coalesce(n.inter / (ca.n + cb.n - n.inter), 0e0) as jaccard
    from iou_pairs a
    left join (select p.a, p.b, count(*) as inter from iou_pairs p join cells x on x.det_seq = p.a
        join cells y on y.det_seq = p.b and y.row = x.row and y.col = x.col group by all) n on n.a = a.a and n.b = a.b
    left join (select det_seq, count(*) as n from cells group by all) ca on ca.det_seq = a.a
    left join (select det_seq, count(*) as n from cells group by all) cb on cb.det_seq = a.b""")
def patch_jaccard(v):
    spans = v.spans_of(v.best_boxes, "run_id")
    tau = M.patch_tokens(spans)
    side = lambda s: tau.select(*FRAME, F.col("det_seq").alias(s), F.col("tau").alias(f"t{s}"))
    p = M.mask_iou_pairs(spans, differ="run_id").select(
        *FRAME, F.col("det_seq_a").alias("a"), F.col("det_seq_b").alias("b"))
    j = p.join(side("a"), [*FRAME, "a"], "left").join(side("b"), [*FRAME, "b"], "left")
    return j.select(*FRAME, "a", "b", M.patch_jaccard(F.col("ta"), F.col("tb")).alias("jaccard"))


@query("filter_score", "select video_id, frame_idx, det_seq, score from dets where score >= 3e-1")
def filter_score(v):
    return D.filter_score(v.detections).select(*DET, "score")


def tracker_runs(v):
    """Run table: a run is active in a video unless its name length and the video agree mod 3."""
    status = F.when((F.length("run_id") + F.col("video_id")) % 3 > 0, "active").otherwise("ended")
    return v.detections.select("video_id", "run_id").distinct().withColumn("status", status)


@query("filter_owned", """select video_id, frame_idx, det_seq, run_id from dets
    where (length(run_id) + video_id) % 3 > 0""")
def filter_owned(v):
    return D.filter_owned(v.detections, tracker_runs(v)).select(*DET, "run_id")


@query("best_per_object", "select video_id, frame_idx, det_seq, run_id, local_obj_id, score from best")
def best_per_object(v):
    return D.best_per_object(v.detections)


@query("top_by_area", """select video_id, frame_idx, det_seq, area from (select *, row_number() over (
    partition by video_id, frame_idx order by area desc, det_seq) as rn from area) where rn <= 3""")
def top_by_area(v):
    return D.top_by_area(v.spans, 3)


@query("lowest_masks", """select video_id, frame_idx, det_seq, area, row_mean, col_mean from (
    select *, row_number() over (partition by video_id, frame_idx order by row_mean desc, det_seq) as rn from (
        select video_id, frame_idx, det_seq, area, sv / area as row_mean, su2 / (area * 2) as col_mean from area))
    where rn <= 2""")
def lowest_masks(v):
    return D.lowest_masks(v.spans, 2)


_BOXES = """select video_id, frame_idx, det_seq, run_id as class_name, score, x0 - 6e0 as x1, y0 - 6e0 as y1,
    case when det_seq % 11 = 0 then x0 - 1e1 when det_seq % 5 = 0 then x0 + bw + 4e1 else x0 + bw - 6e0 end as x2,
    y0 + bh - 6e0 as y2 from dets"""
_CLAMPED = """select video_id, frame_idx, det_seq, class_name, score, nx1, ny1, nx2, ny2, nx2 - nx1 as bw, ny2 - ny1 as bh
    from (select *, least(greatest(x1 / 64e0, 0e0), 1e0) as nx1, least(greatest(y1 / 64e0, 0e0), 1e0) as ny1,
        least(greatest(x2 / 64e0, 0e0), 1e0) as nx2, least(greatest(y2 / 64e0, 0e0), 1e0) as ny2 from boxes)
    where nx2 - nx1 > 0 and ny2 - ny1 > 0"""


def pixel_boxes(v):
    """Pixel boxes; some reach past the border, some are inverted."""
    x0, y0, bw, bh, e = (F.col(c) for c in ("x0", "y0", "bw", "bh", "det_seq"))
    x2 = F.when(e % 11 == 0, x0 - 10.0).when(e % 5 == 0, x0 + bw + 40.0).otherwise(x0 + bw - 6.0)
    return v.boxes_raw.select(*DET, F.col("run_id").alias("class_name"), "score", (x0 - 6.0).alias("x1"),
                              (y0 - 6.0).alias("y1"), x2.alias("x2"), (y0 + bh - 6.0).alias("y2"))


@query("clamp_boxes", """select video_id, frame_idx, det_seq, nx1, ny1, nx2, ny2, bw, bh, row_number() over (
    partition by video_id, frame_idx order by score desc, det_seq) as rank from clamped""", boxes=_BOXES, clamped=_CLAMPED)
def clamp_boxes(v):
    b = D.ordered_boxes(D.clamp_boxes(pixel_boxes(v), 64, 64))
    return b.select(*DET, "nx1", "ny1", "nx2", "ny2", "bw", "bh", "rank")


@query("top_k_boxes", """select video_id, frame_idx, det_seq, rank from (select *, row_number() over (
    partition by video_id, frame_idx order by score desc, det_seq) as rank from clamped) where rank <= 2""",
       boxes=_BOXES, clamped=_CLAMPED)
def top_k_boxes(v):
    return D.top_k_boxes(D.clamp_boxes(pixel_boxes(v), 64, 64), 2).select(*DET, "rank")


@query("filter_classes", "select video_id, frame_idx, det_seq, class_name from boxes where class_name in ('click', 'error')",
       boxes=_BOXES)
def filter_classes(v):
    return D.filter_classes(pixel_boxes(v), " Click ,error,, click").select(*DET, "class_name")


@query("split_tags", """select det_seq, run_id || ',x ' || upper(run_id) || '!' as raw, run_id || ',x ' || lower(run_id) || '!' as tags
    from dets""")
def split_tags(v):
    raw = F.concat(F.lit("  "), F.col("run_id"), F.lit(" | x "), F.upper("run_id"), F.lit("!|| "), F.col("run_id"), F.lit("|"))
    d = v.detections.withColumn("line", raw)
    return d.select("det_seq", F.array_join(D.split_tags(F.col("line"), lower=False), ",").alias("raw"),
                    F.array_join(D.split_tags(F.col("line")), ",").alias("tags"))


_NEW = """select p.video_id, p.frame_idx, p.det_seq, p.area, p.su2 / (p.area * 2) as px, p.sv / p.area as py
    from area p join dets d using (det_seq) where d.run_id = 'signup' and p.frame_idx > 0
    and p.det_seq not in (select i.a from cross_iou i where i.iou >= 3e-1)"""
_CROSS = """select c.a, c.b, c.inter / (x.area + y.area - c.inter) as iou from (
    select l.det_seq as a, r.det_seq as b, sum(least(l.u1, r.u1) - greatest(l.u0, r.u0))::bigint as inter
    from spans l join spans r on l.video_id = r.video_id and l.frame_idx = r.frame_idx and l.v = r.v
        and l.u0 < r.u1 and r.u0 < l.u1 where l.run_id = 'signup' and r.run_id <> 'signup' group by all) c
    join area x on x.det_seq = c.a join area y on y.det_seq = c.b"""


def discoveries(v):
    spans = v.spans
    return D.discover_new(spans.filter("run_id = 'signup'"), spans.filter("run_id <> 'signup'"))


@query("discover_new", "select * from found", found=_NEW, cross_iou=_CROSS)
def discover_new(v):
    return discoveries(v)


@query("assign_new_ids", """select f.video_id, f.frame_idx, f.det_seq, t.top + row_number() over (
    partition by f.video_id order by f.frame_idx, f.area desc, f.det_seq) as new_id
    from found f join (select video_id, max(local_obj_id) as top from dets group by all) t using (video_id)""",
       found=_NEW, cross_iou=_CROSS)
def assign_new_ids(v):
    return D.assign_new_ids(discoveries(v), v.detections).select(*DET, "new_id")


@query("merge_propagated", """select video_id, frame_idx, det_seq, run_id from dets d
    where run_id <> 'click' and not exists (select 1 from dets f where f.run_id = 'click'
        and f.video_id = d.video_id and f.frame_idx = d.frame_idx)
    union all select video_id, frame_idx, det_seq, run_id from dets where run_id = 'click'""")
def merge_propagated(v):
    d = v.detections.select(*DET, "run_id")
    return D.merge_propagated(d.filter("run_id <> 'click'"), d.filter("run_id = 'click'"))


@query("add_missing", """select video_id, frame_idx, det_seq, local_obj_id from dets where det_seq % 3 = 0
    union all select video_id, frame_idx, det_seq, local_obj_id from (
        select *, row_number() over (partition by video_id, frame_idx, local_obj_id order by det_seq) as rn
        from dets t where det_seq % 3 > 0 and not exists (select 1 from dets b where b.det_seq % 3 = 0
            and b.video_id = t.video_id and b.frame_idx = t.frame_idx and b.local_obj_id = t.local_obj_id))
    where rn = 1""")
def add_missing(v):
    d = v.detections.select(*DET, "local_obj_id")
    base, extra = d.filter("det_seq % 3 = 0"), d.filter("det_seq % 3 > 0")
    return D.add_missing(base, extra, [*FRAME, "local_obj_id"])


@query("flatten_detections", """select video_id, frame_idx, class_name, score, bw, bh from clamped""",
       boxes=_BOXES, clamped=_CLAMPED)
def flatten_detections(v):
    b = D.clamp_boxes(pixel_boxes(v), 64, 64)
    nested = b.groupBy(*FRAME).agg(F.collect_list(F.struct("frame_idx", "class_name", "score", "bw", "bh")).alias("detections"))
    return D.flatten_detections(nested.select("video_id", "detections"))
