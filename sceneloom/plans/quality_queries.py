"""Queries over counts per frame, depth spread and timings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sceneloom.operators import quality as Q
from sceneloom.plans.registry import query
from sceneloom.schema import FRAME

# every tracked object for itself: its sightings in all frames of its video
_PER = """select f.local_obj_id as video_id, f.frame_idx, count(d.det_seq) as n
    from (select distinct d.local_obj_id, f.frame_idx from dets d join frames f using (video_id)) f
    left join dets d using (local_obj_id, frame_idx) group by all"""


def by_object(v):
    """Detections and frames with each object in the place of a video."""
    own = v.detections.select("local_obj_id", "video_id").distinct()
    frames = v.frames.join(own, "video_id").select(F.col("local_obj_id").alias("video_id"), "frame_idx")
    return v.detections.withColumn("video_id", F.col("local_obj_id")), frames


@query("detection_stats", """select video_id, count(*) as frames, count_if(n > 0)::bigint as frames_with, sum(n)::bigint as total,
    max(n) as most, sum(n) / count(*) as mean from per group by all""", per=_PER)
def detection_stats(v):
    return Q.detection_stats(*by_object(v))


@query("empty_rate", "select video_id, count_if(n = 0) / count(*) as empty_rate from per group by all", per=_PER)
def empty_rate(v):
    return Q.empty_rate(*by_object(v))


@query("latency_stats", """select event_type, count(*) as n, quantile_cont(value, 5e-1) as median_ms,
    quantile_cont(value, 95e-2) as p95_ms, min(value) as min_ms, max(value) as max_ms,
    sum((value * 100)::bigint)::bigint // count(*) as mean_hundredths from events group by all""")
def latency_stats(v):
    e = v.table("events")
    s = Q.latency_stats(e, ["event_type"], "value").drop("mean_ms", "per_second")
    whole = e.groupBy("event_type").agg(F.expr("sum(cast(round(value * 100) as bigint)) div count(1)").alias("mean_hundredths"))
    return s.join(whole, "event_type")


_D = "(5e0 + v / 64e0 * 5e-1)"
_GRID = "frames, (select unnest(range(64)) as v), (select unnest(range(64)) as u)"


def _profile(v):
    return Q.depth_profile(v.depth_rows, 64, 64)


# depth steps are multiples of 1/128, so sums of doubles are exact in any order
@query("depth_profile_overall", f"""select video_id, frame_idx, min({_D}) as min, max({_D}) as max,
    count(distinct {_D}) as n_values from {_GRID} group by all""")
def depth_profile_overall(v):
    return _profile(v)["overall"].drop("std")


@query("depth_profile_quadrants", f"""select video_id, frame_idx, case when grouping(vert) = 1 then 'all' else vert end as vertical,
    case when grouping(hor) = 1 then 'all' else hor end as horizontal, avg({_D}) as mean from (
        select *, case when v < 32 then 'top' else 'bottom' end as vert, case when u < 32 then 'left' else 'right' end as hor from {_GRID})
    group by grouping sets ((video_id, frame_idx, vert, hor), (video_id, frame_idx, vert), (video_id, frame_idx, hor), (video_id, frame_idx))""")
def depth_profile_quadrants(v):
    return _profile(v)["quadrants"]


@query("depth_profile_bands", f"""select video_id, frame_idx, case when v < 16 then 'top' when v < 48 then 'middle' else 'bottom' end as band,
    avg({_D}) as mean from {_GRID} group by all""")
def depth_profile_bands(v):
    return _profile(v)["bands"]


@query("depth_profile_rows", f"select video_id, frame_idx, v, avg({_D}) as mean from {_GRID} group by all")
def depth_profile_rows(v):
    return _profile(v)["rows"].drop("std")


@query("depth_profile_columns", f"select video_id, frame_idx, u, avg({_D}) as mean from {_GRID} group by all")
def depth_profile_columns(v):
    return _profile(v)["columns"]
