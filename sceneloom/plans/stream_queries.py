"""Streaming operators run over tables, and streams run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sceneloom.plans.registry import query
from sceneloom.plans.track_queries import (
    _SEEN, _SEGS, _SINGLE, _WHOLE, ARCHIVE, FOREVER, LOST, WHOLE_PARTS, fusion_inputs, seen, whole_objects)
from sceneloom.schema import FRAME
from sceneloom.session import ensure_checkpoint_dir
from sceneloom.sources.readers import stream_observations
from sceneloom.streaming import live, order

# the time of a frame: one second each
def _timed(df):
    return df.withColumn("event_ts", F.timestamp_seconds(F.lit(1704067200) + F.col("frame_idx")))


@query("session_tracks", """select video_id, local_obj_id, min(frame_idx) as t_start, max(frame_idx) as t_end, count(*) as n_obs
    from segs group by video_id, local_obj_id, segment""", seen=_SEEN, segs=_SEGS)
def session_tracks(v):
    """A gap of six frame times, at one frame per second, ends a life."""
    return live.session_tracks(_timed(seen(v)), LOST, ARCHIVE, fps=1.0)


@query("rolling_scene", """select video_id, 1704067200 + w.start as window_start, count(distinct frame_idx) as frames,
        count(*) as observations, min(frame_idx) as first_frame, max(frame_idx) as last_frame
    from dets d join (select unnest(range(-10, 125, 5)) as start) w on frame_idx >= w.start and frame_idx < w.start + 10 group by all""")
def rolling_scene(v):
    d = live.rolling_scene(_timed(v.detections), "10 seconds", "5 seconds")
    return d.withColumn("window_start", F.unix_seconds("window_start"))


def _streamed(v, cands, gated, lost=LOST, archive=ARCHIVE, gap=2):
    """Frames written in three parts of forty frames each, then streamed in that order."""
    base = f"{ensure_checkpoint_dir(v.spark)}/stream-{uuid.uuid4().hex}"
    rows = v.settle(live.frame_rows(cands, gated, v.frames))
    for part in range(3):
        # one file holds all of a video's frames of its part, so they arrive in order
        (rows.filter(F.expr(f"frame_idx div 40 = {part}")).repartition("video_id")
         .write.mode("append").parquet(f"{base}/in"))
    stream = stream_observations(v.spark, f"{base}/in", rows.schema, files_per_trigger=8)
    live.run_to_end(live.stream_scene(stream, lost, archive, gap), f"{base}/out", f"{base}/state")
    out = v.spark.read.parquet(f"{base}/out")
    return live.relabel(out.filter("kind = 'obs'"), out.filter("kind = 'alias'"))


@query("stream_scene")
def stream_scene(v):
    """The fused tracks, built while frames arrive; equals fuse_tracks."""
    _, cands, gated = fusion_inputs(v)
    return _streamed(v, cands, gated)


@query("stream_scene_no_archive", _WHOLE, **WHOLE_PARTS)
def stream_scene_no_archive(v):
    _, cands, gated = fusion_inputs(v)
    return whole_objects(_streamed(v, cands, gated, FOREVER, FOREVER, FOREVER))


@query("stream_scene_single_run", """select video_id, frame_idx, det_seq, object_id from (
    select *, dense_rank() over (partition by video_id order by born_frame, born) - 1 as object_id from single)
    where rn = 1""", single=_SINGLE)
def stream_scene_single_run(v):
    none = v.spark.createDataFrame([], "video_id long, frame_idx long, det_seq_a long, det_seq_b long")
    return _streamed(v, v.detections.filter("run_id = 'click'"), none)


@query("clean_arrivals", "select distinct video_id, frame_idx from dets")
def clean_arrivals(v):
    """Detections as arrivals of their frame: every frame passes once."""
    base = f"{ensure_checkpoint_dir(v.spark)}/arrivals-{uuid.uuid4().hex}"
    d = _timed(v.detections.select("video_id", "frame_idx"))
    d.repartitionByRange(4, "frame_idx").sortWithinPartitions("frame_idx").write.parquet(f"{base}/in")
    stream = stream_observations(v.spark, f"{base}/in", d.schema, files_per_trigger=2)
    live.run_to_end(live.clean_arrivals(stream, "2 hours"), f"{base}/out", f"{base}/state")
    return v.spark.read.parquet(f"{base}/out").select("video_id", "frame_idx")


@query("reorder_frames", "select video_id, frame_idx, row_number() over (partition by video_id order by frame_idx) as place from (select distinct video_id, frame_idx from dets)")
def reorder_frames(v):
    """Frames that arrive shuffled over the whole stream's length, put in order by a buffer that waits that long."""
    base = f"{ensure_checkpoint_dir(v.spark)}/shuffled-{uuid.uuid4().hex}"
    d = _timed(v.detections.select("video_id", "frame_idx").distinct())
    close = d.select("video_id").distinct().select("video_id", F.lit(10 ** 6).cast("bigint").alias("frame_idx"))
    # by hash: neighbours in time arrive in different files
    for part in range(3):
        d.filter(F.pmod(F.xxhash64("video_id", "frame_idx"), F.lit(3)) == part).repartition(2).write.mode("append").parquet(f"{base}/in")
    _timed(close).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = stream_observations(v.spark, f"{base}/in", d.schema, files_per_trigger=2)
    live.run_to_end(order.in_order(stream, "5 minutes", "1 minute").withColumn("let_go", F.col("seq")), f"{base}/out", f"{base}/state")
    out = v.spark.read.parquet(f"{base}/out").filter("not late and frame_idx < 1000000")
    # all frames of a video are let go together, so seq is their order
    return out.select("video_id", "frame_idx", (F.col("let_go") + 1).alias("place"))


@query("stream_lives", """select video_id, local_obj_id as object_id, min(frame_idx) as t_start, max(frame_idx) as t_end, count(*) as n_obs
    from segs group by video_id, local_obj_id, segment""", seen=_SEEN, segs=_SEGS)
def stream_lives(v):
    """Lives counted in processed frames, as the frames arrive."""
    base = f"{ensure_checkpoint_dir(v.spark)}/lives-{uuid.uuid4().hex}"
    shown = seen(v).groupBy(*FRAME).agg(F.collect_set("local_obj_id").alias("objects"))
    rows = v.settle(v.frames.select(*FRAME).join(shown, FRAME, "left"))
    for part in range(3):
        rows.filter(F.expr(f"frame_idx div 40 = {part}")).repartition("video_id").write.mode("append").parquet(f"{base}/in")
    stream = stream_observations(v.spark, f"{base}/in", rows.schema, files_per_trigger=8)
    live.run_to_end(order.stream_lives(stream, LOST + ARCHIVE), f"{base}/out", f"{base}/state")
    return order.latest_lives(v.spark.read.parquet(f"{base}/out")).drop("segment")


@query("rolling_graph", """select f.video_id, f.frame_idx, count(distinct n.local_obj_id) as nodes, coalesce(any_value(e.edges), 0) as edges
    from frames f left join seen n on n.video_id = f.video_id and n.frame_idx > f.frame_idx - 10 and n.frame_idx <= f.frame_idx
    left join (select f.video_id, f.frame_idx, count(distinct (a.local_obj_id, b.local_obj_id)) as edges from frames f
        join seen a on a.video_id = f.video_id and a.frame_idx > f.frame_idx - 10 and a.frame_idx <= f.frame_idx
        join seen b on b.video_id = a.video_id and b.frame_idx = a.frame_idx and a.local_obj_id < b.local_obj_id group by all) e
        on e.video_id = f.video_id and e.frame_idx = f.frame_idx group by f.video_id, f.frame_idx""", seen=_SEEN)
def rolling_graph(v):
    """The graph of the last ten frames after each frame: objects seen, and pairs seen together."""
    base = f"{ensure_checkpoint_dir(v.spark)}/graph-{uuid.uuid4().hex}"
    ids = F.array_sort(F.collect_set("local_obj_id"))
    shown = seen(v).groupBy(*FRAME).agg(ids.alias("nodes"))
    pairs = F.flatten(F.transform("nodes", lambda a: F.transform(F.filter("nodes", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    rows = v.settle(v.frames.select(*FRAME).join(shown.withColumn("edges", pairs), FRAME, "left"))
    for part in range(3):
        rows.filter(F.expr(f"frame_idx div 40 = {part}")).repartition("video_id").write.mode("append").parquet(f"{base}/in")
    stream = stream_observations(v.spark, f"{base}/in", rows.schema, files_per_trigger=8)
    live.run_to_end(order.rolling_graph(stream, 10), f"{base}/out", f"{base}/state")
    return order.graph_at(v.spark.read.parquet(f"{base}/out"), v.frames)
