"""Lives of objects over the processed frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.functions.ordered import gap_segments, global_row_number, running_sum, with_previous
from sceneloom.schema import FRAME

# Default patience in processed frames, and the default window.
LOST = 5
ARCHIVE = 30
WINDOW = 10


def frame_ordinals(frames: DataFrame, bucket: int = 4096) -> DataFrame:
    """Position of each frame among the processed frames of its video, from 0."""
    d = global_row_number(frames.select(*FRAME), ["video_id"], "frame_idx", name="_rn", bucket=bucket)
    return d.select(*FRAME, (F.col("_rn") - 1).alias("ord"))


def track_segments(obs: DataFrame, frames: DataFrame, lost: int = LOST, archive: int = ARCHIVE,
                   keys: list[str] | None = None, bucket: int = 4096) -> DataFrame:
    """Adds ``ord`` and ``segment``: a new life after lost+archive missed frames, one at least.

    Frames are counted as processed, not by their index, which may be strided.
    """
    keys = keys or ["video_id", "local_obj_id"]
    d = obs.join(frame_ordinals(frames, bucket), FRAME)
    return gap_segments(d, keys, "ord", max(lost + archive, 1), name="segment", bucket=bucket)


def track_status(segments: DataFrame, frames: DataFrame, lost: int = LOST, archive: int = ARCHIVE,
                 keys: list[str] | None = None) -> DataFrame:
    """Status of each life after the last processed frame of its video."""
    keys = keys or ["video_id", "local_obj_id"]
    n = frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n"))
    last = segments.groupBy(*keys, "segment").agg(
        F.min("frame_idx").alias("t_start"), F.max("frame_idx").alias("t_end"), F.max("ord").alias("_last"))
    missed = F.col("_n") - 1 - F.col("_last")
    return (last.join(n, "video_id")
            .withColumn("missing_streak", missed)
            .withColumn("status", F.when(missed >= max(lost + archive, 1), "archived")
                        .when(missed >= max(lost, 1), "lost").otherwise("active"))
            .drop("_n", "_last"))


def track_summary(obs: DataFrame, keys: list[str] = ("video_id", "object_id")) -> DataFrame:
    """First frame, last frame and length of every track."""
    return obs.groupBy(*keys).agg(F.min("frame_idx").alias("t_start"), F.max("frame_idx").alias("t_end"),
                                  F.count(F.lit(1)).alias("n_obs"))


def track_window(obs: DataFrame, last: int = WINDOW, keys: list[str] = ("video_id", "object_id")) -> DataFrame:
    """The last observations of each track, each with the span of the whole track.

    The span is an aggregate with map-side partials; the rank prunes every track
    to its tail before the shuffle. Neither sees a whole track in one task.
    """
    span = track_summary(obs, keys).drop("n_obs")
    if last > 0:
        tail = Window.partitionBy(*keys).orderBy(F.desc("frame_idx"))
        obs = obs.withColumn("_rn", F.row_number().over(tail)).filter(F.col("_rn") <= last).drop("_rn")
    return obs.join(span, list(keys))


def merge_observations(keep: DataFrame, drop: DataFrame, keys: list[str] = ("video_id", "object_id", "frame_idx")
                       ) -> DataFrame:
    """Union of two observation sets, one row per frame; the first set wins."""
    rest = drop.join(keep.select(*keys), list(keys), "left_anti")
    return keep.unionByName(rest)


def filter_motion_outliers(obs: DataFrame, speed: float = 30.0, keys: list[str] = ("video_id", "object_id"),
                           bucket: int = 4096) -> DataFrame:
    """Steps of a track faster than ``speed`` per frame."""
    d = obs.withColumn("_cur", F.struct(F.col("frame_idx").alias("f"), "x", "y", "z"))
    d = with_previous(d, list(keys), "frame_idx", "_cur", "_p", bucket=bucket)
    dx, dy, dz = (F.col(a) - F.col("_p")[a] for a in "xyz")
    dt = F.col("frame_idx") - F.col("_p")["f"]
    d = d.withColumn("from_frame", F.col("_p")["f"]).withColumn(
        "step_speed", F.sqrt(dx * dx + dy * dy + dz * dz) / dt)
    return d.filter(F.col("step_speed") > speed).select(*keys, "from_frame", "frame_idx", "step_speed")


def motion_label(obs: DataFrame, window: int = 3, motion: float = 3.0, lateral: float = 3.0,
                 keys: list[str] = ("video_id", "object_id"), bucket: int = 4096) -> DataFrame:
    """Motion of each object relative to the camera at each of its observations.

    Needs ``dist`` (distance) and ``side`` (leftward offset). Rates are per frame
    between this observation and the one window-1 before it.
    """
    d = global_row_number(obs, list(keys), "frame_idx", name="_rn", bucket=bucket)
    back = d.select(*keys, (F.col("_rn") + window - 1).alias("_rn"), F.col("frame_idx").alias("_f"),
                    F.col("dist").alias("_d"), F.col("side").alias("_s"))
    d = d.join(back, [*keys, "_rn"], "left")
    dt = F.col("frame_idx") - F.col("_f")
    rate = (F.col("dist") - F.col("_d")) / dt
    slip = (F.col("side") - F.col("_s")) / dt
    label = (F.when(F.col("_f").isNull(), "unknown")
             .when(F.lit(window <= 1), "static")
             .when(rate > motion, "receding").when(rate < -motion, "approaching")
             .when(slip > lateral, "moving-left").when(slip < -lateral, "moving-right").otherwise("static"))
    return d.withColumn("motion", label).drop("_rn", "_f", "_d", "_s")


def empty_streaks(frames: DataFrame, bucket: int = 4096) -> DataFrame:
    """Length so far of the current run of frames without masks, and its alert level.

    Needs ``n_masks`` and ``ord``. The run counts from the last non-empty frame.
    """
    d = running_sum(frames, ["video_id"], "ord", (F.col("n_masks") > 0).cast("int"), "_g", bucket=bucket)
    start = d.filter("n_masks > 0").select("video_id", "_g", F.col("ord").alias("_at"))
    d = d.join(start, ["video_id", "_g"], "left")
    streak = F.when(F.col("n_masks") > 0, 0).otherwise(F.col("ord") - F.coalesce("_at", F.lit(-1)))
    # Streak lengths at which the alert is raised one level.
    levels = [1, 5, 10, 20, 50]
    d = d.withColumn("streak", streak.cast("bigint"))
    level = F.aggregate(F.array(*[F.lit(x) for x in levels]), F.lit(0),
                        lambda acc, x: acc + (F.col("streak") >= x).cast("int"))
    return d.withColumn("alert", level).drop("_g", "_at")


def reanchors(streaks: DataFrame, threshold: int, bucket: int = 4096) -> DataFrame:
    """Frames where tracking is prompted again out of an empty run.

    The run restarts after each prompt, and a prompt needs a detection in the
    frame. So the next prompt is the first frame with detections at least
    ``threshold`` after the last one: on frames that all have detections that is
    every ``threshold``-th frame, otherwise a short walk over the run.
    """
    if threshold <= 0:
        return streaks.limit(0)
    full = streaks.withColumn("_run", F.col("ord") - F.col("streak")).filter("streak > 0")
    dets = full.filter("n_dets > 0")
    holes = full.filter("n_dets = 0").select("video_id", "_run").distinct()
    plain = (dets.join(holes, ["video_id", "_run"], "left_anti")
             .filter(F.col("streak") % threshold == 0))
    walk = (dets.join(holes, ["video_id", "_run"], "left_semi").select("video_id", "_run", "streak")
            .repartition("video_id", "_run").sortWithinPartitions("video_id", "_run", "streak"))
    hits = walk.mapInPandas(_prompts(threshold), "video_id long, _run long, streak long")
    again = dets.join(hits, ["video_id", "_run", "streak"], "left_semi")
    return plain.unionByName(again.select(plain.columns)).drop("_run")


def _prompts(threshold: int):
    """First row at least ``threshold`` after the last pick, run by run, in a sorted stream."""

    def step(batches):
        run, last = None, 0
        for pdf in batches:
            hit = []
            for v, r, s in pdf.itertuples(index=False, name=None):
                if (v, r) != run:
                    run, last = (v, r), 0
                if s - last >= threshold:
                    last = s
                    hit.append(True)
                else:
                    hit.append(False)
            yield pdf[hit]

    return step


def cumulative_classes(boxes: DataFrame, frames: DataFrame, bucket: int = 4096) -> DataFrame:
    """Classes seen up to and including each frame: their number and sorted list.

    A class counts from its first frame on, so only (video, class) first sights
    are accumulated; the class vocabulary bounds the list.
    """
    first = boxes.groupBy("video_id", "class_name").agg(F.min("frame_idx").alias("frame_idx"))
    marks = first.groupBy("video_id", "frame_idx").agg(F.collect_list("class_name").alias("_c"))
    w = Window.partitionBy("video_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    grown = marks.select("video_id", "frame_idx", F.array_sort(F.flatten(F.collect_list("_c").over(w))).alias("classes"))
    nxt = Window.partitionBy("video_id").orderBy("frame_idx")
    spans = grown.withColumn("_to", F.lead("frame_idx").over(nxt)).withColumnRenamed("frame_idx", "_from")
    # one row per first sight and video: at most one per class
    f = frames.select(*FRAME)
    at = f.join(spans, (f["video_id"] == spans["video_id"]) & (f["frame_idx"] >= spans["_from"])
                & (F.col("_to").isNull() | (f["frame_idx"] < F.col("_to"))), "left")
    none = F.array().cast("array<string>")
    return at.select(f["video_id"], f["frame_idx"], F.coalesce("classes", none).alias("classes"))


def id_switches(assigned: DataFrame, frames: DataFrame, bucket: int = 4096) -> DataFrame:
    """Identity changes and fragmentation of each true object, per thousand frames.

    ``assigned`` has video_id, frame_idx, truth, object_id: one row per frame and
    true object. A fragment ends where frames are missing in between.
    """
    d = assigned.join(frame_ordinals(frames, bucket), FRAME)
    d = d.withColumn("_cur", F.struct("object_id", "ord"))
    d = with_previous(d, ["video_id", "truth"], "ord", "_cur", "_p", bucket=bucket)
    switched = (F.col("_p").isNotNull() & (F.col("_p")["object_id"] != F.col("object_id"))).cast("bigint")
    broken = (F.col("_p").isNotNull() & (F.col("ord") - F.col("_p")["ord"] > 1)).cast("bigint")
    n = frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n"))
    per = d.groupBy("video_id", "truth").agg(F.sum(switched).alias("switches"), F.sum(broken).alias("fragments"))
    return per.join(n, "video_id").select(
        "video_id", "truth", "switches", "fragments",
        (F.col("switches") * 1000.0 / F.col("_n")).alias("switches_per_1k"),
        (F.col("fragments") * 1000.0 / F.col("_n")).alias("fragments_per_1k"))
