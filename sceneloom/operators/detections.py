"""Choosing and describing detections, boxes and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.functions.ordered import global_row_number
from sceneloom.operators.masks import mask_iou_cross, mask_stats
from sceneloom.schema import DET, FRAME


def filter_score(det: DataFrame, threshold: float = 0.3, score: str = "score") -> DataFrame:
    """Keep scores from the threshold up; a missing score counts as 0."""
    return det.filter(F.coalesce(F.col(score), F.lit(0.0)) >= threshold)


def filter_owned(det: DataFrame, runs: DataFrame) -> DataFrame:
    """Keep detections whose tracker run is still active; unowned ones go."""
    active = runs.filter(F.col("status") == "active").select("video_id", "run_id")
    return det.join(active, ["video_id", "run_id"], "left_semi")


def best_per_object(det: DataFrame) -> DataFrame:
    """One detection per frame, run and object: best score, the first one on ties."""
    w = Window.partitionBy(*FRAME, "run_id", "local_obj_id").orderBy(F.desc("score"), "det_seq")
    return det.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_by_area(spans: DataFrame, k: int = 0) -> DataFrame:
    """Detections by area within their frame, empty masks dropped; all of them for k <= 0."""
    area = mask_stats(spans).filter("area > 0").select(*DET, "area")
    if k <= 0:
        return area
    w = Window.partitionBy(*FRAME).orderBy(F.desc("area"), "det_seq")
    return area.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def lowest_masks(spans: DataFrame, keep: int) -> DataFrame:
    """The masks lying lowest in each frame, by mean row."""
    stats = mask_stats(spans).filter("area > 0")
    w = Window.partitionBy(*FRAME).orderBy(F.desc("row_mean"), "det_seq")
    return stats.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= keep).drop("_rn")


def clamp_boxes(boxes: DataFrame, width: float, height: float) -> DataFrame:
    """Pixel corners to the unit square; xywh added; empty and inverted boxes dropped."""
    unit = lambda c, size: F.least(F.greatest(F.col(c) / F.lit(float(size)), F.lit(0.0)), F.lit(1.0))
    b = (boxes.withColumn("nx1", unit("x1", width)).withColumn("ny1", unit("y1", height))
              .withColumn("nx2", unit("x2", width)).withColumn("ny2", unit("y2", height)))
    b = b.withColumn("bw", F.col("nx2") - F.col("nx1")).withColumn("bh", F.col("ny2") - F.col("ny1"))
    return b.filter((F.col("bw") > 0) & (F.col("bh") > 0))


def ordered_boxes(boxes: DataFrame) -> DataFrame:
    """Rank of each box in its frame, best score first."""
    d = boxes.withColumn("_p", -F.col("score"))
    # stretches of a 256th of the score, so that a crowded frame is ranked in parallel
    return global_row_number(d, FRAME, "_p", ["det_seq"], name="rank", bucket=2 ** -8).drop("_p")


def top_k_boxes(boxes: DataFrame, k: int) -> DataFrame:
    """The k best boxes of each frame; the rank limit is applied before the shuffle."""
    w = Window.partitionBy(*FRAME).orderBy(F.desc("score"), "det_seq")
    return boxes.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def parse_classes(names: str | None) -> list[str]:
    """A comma list to lower-case names, blanks dropped, first mention kept."""
    seen = dict.fromkeys(n.strip().lower() for n in (names or "").split(","))
    return [n for n in seen if n]


def filter_classes(boxes: DataFrame, names: str | None, column: str = "class_name") -> DataFrame:
    wanted = parse_classes(names)
    return boxes.filter(F.lower(column).isin(wanted)) if wanted else boxes


def split_tags(tags: Column, lower: bool = True, distinct: bool = True) -> Column:
    """A bar-separated tag line as an array."""
    parts = F.filter(F.transform(F.split(tags, r"\|"), lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")),
                     lambda t: t != "")
    if lower:
        parts = F.transform(parts, F.lower)
    return F.array_distinct(parts) if distinct else parts


def discover_new(proposals: DataFrame, tracked: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Proposals after frame 0 that no tracked mask covers, with their prompt point.

    New iff no tracked mask of the frame reaches the IoU threshold.
    """
    later = proposals.filter("frame_idx > 0")
    taken = (mask_iou_cross(later, tracked).filter(F.col("iou") >= threshold)
             .select(*FRAME, F.col("det_seq_a").alias("det_seq")).distinct())
    point = mask_stats(later).filter("area > 0").select(
        *DET, "area", F.col("col_mean").alias("px"), F.col("row_mean").alias("py"))
    return point.join(taken, DET, "left_anti")


def assign_new_ids(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Continue each video's numbering over discoveries, by frame and falling area."""
    top = existing.groupBy("video_id").agg(F.max("local_obj_id").alias("_top"))
    ranked = global_row_number(new, ["video_id"], "frame_idx", [F.desc("area"), F.col("det_seq")], name="_rn")
    return (ranked.join(top, "video_id", "left")
            .withColumn("new_id", F.coalesce("_top", F.lit(-1)) + F.col("_rn")).drop("_top", "_rn"))


def merge_propagated(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Frames with a fresh result lose their cached rows to it."""
    done = fresh.select(*FRAME).distinct()
    return cache.join(done, FRAME, "left_anti").unionByName(fresh)


def add_missing(base: DataFrame, extra: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Append the rows of ``extra`` whose object the base does not show in that frame.

    Of several extra rows for one object the first is taken.
    """
    keys = keys or [*FRAME, "run_id", "local_obj_id"]
    absent = extra.join(base.select(*keys), keys, "left_anti")
    w = Window.partitionBy(*keys).orderBy("det_seq")
    first = absent.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return base.unionByName(first)


def flatten_detections(results: DataFrame) -> DataFrame:
    """One row per detection out of one nested row per video."""
    return results.select("video_id", F.explode("detections").alias("d")).select("video_id", "d.*")
