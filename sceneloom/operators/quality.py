"""Health of detections, depth and timings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneloom.functions.ordered import percentiles
from sceneloom.schema import DET, FRAME


def masks_per_frame(det: DataFrame, frames: DataFrame, name: str = "n_masks") -> DataFrame:
    """Detections of every frame, also of those without any."""
    n = det.groupBy(*FRAME).agg(F.count(F.lit(1)).alias(name))
    return frames.select(*FRAME).join(n, FRAME, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))


def detection_stats(det: DataFrame, frames: DataFrame) -> DataFrame:
    """Per video: frames with a detection, and total, largest and mean count per frame."""
    per = masks_per_frame(det, frames, "n")
    return per.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(F.col("n") > 0).alias("frames_with"), F.sum("n").alias("total"),
        F.max("n").alias("most"), (F.sum("n") / F.count(F.lit(1))).alias("mean"))


def empty_rate(det: DataFrame, frames: DataFrame) -> DataFrame:
    """Share of frames without masks per video."""
    per = masks_per_frame(det, frames, "n")
    return per.groupBy("video_id").agg(
        (F.count_if(F.col("n") == 0) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("empty_rate"))


def latency_stats(timings: DataFrame, keys: list[str], value: str = "ms", exact: bool = True) -> DataFrame:
    """Mean, median, 95th percentile (linear), range and rate of timings in milliseconds.

    Exact percentiles come from counted values in stretches of a millisecond; the
    approximate ones need one pass less.
    """
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_ms"), F.min(value).alias("min_ms"), F.max(value).alias("max_ms")]
    shares = {"median_ms": 0.5, "p95_ms": 0.95}
    if exact:
        stats = timings.groupBy(*keys).agg(*aggs).join(percentiles(timings, keys, value, shares), keys, "left")
    else:
        stats = timings.groupBy(*keys).agg(*aggs, *[F.percentile_approx(value, p, 100000).cast("double").alias(n) for n, p in shares.items()])
    return stats.select(*keys, "n", "mean_ms", *shares, "min_ms", "max_ms").withColumn("per_second", F.when(F.col("mean_ms") > 0, F.lit(1000.0) / F.col("mean_ms")).otherwise(0.0))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The depths of a batch of lines one after another: value, is it there, row in the batch, u."""
    lists = batch.column("depth")
    many = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten()
    row = np.repeat(np.arange(len(many)), many)
    u = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    there = pc.is_valid(values).to_numpy(zero_copy_only=False)
    return pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False).astype(float), there, row, u


def line_sums(depth_rows: DataFrame, width: int) -> DataFrame:
    """Each depth line as few numbers: for its left and right half the pixels (p), those with a depth (n) and their sum (s).

    ``mean`` and ``m2`` (squares about it) are those of the whole line. Lines go through in Arrow
    batches; no pixel becomes a row.
    """
    d = depth_rows.select(*FRAME, "v", "depth")
    kinds = {f.name: f.dataType.simpleString() for f in d.schema.fields}
    halves = [f"{c}_{side}" for side in ("left", "right") for c in "pns"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, there, row, u = _flat(b)
            k = b.num_rows
            out = []
            for here in (u < width // 2, u >= width // 2):
                good = here & there
                out += [np.bincount(row[here], minlength=k).astype(np.int64), np.bincount(row[good], minlength=k).astype(np.int64),
                        np.bincount(row[good], weights=x[good], minlength=k)]
            n, total = out[1] + out[4], out[2] + out[5]
            mean = total / np.maximum(n, 1)
            with np.errstate(invalid="ignore"):
                m2 = np.bincount(row[there], weights=(x[there] - mean[row[there]]) ** 2, minlength=k)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*FRAME, "v")), *(pa.array(c) for c in (*out, mean, m2))],
                                             names=[*FRAME, "v", *halves, "mean", "m2"])

    fields = [f"{c} {kinds[c]}" for c in (*FRAME, "v")] + [f"{c} {'double' if c[0] == 's' else 'long'}" for c in halves]
    return d.mapInArrow(run, ", ".join([*fields, "mean double", "m2 double"]))


def column_sums(depth_rows: DataFrame) -> DataFrame:
    """FRAME, u, n, s: depths and their sum by column, a row for each frame of a batch of lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, there, row, u = _flat(b)
            if not len(x):
                continue
            frames, frame = np.unique(np.stack([b.column(c).to_numpy() for c in FRAME], axis=1), axis=0, return_inverse=True)
            wide = int(u.max()) + 1
            at = frame.ravel()[row] * wide + u
            seen = np.flatnonzero(np.bincount(at, minlength=len(frames) * wide))
            n = np.bincount(at[there], minlength=len(frames) * wide)[seen].astype(np.int64)
            s = np.bincount(at[there], weights=x[there], minlength=len(frames) * wide)[seen]
            yield pa.RecordBatch.from_arrays([*(pa.array(frames[seen // wide, i]) for i in (0, 1)), pa.array((seen % wide).astype(np.int32)),
                                              pa.array(n), pa.array(s)], names=[*FRAME, "u", "n", "s"])

    return depth_rows.select(*FRAME, "depth").mapInArrow(run, "video_id long, frame_idx long, u int, n long, s double")


def _deviation(lines: Column) -> Column:
    """Population deviation of all from (n, mean, m2) of the parts, merged one after another."""
    def both(a: Column, b: Column) -> Column:
        n, gap = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.when(b["n"] == 0, a).otherwise(F.struct(n.alias("n"), (a["mean"] + gap * b["n"] / n).alias("mean"),
                                                          (a["m2"] + b["m2"] + gap * gap * a["n"] * b["n"] / n).alias("m2")))

    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(lines, none, both, lambda a: F.when(a["n"] > 0, F.sqrt(a["m2"] / a["n"])))


def depth_profile(depth_rows: DataFrame, height: int, width: int) -> dict[str, DataFrame]:
    """How depth is spread over the raster of each frame.

    ``overall`` range, deviation and distinct values; ``quadrants`` a cube over
    halves; ``bands`` the top quarter, middle half and bottom quarter; ``rows`` and
    ``columns`` the mean of each. Lines are summed before anything is shuffled.
    """
    lines = line_sums(depth_rows, width).filter("p_left + p_right > 0")
    n, s = F.col("n_left") + F.col("n_right"), F.col("s_left") + F.col("s_right")
    mean = lambda s, n: F.when(n > 0, s / n)
    std = _deviation(F.collect_list(F.struct(n.alias("n"), "mean", "m2"))).alias("std")  # one entry for each line of the raster
    top = F.col("v") < height // 2
    parts = [F.sum(F.when(top if vert == "top" else ~top, F.col(f"{c}_{hor}")).otherwise(0)).alias(f"{c}_{vert}_{hor}")
             for vert in ("top", "bottom") for hor in ("left", "right") for c in "pns"]
    cube = []
    for vert, verts in (("top", ["top"]), ("bottom", ["bottom"]), ("all", ["top", "bottom"])):
        for hor, hors in (("left", ["left"]), ("right", ["right"]), ("all", ["left", "right"])):
            p, many, total = (sum((F.col(f"{c}_{a}_{b}") for a in verts for b in hors), F.lit(0)) for c in "pns")
            cube.append(F.struct(F.lit(vert).alias("vertical"), F.lit(hor).alias("horizontal"), mean(total, many).alias("mean"), p.alias("p")))
    quadrants = lines.groupBy(*FRAME).agg(*parts).select(*FRAME, F.inline(F.array(*cube))).filter("p > 0").drop("p")
    band = F.when(F.col("v") < height // 4, "top").when(F.col("v") < 3 * height // 4, "middle").otherwise("bottom")
    # distinct values per line first: range and distinct set of a frame are built from short lists
    values = depth_rows.select(*FRAME, F.explode(F.array_distinct("depth")).alias("d")).withColumn("d", F.col("d").cast("double"))
    spans = values.groupBy(*FRAME).agg(F.min("d").alias("min"), F.max("d").alias("max"), F.countDistinct("d").alias("n_values"))
    overall = spans.join(lines.groupBy(*FRAME).agg(std), FRAME).select(*FRAME, "min", "max", "std", "n_values")
    return {"overall": overall, "quadrants": quadrants,
            "bands": lines.groupBy(*FRAME, band.alias("band")).agg(mean(F.sum(s), F.sum(n)).alias("mean")),
            "rows": lines.groupBy(*FRAME, "v").agg(mean(F.sum(s), F.sum(n)).alias("mean"), std),
            "columns": column_sums(depth_rows).groupBy(*FRAME, "u").agg(mean(F.sum("s"), F.sum("n")).alias("mean"))}


def duplicate_ids(obs: DataFrame) -> DataFrame:
    """Ids seen more than once in one frame; a fused scene has none."""
    return obs.groupBy(*FRAME, "object_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def duplicate_rate(obs: DataFrame) -> DataFrame:
    """Share of (frame, id) that occur more than once, per video."""
    per = obs.groupBy(*FRAME, "object_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("video_id").agg(F.count(F.lit(1)).alias("ids"), F.count_if(F.col("n") > 1).alias("repeated"),
                                       (F.count_if(F.col("n") > 1) / F.count(F.lit(1))).alias("rate"))


# Text tokens of one observation and of the fixed part of a scene.
TOKENS_PER_OBSERVATION = 184
TOKENS_FIXED = 800


def token_budget(steps: DataFrame) -> DataFrame:
    """Estimated text tokens of each video's scene."""
    return steps.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("observations"),
        (F.count(F.lit(1)) * TOKENS_PER_OBSERVATION + TOKENS_FIXED).alias("text_tokens"))
