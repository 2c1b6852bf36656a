"""Depth rasters between the processing and the original resolution."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneloom.operators.masks import JOIN
from sceneloom.schema import FRAME


def processed_size(orig: Column, orig_w: Column, orig_h: Column, process_res: int, method: str) -> Column:
    """Side length after resizing so that the longer (upper bound) or shorter side fits."""
    side = F.greatest(orig_w, orig_h) if method.startswith("upper_bound") else F.least(orig_w, orig_h)
    return F.greatest(F.lit(1), F.bround(orig * (F.lit(float(process_res)) / side), 0).cast("int"))


def rescale_intrinsics(frames: DataFrame, method: str = "upper_bound_resize", process_res: int = 504) -> DataFrame:
    """Intrinsics of the processed raster expressed for the original one.

    Needs k, orig_w, orig_h, proc_w, proc_h. Methods that crop first move the
    principal point back by the crop.
    """
    ow, oh, pw, ph = (F.col(c) for c in ("orig_w", "orig_h", "proc_w", "proc_h"))
    k = F.col("k")
    if "crop" in method:
        rw, rh = (processed_size(o, ow, oh, process_res, method) for o in (ow, oh))
        cx, cy = F.floor((rw - pw) / 2), F.floor((rh - ph) / 2)
        sx, sy = ow / rw, oh / rh
    else:
        cx = cy = F.lit(0)
        sx, sy = ow / pw, oh / ph
    out = F.array(k[0] * sx, k[1] * sx, (k[2] + cx) * sx, k[3] * sy, k[4] * sy, (k[5] + cy) * sy, k[6], k[7], k[8])
    return frames.withColumn("k", out)


def _trusted() -> Column:
    """The confidence line; a missing one trusts every pixel."""
    return F.coalesce("conf", F.transform("depth", lambda _: F.lit(1.0).cast("float")))


def pad_raster(rows: DataFrame, top: int, bottom: int, left: int, right: int, height: int) -> DataFrame:
    """Undo a crop: depth repeats its border, confidence is 0 outside."""
    rows = rows.withColumn("conf", _trusted())
    d, c = F.col("depth"), F.col("conf")
    wide = rows.withColumn("depth", F.concat(F.array_repeat(d[0], left), d, F.array_repeat(F.element_at(d, -1), right)))
    zero = F.lit(0.0).cast("float")
    wide = wide.withColumn("conf", F.concat(F.array_repeat(zero, left), c, F.array_repeat(zero, right)))
    lines = F.when(F.col("v") == 0, F.sequence(F.lit(0), F.lit(top))).when(
        F.col("v") == height - 1, F.sequence(F.lit(top + height - 1), F.lit(top + height - 1 + bottom))).otherwise(
        F.array((F.col("v") + top).cast("int")))
    if height == 1:
        lines = F.sequence(F.lit(0), F.lit(top + bottom))
    out = wide.withColumn("_o", F.explode(lines))
    inside = F.col("_o") == F.col("v") + top
    blank = F.transform("conf", lambda x: zero)
    return out.withColumn("conf", F.when(inside, F.col("conf")).otherwise(blank)).withColumn("v", F.col("_o")).drop("_o")


def resample_raster(rows: DataFrame, src: tuple[int, int], dst: tuple[int, int], mode: str = "bilinear",
                    columns: tuple[str, ...] = ("depth", "conf")) -> DataFrame:
    """Lines of a raster at another resolution.

    Each target line names its source lines in a table of dst-height rows (a fixed
    size, broadcast), and whole lines are joined; pixels meet inside the arrays.
    """
    (h, w), (big_h, big_w) = src, dst
    if "conf" in columns:
        rows = rows.withColumn("conf", _trusted())
    spark = rows.sparkSession
    u = F.sequence(F.lit(0), F.lit(big_w - 1))
    out = spark.range(big_h).select(F.col("id").cast("int").alias("out_v"))
    if mode == "nearest":
        lines = out.select("out_v", F.least(F.floor(F.col("out_v") * F.lit(h / big_h)), F.lit(h - 1)).cast("int").alias("v"))
        pick = lambda c: F.transform(u, lambda i: F.col(c)[F.least(
            F.floor(i * F.lit(w / big_w)), F.lit(w - 1)).cast("int")])
        return rows.join(F.broadcast(lines), "v").select(
            *FRAME, F.col("out_v").alias("v"), *[pick(c).alias(c) for c in columns])
    if mode != "bilinear":
        raise ValueError(f"unknown mode: {mode}")
    y = F.least(F.greatest((F.col("out_v") + 0.5) * F.lit(h / big_h) - 0.5, F.lit(0.0)), F.lit(float(h - 1)))
    lines = out.select("out_v", F.floor(y).cast("int").alias("y0"), (y - F.floor(y)).alias("wy"))
    lines = lines.withColumn("y1", F.least(F.col("y0") + 1, F.lit(h - 1)))
    upper = rows.join(F.broadcast(lines.select("out_v", "wy", F.col("y0").alias("v"))), "v").select(
        *FRAME, "out_v", "wy", *[F.col(c).alias(f"a_{c}") for c in columns])
    lower = rows.join(F.broadcast(lines.select("out_v", F.col("y1").alias("v"))), "v").select(
        *FRAME, "out_v", *[F.col(c).alias(f"b_{c}") for c in columns])
    both = upper.join(lower.hint(JOIN), [*FRAME, "out_v"])

    x = np.clip((np.arange(big_w) + 0.5) * (w / big_w) - 0.5, 0.0, w - 1.0)
    blend = _blender(columns, np.floor(x).astype(int), np.minimum(np.floor(x).astype(int) + 1, w - 1), x - np.floor(x), w)
    fields = ", ".join(["video_id long", "frame_idx long", "v int", *[f"{c} array<float>" for c in columns]])
    return both.mapInArrow(blend, fields)


def _blender(columns, x0, x1, wx, w: int):
    """Weights two joined source lines into target lines, a batch of lines at a time."""

    def run(batches):
        for b in batches:
            wy = b.column("wy").to_numpy()[:, None]
            out = [b.column("video_id"), b.column("frame_idx"), b.column("out_v")]
            for c in columns:
                upper, lower = (b.column(f"{s}_{c}").flatten().to_numpy().reshape(-1, w).astype(float) for s in "ab")
                rows = [(1.0 - wx) * r[:, x0] + wx * r[:, x1] for r in (upper, lower)]
                made = ((1.0 - wy) * rows[0] + wy * rows[1]).astype(np.float32)
                ends = np.arange(0, made.size + 1, made.shape[1], dtype=np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(made.ravel())))
            yield pa.RecordBatch.from_arrays(out, names=["video_id", "frame_idx", "v", *columns])

    return run
