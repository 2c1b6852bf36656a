"""Choosing frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneloom.functions.ordered import global_row_number


def sample_fps(frames: DataFrame, target_fps: float, idx: str = "source_idx", fps: str = "fps") -> DataFrame:
    """Thin consecutively numbered frames to a target rate.

    The greedy rule "take a frame once its time reaches the next due time" takes
    exactly the frames whose due-time bucket differs from the frame before. With
    numbered frames that frame's time is known, so this is a filter: no window.
    A source without a rate is kept whole.
    """
    if target_fps <= 0:
        raise ValueError("target_fps must be positive")
    due = lambda i: F.floor((i / F.col(fps) + F.lit(1e-9)) / F.lit(1.0 / target_fps))
    i = F.col(idx)
    return frames.filter((F.col(fps) <= 0) | (i == 0) | (due(i) > due(i - 1)))


def cap_frames(frames: DataFrame, n: int | None, idx: str = "source_idx", key: str = "video_id") -> DataFrame:
    """The first n frames of each video."""
    if n is None:
        return frames
    return global_row_number(frames, [key], idx, name="_rn").filter(F.col("_rn") <= n).drop("_rn")


def sample_even(df: DataFrame, keys: list[str], pos: str, n: int, ties: list[str] = (),
                bucket: int = 4096) -> DataFrame:
    """n rows per key at evenly spread ranks, truncated towards zero; all rows if n reaches them.

    Rank r is taken iff some i has floor(i * step) = r. As step >= 1 only the
    whole numbers next to r/step can be that i, so no position list is joined.
    """
    d = global_row_number(df, keys, pos, ties, name="_rn", bucket=bucket, count="_n")
    r, last = F.col("_rn") - 1, F.col("_n") - 1
    if n <= 0:
        raise ValueError("n must be positive")
    if n == 1:
        hit = r == 0
    else:
        step = last / F.lit(n - 1)
        near = F.floor(r / step)
        tries = [near + k for k in (-1, 0, 1)]
        hit = (r == last)
        for i in tries:
            hit = hit | ((i >= 0) & (i < n - 1) & (F.floor(i * step) == r))
    return d.filter((F.col("_n") <= n) | hit).drop("_rn", "_n")


def sample_stride(frames: DataFrame, target_fps: float, idx: str = "source_idx", fps: str = "fps") -> DataFrame:
    """Every round(source/target)-th frame, halves to even, at least every one."""
    step = F.greatest(F.lit(1), F.bround(F.col(fps) / F.lit(float(target_fps)), 0).cast("bigint"))
    return frames.filter(F.col(idx) % step == 0)


def slice_frames(df: DataFrame, lo: int, hi: int, step: int = 1, idx: str = "frame_idx") -> DataFrame:
    """Frames lo..hi, both included, in strides from lo."""
    return df.filter((F.col(idx) >= lo) & (F.col(idx) <= hi) & ((F.col(idx) - lo) % step == 0))
