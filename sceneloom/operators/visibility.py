"""Points met with the cameras that see them, through cells of space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneloom.functions import geometry as g
from sceneloom.schema import FRAME

_C = ("_cx", "_cy", "_cz")


def view_planes(cams: DataFrame, height: int, width: int) -> DataFrame:
    """Cameras with ``planes``: five (a, b, c, d) with a x + b y + c z + d >= 0 for every world point in view.

    In front of the camera, right of the left image border, and so on: each is linear in
    the point, so a box of space is out of view if its best corner fails one of them.
    """
    k, t = g.cells(F.col("k"), 9), g.cells(F.col("t_wc"), 16)
    zero, one = F.lit(0.0), F.lit(1.0)
    row = lambda i: [k[3 * i + j] for j in range(3)]
    inside = [[zero, zero, one], row(0), row(1),
              [F.lit(float(width)) * c - a for a, c in zip(row(0), row(2))], [F.lit(float(height)) * c - a for a, c in zip(row(1), row(2))]]

    def plane(n):
        turned = [n[0] * t[j] + n[1] * t[4 + j] + n[2] * t[8 + j] for j in range(3)]
        return F.array(*turned, n[0] * t[3] + n[1] * t[7] + n[2] * t[11])

    return cams.withColumn("planes", F.array(*[plane(n) for n in inside]))


def _may_see(planes: Column, centre: list[Column], half: float) -> Column:
    """No plane has the whole box on its far side; rounding is given room."""
    def near(p):
        reach = F.lit(half) * (F.abs(p[0]) + F.abs(p[1]) + F.abs(p[2]))
        room = F.lit(1e-9) * (F.abs(p[3]) + reach + sum((F.abs(p[i] * c) for i, c in enumerate(centre)), F.lit(0.0)))
        return p[0] * centre[0] + p[1] * centre[1] + p[2] * centre[2] + p[3] + reach + room >= 0
    return F.forall(planes, near)


def visible_candidates(points: DataFrame, cams: DataFrame, height: int, width: int, keys: list[str] = FRAME, cell: float = 1.0, levels: int = 3) -> DataFrame:
    """Points beside the cameras of their key that may see them.

    Occupied cells of the coarsest level meet the cameras of their key; what a camera may see
    of them is opened level by level (four finer cells along each axis), and only the points of
    the finest cells left meet that camera. Cells no camera looks at cost one comparison.
    """
    size = lambda level: float(cell) * 4 ** level
    at = lambda level: [F.floor(F.col(c) / size(level)).cast("bigint").alias(n) for c, n in zip("xyz", _C)]
    pts = points.select("*", *at(0))
    occupied = pts.select(*keys, *_C).distinct()
    up = lambda level: [F.floor(F.col(n) / 4 ** level).cast("bigint").alias(n) for n in _C]
    centre = lambda level: [(F.col(n) + 0.5) * size(level) for n in _C]
    pairs = None
    for level in range(levels - 1, -1, -1):
        own = occupied.select(*keys, *up(level)).distinct() if level else occupied
        if pairs is None:
            pairs = own.join(view_planes(cams, height, width), keys)
        else:
            parent = [F.floor(F.col(n) / 4).cast("bigint").alias(f"{n}p") for n in _C]
            pairs = own.select("*", *parent).join(pairs.withColumnsRenamed({n: f"{n}p" for n in _C}), [*keys, *[f"{n}p" for n in _C]]).drop(*[f"{n}p" for n in _C])
        pairs = pairs.filter(_may_see(F.col("planes"), centre(level), size(level) / 2))
    return pts.join(pairs.drop("planes"), [*keys, *_C]).drop(*_C)


def visible_points(points: DataFrame, cams: DataFrame, height: int, width: int, keys: list[str] = FRAME, cell: float = 1.0, levels: int = 3) -> DataFrame:
    """World points with image coordinates in each camera of the key that sees them; the rows of ``project_points`` that are valid."""
    d = visible_candidates(points, cams, height, width, keys, cell, levels)
    p = g.transform_point([F.col(c) for c in "xyz"], F.col("t_wc"))
    img = g.apply3(g.cells(F.col("k"), 9), p)
    z = F.when(img[2] == 0, F.lit(1e-8)).otherwise(img[2])
    d = d.withColumn("_ahead", p[2] > 0).withColumn("img_x", img[0] / z).withColumn("img_y", img[1] / z)
    ok = F.col("_ahead") & (F.col("img_x") >= 0) & (F.col("img_x") < width) & (F.col("img_y") >= 0) & (F.col("img_y") < height)
    return d.filter(ok).drop("k", "t_wc", "_ahead")
