"""Small matrices as column expressions.

A 3x3 matrix is an ``array<double>`` of 9, a pose one of 16, both row major.
Everything expands to plain arithmetic, which stays inside generated code.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cells(m: Column, n: int) -> list[Column]:
    return [m[i] for i in range(n)]


def pose_to_4x4(t: Column) -> Column:
    """12 values gain the row (0,0,0,1), 16 pass, any other size is an error."""
    last = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return (F.when(F.size(t) == 12, F.concat(t, last))
            .when(F.size(t) == 16, t)
            .otherwise(F.raise_error(F.concat(F.lit("pose must hold 12 or 16 values, not "),
                                              F.size(t).cast("string")))))


def _cofactors(a: list[Column]) -> list[Column]:
    return [a[4] * a[8] - a[5] * a[7], a[2] * a[7] - a[1] * a[8], a[1] * a[5] - a[2] * a[4],
            a[5] * a[6] - a[3] * a[8], a[0] * a[8] - a[2] * a[6], a[2] * a[3] - a[0] * a[5],
            a[3] * a[7] - a[4] * a[6], a[1] * a[6] - a[0] * a[7], a[0] * a[4] - a[1] * a[3]]


def inverse3(a: list[Column]) -> list[Column]:
    """Inverse by cofactors of nine cell expressions."""
    cof = _cofactors(a)
    det = a[0] * cof[0] + a[1] * cof[3] + a[2] * cof[6]
    return [c / det for c in cof]


def rotation_cells(t: Column) -> list[Column]:
    return [t[i] for i in (0, 1, 2, 4, 5, 6, 8, 9, 10)]


def translation_cells(t: Column) -> list[Column]:
    return [t[i] for i in (3, 7, 11)]


def apply3(r: list[Column], p: list[Column]) -> list[Column]:
    return [r[3 * i] * p[0] + r[3 * i + 1] * p[1] + r[3 * i + 2] * p[2] for i in range(3)]


def product3(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j]
            for i in range(3) for j in range(3)]


def pose_of(r: list[Column], t: list[Column]) -> Column:
    z, one = F.lit(0.0), F.lit(1.0)
    return F.array(r[0], r[1], r[2], t[0], r[3], r[4], r[5], t[1], r[6], r[7], r[8], t[2], z, z, z, one)


def pose_inverse(t: Column) -> Column:
    """Inverse of an affine pose: A^-1 and 0 - A^-1 t."""
    inv = inverse3(rotation_cells(t))
    moved = apply3(inv, translation_cells(t))
    return pose_of(inv, [F.lit(0.0) - m for m in moved])


def with_pose_inverse(df: DataFrame, pose: str, name: str) -> DataFrame:
    """The same inverse in steps, so that each shared term is written once."""
    a = rotation_cells(F.col(pose))
    df = df.withColumn("_cof", F.array(*_cofactors(a)))
    cof = cells(F.col("_cof"), 9)
    df = df.withColumn("_det", a[0] * cof[0] + a[1] * cof[3] + a[2] * cof[6])
    df = df.withColumn("_inv", F.array(*[c / F.col("_det") for c in cof]))
    inv = cells(F.col("_inv"), 9)
    moved = apply3(inv, translation_cells(F.col(pose)))
    return df.withColumn(name, pose_of(inv, [F.lit(0.0) - m for m in moved])).drop("_cof", "_det", "_inv")


def pose_product(a: Column, b: Column) -> Column:
    ra, rb = rotation_cells(a), rotation_cells(b)
    ta, tb = translation_cells(a), translation_cells(b)
    shifted = [m + s for m, s in zip(apply3(ra, tb), ta)]
    return pose_of(product3(ra, rb), shifted)


def with_rays(frames: DataFrame, name: str = "ray") -> DataFrame:
    """Per frame the twelve numbers that lift any pixel: R_cw K^-1 beside t_cw, row by row.

    They are worked out once per frame for any invertible K, skew included; a pixel
    then costs three fused rows: world = (M [u, v, 1]) * depth + t.
    """
    d = with_pose_inverse(frames, "t_wc", "_cw")
    k = cells(F.col("k"), 9)
    d = d.withColumn("_cof", F.array(*_cofactors(k)))
    cof = cells(F.col("_cof"), 9)
    d = d.withColumn("_det", k[0] * cof[0] + k[1] * cof[3] + k[2] * cof[6])
    d = d.withColumn("_kinv", F.array(*[c / F.col("_det") for c in cof]))
    m = product3(rotation_cells(F.col("_cw")), cells(F.col("_kinv"), 9))
    t = translation_cells(F.col("_cw"))
    rows = [x for i in range(3) for x in (*m[3 * i:3 * i + 3], t[i])]
    return d.withColumn(name, F.array(*rows)).drop("_cw", "_cof", "_det", "_kinv")


def lift(u: Column, v: Column, d: Column, ray: Column) -> list[Column]:
    """World point of a pixel, each coordinate rounded to single precision as clouds store it."""
    return [((ray[i] * u + ray[i + 1] * v + ray[i + 2]) * d + ray[i + 3]).cast("float").cast("double")
            for i in (0, 4, 8)]


def transform_point(p: list[Column], t: Column) -> list[Column]:
    return [m + s for m, s in zip(apply3(rotation_cells(t), p), translation_cells(t))]


def distance(a: list[Column], b: list[Column]) -> Column:
    dx, dy, dz = (x - y for x, y in zip(a, b))
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def norm(p: list[Column]) -> Column:
    return F.sqrt(p[0] * p[0] + p[1] * p[1] + p[2] * p[2])


# The names of the eight sectors, counter-clockwise from ahead.
BEARINGS = ["front", "front-left", "left", "back-left", "back", "back-right", "right", "front-right"]


def bearing_8way(deg: Column) -> Column:
    """Sector of an angle in degrees, left positive; sectors are half open."""
    sector = F.pmod(F.floor((deg + F.lit(22.5)) / F.lit(45.0)), F.lit(8)).cast("int")
    return F.element_at(F.array(*[F.lit(b) for b in BEARINGS]), sector + 1)


def elevation(dz: Column, threshold: float = 0.5) -> Column:
    return (F.when(dz > F.lit(threshold), "above")
            .when(dz < F.lit(-threshold), "below").otherwise("level"))


_LEVELS = ("above", "below", "level")


def _words(place: Column, *parts: tuple[str, ...]) -> Column:
    """The combination of words, joined by "_", at a place among all of them in order."""
    return F.element_at(F.array(*[F.lit("_".join(p)) for p in product(*parts)]), place + 1)


def relation_label(dx: Column, dy: Column, dz: Column, dist: Column, variant: str = "paper") -> Column:
    """Coarse direction words of one object seen from another.

    ``paper`` compares the magnitudes first and has no distance word;
    ``notebook`` takes any dx > 0 as right, and appends near, medium or far.
    """
    # the words of every case are put together once; a pair only looks its own up
    level = lambda limit: F.when(dz > F.lit(limit), 0).when(dz < F.lit(-limit), 1).otherwise(2)
    if variant == "paper":
        horizontal = (F.when(F.abs(dx) > F.abs(dy), F.when(dx > 0, 0).otherwise(1))
                      .otherwise(F.when(dy > 0, 2).otherwise(3)))
        return _words(horizontal * 3 + level(0.5), ("right", "left", "front", "back"), _LEVELS)
    if variant == "notebook":
        horizontal = (F.when(dx > 0, 0).when(F.abs(dx) > F.abs(dy), 1)
                      .when(dy > 0, 2).otherwise(3))
        reach = F.when(dist < 3, 0).when(dist < 8, 1).otherwise(2)
        return _words((horizontal * 3 + level(0.3)) * 3 + reach, ("right", "left", "front", "back"), _LEVELS, ("near", "medium", "far"))
    raise ValueError(f"unknown relation variant: {variant}")
