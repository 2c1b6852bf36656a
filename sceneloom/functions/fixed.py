"""Order-independent statistics.

A sum of doubles depends on the order in which tasks deliver their partials, so
two runs of one job may differ in the last bits. The exact forms below count in
integer millionths and divide once at the end: every partial sum is an integer
and the result is the same for any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = 1e6
HALF_BITS = 31
_HALF = 2 ** HALF_BITS
#: Coordinates beyond count as this far away (metres), which no filter lets pass.
FARTHEST = 4e6


def to_fixed(x: Column) -> Column:
    return F.floor(F.greatest(F.least(x, F.lit(FARTHEST)), F.lit(-FARTHEST)) * F.lit(UNIT)).cast("bigint")


def fixed_mean(total: Column, n: Column) -> Column:
    return total.cast("double") / (n * F.lit(UNIT))


def square_sums(q: Column, name: str) -> list[Column]:
    """The sum of q*q as four longs, which cannot overflow below 2^20 rows of FARTHEST, or 2^31 within 2 km.

    With q = a * 2^31 + b the square is a^2 * 2^62 + 2ab * 2^31 + b^2; b^2 is split again.
    """
    a, b = F.shiftright(q, 31), q.bitwiseAND(F.lit(_HALF - 1))
    sq = b * b
    return [F.sum(a * a).alias(f"{name}_aa"), F.sum(a * b).alias(f"{name}_ab"),
            F.sum(F.shiftright(sq, 31)).alias(f"{name}_hi"), F.sum(sq.bitwiseAND(F.lit(_HALF - 1))).alias(f"{name}_lo")]


def fixed_std(n: Column, total: Column, name: str) -> Column:
    """Population deviation: sqrt(n*sum(q^2) - sum(q)^2) / n, in units; ``name`` as in square_sums."""
    wide = lambda c: F.col(f"{name}_{c}").cast("decimal(19,0)")
    half = F.lit(_HALF).cast("decimal(10,0)")
    middle = (wide("ab") * F.lit(2).cast("decimal(1,0)") + wide("hi")).cast("decimal(22,0)")
    square = ((wide("aa") * half).cast("decimal(29,0)") + middle).cast("decimal(28,0)") * half + wide("lo")
    spread = (n.cast("decimal(12,0)") * square.cast("decimal(32,0)")
              - total.cast("decimal(19,0)") * total.cast("decimal(19,0)"))
    return F.sqrt(spread.cast("double")) / n / F.lit(UNIT)
