"""Ranks, gaps and runs over keys of any size.

A plain window sorts all rows of one key in one task. These forms cut each key
into stretches of ``bucket`` positions, run the window per stretch, and carry
the stretch totals across with a second window over one row per stretch. The
big input is shuffled once, on (key, stretch); both uses of it share that
exchange, and only the totals move again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 4096


def _stretch(df: DataFrame, pos: str, bucket: int) -> DataFrame:
    return df.withColumn("_b", F.floor(F.col(pos) / F.lit(bucket)).cast("bigint"))


def global_row_number(df: DataFrame, keys: list[str], pos: str, ties: list[str] = (),
                      name: str = "rn", bucket: float = BUCKET, count: str | None = None) -> DataFrame:
    """1-based rank by (pos, ties) within keys; ``count`` also adds the key's size."""
    d = _stretch(df, pos, bucket)
    local = Window.partitionBy(*keys, "_b").orderBy(pos, *ties)
    d = d.withColumn("_r", F.row_number().over(local))
    totals = d.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    across = Window.partitionBy(*keys).orderBy("_b")
    carried = totals.withColumn(
        "_before", F.coalesce(F.sum("_n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    drop = ["_b", "_r", "_before", "_n"]
    if count:
        carried = carried.withColumn(count, F.sum("_n").over(Window.partitionBy(*keys)))
    # both sides lie by stretch; without the hint rows exploded from few ids pass for few bytes, and are broadcast
    d = d.join(carried.hint("merge"), [*keys, "_b"])
    return d.withColumn(name, (F.col("_r") + F.col("_before")).cast("bigint")).drop(*drop)


def with_previous(df: DataFrame, keys: list[str], pos: str, value: str, name: str,
                  ties: list[str] = (), bucket: int = BUCKET) -> DataFrame:
    """The ``value`` of the row before this one within keys, null for the first."""
    d = _stretch(df, pos, bucket)
    local = Window.partitionBy(*keys, "_b").orderBy(pos, *ties)
    d = (d.withColumn("_first", F.row_number().over(local) == 1)
          .withColumn("_prev", F.lag(F.struct(F.col(value).alias("x"))).over(local)))
    order = F.struct(pos, *ties)
    ends = d.groupBy(*keys, "_b").agg(F.max_by(F.struct(F.col(value).alias("x")), order).alias("_last"))
    carried = ends.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b")))
    d = d.join(carried.drop("_last"), [*keys, "_b"])
    chosen = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev"))
    return d.withColumn(name, chosen.getField("x")).drop("_b", "_first", "_prev", "_carry")


def running_sum(df: DataFrame, keys: list[str], pos: str, value: Column, name: str,
                ties: list[str] = (), bucket: int = BUCKET) -> DataFrame:
    """Inclusive running total of ``value`` by (pos, ties) within keys."""
    d = _stretch(df, pos, bucket).withColumn("_x", value)
    local = Window.partitionBy(*keys, "_b").orderBy(pos, *ties).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_s", F.sum("_x").over(local))
    totals = d.groupBy(*keys, "_b").agg(F.sum("_x").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
    d = d.join(carried, [*keys, "_b"])
    return d.withColumn(name, (F.col("_s") + F.col("_before")).cast("bigint")).drop("_b", "_x", "_s", "_before")


def gap_segments(df: DataFrame, keys: list[str], pos: str, gap: int, name: str = "segment",
                 ties: list[str] = (), bucket: int = BUCKET) -> DataFrame:
    """Number runs of positions; a run breaks where ``gap`` or more are missing in between.

    One pass: each stretch counts its own breaks, and the totals carry the last
    position and the number of breaks to the next stretch.
    """
    d = _stretch(df, pos, bucket)
    local = Window.partitionBy(*keys, "_b").orderBy(pos, *ties)
    running = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_p", F.lag(pos).over(local))
    d = d.withColumn("_brk", F.when(F.col(pos) - F.col("_p") - 1 >= gap, 1).otherwise(0))
    d = d.withColumn("_s", F.sum("_brk").over(running))
    totals = d.groupBy(*keys, "_b").agg(
        F.min(pos).alias("_lo"), F.max(pos).alias("_hi"), F.sum("_brk").alias("_t"))
    across = Window.partitionBy(*keys).orderBy("_b")
    edge = F.when(F.col("_lo") - F.lag("_hi").over(across) - 1 >= gap, 1).otherwise(0)
    carried = totals.select(*keys, "_b", "_t", edge.alias("_e"))
    carried = carried.select(*keys, "_b", (
        F.sum(F.col("_e") + F.col("_t")).over(across.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        - F.col("_t")).alias("_before"))
    d = d.join(carried, [*keys, "_b"])
    return d.withColumn(name, (F.col("_s") + F.col("_before")).cast("bigint")).drop(
        "_b", "_p", "_brk", "_s", "_before")


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], step: float = 1.0) -> DataFrame:
    """Exact percentiles (linear between neighbours) of ``value`` by key, one column for each name in ``shares``.

    Equal values are counted first; the counts are then summed in order of the value over
    stretches ``step`` wide, so no task holds all values of a key.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = running_sum(counts, keys, value, F.col("_n"), "_c", bucket=step)
    d = upto.join(counts.groupBy(*keys).agg((F.sum("_n") - 1).alias("_last")), keys)
    picks, out = [], []
    for name, p in shares.items():
        at = F.col("_last") * F.lit(p)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (F.col("_c") > rank) & (F.col("_c") - F.col("_n") <= rank)
            picks.append(F.max(F.when(here, F.col(value))).alias(f"_{side}_{name}"))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append(F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi).alias(name))
    return d.groupBy(*keys, "_last").agg(*picks).select(*keys, *out)
