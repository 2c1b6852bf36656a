"""Points of two sides that meet block by block, of whose pairs only the best leave the task."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneloom.functions.batches import column
from sceneloom.session import ensure_checkpoint_dir

#: Points of one cell and side that meet as a block, distances worked out at once, and pairs to a task.
_BLOCK = 4096
_AT_ONCE = 1 << 16
_PAIRS_A_TASK = 1 << 27

#: Of left points (n, 3), right points (m, 3) and the prices of both: places of pairs, their distance, and whether the left or the right side named them.
Judge = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]]


def in_cells(points: DataFrame, radius: float, cell: float = 2.0) -> DataFrame:
    """The points with the ground cell they lie in, ``cell`` radii wide."""
    # cells far out count as one: differences only shrink, and none of them overflows
    at = lambda c: F.greatest(F.least(F.floor(F.col(c) / (cell * radius)).cast("bigint"), F.lit(1 << 60)), F.lit(-(1 << 60)))
    return points.select("*", at("x").alias("_gx"), at("z").alias("_gz"))


def meetings(points: DataFrame, keys: list[str], block: int = _BLOCK) -> tuple[DataFrame, int]:
    """Which cells of left points meet which of right points, each with its number of blocks; and the tasks for all pairs.

    ``points`` have the cells of ``in_cells`` and a flag ``left``. Each cell meets its nine neighbours of the other side.
    The driver sees the number of pairs.
    """
    spark = points.sparkSession
    ensure_checkpoint_dir(spark)
    cells = points.groupBy(*keys, "left", "_gx", "_gz").agg(F.count(F.lit(1)).alias("_n"))
    blocks = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = cells.filter("left").select(*keys, F.col("_gx").alias("_lx"), F.col("_gz").alias("_lz"), blocks.alias("_nl"), F.col("_n").alias("_cl"), F.explode(near).alias("_o"))
    a = a.select(*keys, "_lx", "_lz", "_nl", "_cl", (F.col("_lx") + F.col("_o")["i"]).alias("_rx"), (F.col("_lz") + F.col("_o")["j"]).alias("_rz"))
    b = cells.filter("not left").select(*keys, F.col("_gx").alias("_rx"), F.col("_gz").alias("_rz"), blocks.alias("_nr"), F.col("_n").alias("_cr"))
    links = a.join(b, [*keys, "_rx", "_rz"]).withColumn("_link", F.monotonically_increasing_id()).checkpoint()
    pairs = links.agg(F.sum(F.col("_cl") * F.col("_cr").cast("double"))).first()[0] or 0
    tasks = min(max(spark.sparkContext.defaultParallelism, math.ceil(pairs / _PAIRS_A_TASK)), 1 << 15)
    return links.drop("_cl", "_cr"), tasks


def best_pairs(points: DataFrame, links: DataFrame, tasks: int, keys: list[str], judge: Judge, price: str | None = None) -> DataFrame:
    """The pairs that ``judge`` names in any two blocks that meet: keys, by_left, l_id, r_id, dist, price (of both).

    Each block is copied to those it meets; a task holds two blocks, however many points share a cell, and sees both in
    order of their ids.
    """
    meet = ["_link", "_i", "_j"]

    def side(s: str, mine: str, other: str, o: str) -> DataFrame:
        at = points.filter("left" if s == "l" else "not left").withColumnsRenamed({"_gx": f"_{s}x", "_gz": f"_{s}z"})
        at = at.join(links.select(*keys, f"_{s}x", f"_{s}z", "_link", "_nl", "_nr"), [*keys, f"_{s}x", f"_{s}z"])
        at = at.withColumn(mine, F.expr(f"cast(pmod(xxhash64(id), _n{s}) as int)")).withColumn(other, F.explode(F.expr(f"sequence(0, _n{o} - 1)")))
        return at.select(*meet, "left", *keys, "id", "x", "y", "z", (F.col(price) if price else F.lit(0.0)).alias("_price"))

    met = side("l", "_i", "_j", "r").unionByName(side("r", "_j", "_i", "l"))
    kinds = {f.name: f.dataType.simpleString() for f in met.schema}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", by_left boolean, l_id {kinds['id']}, r_id {kinds['id']}, dist double, price double"
    met = met.repartition(tasks, *meet).sortWithinPartitions(*meet, F.desc("left"), "id")

    def judged(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.stack([column(table, c).to_numpy() for c in "xyz"], axis=1)
        paid = column(table, "_price").to_numpy()
        lefts = np.concatenate([[0], np.cumsum(column(table, "left").to_numpy(zero_copy_only=False))])
        found = []
        for s, e in zip(bounds[:-1], bounds[1:]):
            m = s + lefts[e] - lefts[s]
            if s < m < e:
                found += [(s + i, m + j, d, np.full(len(i), by_left)) for i, j, d, by_left in judge(at[s:m], at[m:e], paid[s:m], paid[m:e]) if len(i)]
        if found:
            i, j, d, by_left = (np.concatenate(c) for c in zip(*found))
            ids, names = table.column("id"), [*keys, "by_left", "l_id", "r_id", "dist", "price"]
            out = [*(table.column(k).take(pa.array(i)) for k in keys), pa.chunked_array([by_left]), ids.take(pa.array(i)), ids.take(pa.array(j)),
                   pa.chunked_array([d]), pa.chunked_array([paid[i] + paid[j]])]
            yield from pa.table(out, names=names).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []  # the blocks that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*open_, batch])
            key = np.stack([column(table, c).to_numpy() for c in meet])
            starts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            if len(starts):
                yield from judged(table, np.concatenate([[0], starts]))
                table = table.slice(int(starts[-1]))
            open_ = table.to_batches()
        if open_:
            table = pa.Table.from_batches(open_)
            yield from judged(table, np.array([0, table.num_rows]))

    return met.mapInArrow(run, schema)


def _distances(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Distances of a stretch of left points to all right ones, with the place where it begins."""
    step = max(1, _AT_ONCE // len(right))
    with np.errstate(over="ignore"):
        for a in range(0, len(left), step):
            d = np.square(right[:, 0] - left[a:a + step, 0, None])
            for c in (1, 2):
                d += np.square(right[:, c] - left[a:a + step, c, None])
            yield a, np.sqrt(d, out=d)


def closest(radius: float) -> Judge:
    """For each point the closest one of the other side nearer than ``radius``; of several the first."""

    def judge(left, right, _pays, _takes):
        near, far = np.full(len(right), np.inf), np.zeros(len(right), dtype=np.int64)
        for a, d in _distances(left, right):
            j = d.argmin(axis=1)
            dist = d[np.arange(len(d)), j]
            keep = dist < radius
            yield a + np.flatnonzero(keep), j[keep], dist[keep], True
            least = d.min(axis=0)
            better = np.flatnonzero(least < near)
            near[better] = least[better]
            far[better] = a + (d[:, better] == least[better]).argmax(axis=0)
        keep = near < radius
        yield far[keep], np.flatnonzero(keep), near[keep], False

    return judge


def cheaper(radius: float, few: int, least: float = 1e-9) -> Judge:
    """For each left point the ``few`` right ones nearer than ``radius`` whose distance falls furthest below the price of both, by more than ``least``."""

    def judge(left, right, pays, takes):
        for a, d in _distances(left, right):
            gain = pays[a:a + len(d), None] + takes - d
            rows = np.flatnonzero(gain.max(axis=1) > least)
            if not len(rows):
                continue
            gain, d = gain[rows], d[rows]
            good = (gain > least) & (d < radius)
            many = good.sum(axis=1) > few
            i, j = np.nonzero(good & ~many[:, None])
            if many.any():
                best = np.argpartition(np.where(good[many], -gain[many], np.inf), few - 1, axis=1)[:, :few]
                i, j = np.concatenate([i, np.repeat(np.flatnonzero(many), few)]), np.concatenate([j, best.ravel()])
            yield a + rows[i], j, d[i, j], True

    return judge
