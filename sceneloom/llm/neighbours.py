"""Nearest vectors by a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every row then goes down to one leaf. A query opens
the nodes in the order of a priority queue, the centroid nearest to it first, and visits
the first leaves that come out. How many it visits is calibrated: for a bounded sample of
queries the exact neighbours among all rows are known from one pass, and the visits are
widened until the wanted share of them lies in visited leaves (all leaves, if need be:
then the search is exact).

Rows meet the queries that visit their leaf in blocks: a leaf with many rows or many
visitors is cut on both sides, so no task holds more than one block of each.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.llm.common import about, kept

#: Vectors that the tree is fitted on, and queries that the visits are calibrated with.
FIT_ROWS, CALIBRATION_QUERIES = 8_192, 256
#: Fitted vectors to a leaf, and children to a node.
LEAF_ROWS, BRANCHES = 256, 8
#: Rows and queries of a block.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 4_096


@dataclass
class Tree:
    """Nodes by number, the root first; ``children`` of a leaf is empty and ``leaf`` its number (else -1)."""

    centroids: np.ndarray
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)

    @property
    def leaves(self) -> int:
        return sum(x >= 0 for x in self.leaf)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: from the root to the nearest child, ties to the first."""
        out = np.zeros(len(x), np.int32)
        open_nodes = [(0, np.arange(len(x)))]
        while open_nodes:
            node, rows = open_nodes.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            c = self.centroids[self.children[node]]
            near = np.argmin((c * c).sum(1) - 2 * x[rows] @ c.T, axis=1)
            open_nodes += [(child, rows[near == i]) for i, child in enumerate(self.children[node]) if (near == i).any()]
        return out

    def best_first(self, q: np.ndarray, visits: int) -> list[int]:
        """The first ``visits`` leaves in best-bin-first order."""
        heap, out = [(0.0, 0)], []
        while heap and len(out) < visits:
            _, node = heapq.heappop(heap)
            if not self.children[node]:
                out.append(self.leaf[node])
                continue
            away = ((self.centroids[self.children[node]] - q) ** 2).sum(1)
            for child, d in zip(self.children[node], away.tolist()):
                heapq.heappush(heap, (d, child))
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Which of up to ``k`` clusters each row is in; seeds far from each other, then Lloyd's rounds."""
    seeds = [x[rng.integers(len(x))]]
    away = ((x - seeds[0]) ** 2).sum(1)
    while len(seeds) < k and away.max() > 0:
        seeds.append(x[rng.choice(len(x), p=away / away.sum())])
        away = np.minimum(away, ((x - seeds[-1]) ** 2).sum(1))
    c = np.array(seeds)
    label = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        new = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        used = np.unique(new)
        c = np.array([x[new == i].mean(0) for i in used])
        label = np.searchsorted(used, new)
    return label


def build_tree(x: np.ndarray, leaf_rows: int = LEAF_ROWS, branches: int = BRANCHES, seed: int = 5) -> Tree:
    """A tree over the rows of ``x``; a node of at most ``leaf_rows`` rows, or of equal rows only, is a leaf."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1] if x.ndim == 2 else 1
    tree = Tree(np.zeros((0, dim)))
    centroids = [x.mean(0) if len(x) else np.zeros(dim)]
    tree.children.append([])
    tree.leaf.append(-1)
    todo = [(0, x)]
    while todo:
        node, rows = todo.pop()
        label = _kmeans(rows, branches, rng) if len(rows) > leaf_rows else np.zeros(len(rows), np.int64)
        parts = [rows[label == i] for i in range(int(label.max(initial=0)) + 1)]
        if len(parts) < 2:
            tree.leaf[node] = sum(n >= 0 for n in tree.leaf)
            continue
        for part in parts:
            tree.children[node].append(len(centroids))
            tree.children.append([])
            tree.leaf.append(-1)
            centroids.append(part.mean(0))
            todo.append((len(centroids) - 1, part))
    tree.centroids = np.array(centroids)
    return tree


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _nearest(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, row place, distance) of the k nearest rows of each query, by distance, then id; no row has its query's id.

    Products of matrices only pick what can be among the k nearest, with room for their
    rounding; distances are then taken from the differences.
    """
    squares = (x * x).sum(1)
    which, rows, distances = [], [], []
    for start in range(0, len(q), 256):
        part = q[start:start + 256]
        own = (part * part).sum(1)
        rough = own[:, None] + squares - 2 * part @ x.T
        rough[q_ids[start:start + 256][:, None] == ids] = np.inf
        room = 1e-12 * (own + squares.max(initial=0))
        for i in range(len(part)):
            line = rough[i]
            if len(line) > k:
                line_k = np.partition(line, k - 1)[k - 1]
                near = np.flatnonzero((line <= line_k + room[i]) & (line < np.inf))
            else:
                near = np.flatnonzero(line < np.inf)
            d = np.sqrt(((x[near] - part[i]) ** 2).sum(1))
            best = np.lexsort((ids[near], d))[:k]
            which.append(np.full(len(best), start + i))
            rows.append(near[best])
            distances.append(d[best])
    if not which:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(which), np.concatenate(rows), np.concatenate(distances)


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec): the rows that take part.

    Rows without vec_id or vector, with null or non-finite components or only zeros don't,
    nor those whose length isn't the commonest one (ties: the shortest).
    """
    full = vectors.select(F.col("vec_id").alias("vec_id"), F.col("embedding").alias("vec")).filter(
        "vec_id is not null and vec is not null and exists(vec, x -> x <> 0)"
        " and not exists(vec, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    lengths = full.groupBy(F.size("vec").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
    return full.filter(F.size("vec") == (lengths["size"] if lengths else 0))


@dataclass
class Index:
    """A fitted tree, its dimension, and all rows by leaf: (leaf, vec_id, vec), written to the shared folder."""

    tree: Tree
    dim: int
    rows: DataFrame
    sizes: dict[int, int]


def build_index(vectors: DataFrame, fit_rows: int = FIT_ROWS, leaf_rows: int = LEAF_ROWS) -> Index:
    """The index of all rows of ``vectors`` (vec_id, embedding) that take part; see ``valid``.

    The tree is fitted on about ``fit_rows`` distinct vectors, taken by their hash.
    """
    read = valid(vectors)
    size = read.agg(F.approx_count_distinct(F.xxhash64("vec")).alias("n"), F.max(F.size("vec")).alias("dim")).first()
    dim = int(size.dim or 1)
    sample = read.filter(about(fit_rows, int(size.n * 1.05), F.col("vec"))).select(F.xxhash64("vec").alias("h"), "vec").dropDuplicates(["h"])
    x = sample.toArrow().sort_by("h")
    tree = build_tree(_matrix(x.column("vec"), dim), leaf_rows)
    kind = read.schema["vec"].dataType.simpleString()

    def assign(batches):
        for b in batches:
            if b.num_rows:
                leaf = pa.array(tree.assign(_matrix(b.column("vec"), dim)), pa.int32())
                yield pa.RecordBatch.from_arrays([leaf, *b.columns], ["leaf", "vec_id", "vec"])

    rows = kept(read.mapInArrow(assign, f"leaf int, vec_id {read.schema['vec_id'].dataType.simpleString()}, vec {kind}"))
    sizes = {r.leaf: r.n for r in rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    return Index(tree, dim, rows, sizes)


def calibrate(index: Index, queries: DataFrame, k: int = 10, recall: float = 0.97, sample: int = CALIBRATION_QUERIES) -> tuple[int, float]:
    """How many leaves a query visits so that ``recall`` of the true neighbours are found, and the share then found.

    Some ``sample`` of the queries (vec_id, vec) are compared with all rows, exactly.
    """
    n = queries.count()
    some = queries.filter(about(sample, n, F.col("vec_id"), F.col("vec"))).toArrow().sort_by("vec_id")
    q, q_ids = _matrix(some.column("vec"), index.dim), np.asarray(some.column("vec_id"), np.int64)
    dim = index.dim
    if not len(q):
        return max(index.tree.leaves, 1), 1.0

    def scan(batches):
        held = None
        for b in batches:
            x, ids, leaf = _matrix(b.column("vec"), dim), np.asarray(b.column("vec_id"), np.int64), np.asarray(b.column("leaf"))
            for start in range(0, len(x), BLOCK_ROWS):
                cut = slice(start, start + BLOCK_ROWS)
                which, row, d = _nearest(q, q_ids, x[cut], ids[cut], k)
                new = np.rec.fromarrays([which, d, ids[cut][row], leaf[cut][row]], names="q,d,id,leaf")
                held = new if held is None else np.concatenate((held, new))
                held = held[np.lexsort((held["id"], held["d"], held["q"]))]
                place = np.arange(len(held)) - np.searchsorted(held["q"], held["q"])
                held = held[place < k]
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(held[c])) for c in ("q", "d", "id", "leaf")], ["q", "d", "id", "leaf"])

    near = index.rows.mapInArrow(scan, "q long, d double, id long, leaf int")
    order = Window.partitionBy("q").orderBy("d", "id")
    true = near.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).select("q", "leaf").collect()
    rank = [{leaf: i for i, leaf in enumerate(index.tree.best_first(one, index.tree.leaves))} for one in q]
    after = np.sort([rank[r.q][r.leaf] for r in true])
    visits, found = 1, 1.0 if not len(after) else 0.0
    while len(after):
        found = float(np.searchsorted(after, visits) / len(after))
        if found >= recall or visits >= index.tree.leaves:
            break
        visits += 1
    return visits, found


def search(index: Index, queries: DataFrame, visits: int, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest rows in the leaves it visits, nearest first.

    ``queries`` has (vec_id, vec) like the index's rows. A row with a query's id is its own
    and no candidate. Ties go to the smaller vec_id; repeated rows are candidates as often as
    they occur, but a query that repeats in id and vector is asked once. A query without any
    candidate has no row.
    """
    dim, tree = index.dim, index.tree
    kind = queries.schema["vec"].dataType.simpleString()

    def visit(batches):
        for b in batches:
            if b.num_rows:
                opened = [tree.best_first(x, visits) for x in _matrix(b.column("vec"), dim)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(opened, pa.list_(pa.int32()))], ["qk", "query_id", "vec", "leaves"])

    asked = queries.select(F.xxhash64("vec_id", "vec").alias("qk"), F.col("vec_id").cast("long").alias("query_id"), "vec").dropDuplicates(["qk"])
    opened = kept(asked.mapInArrow(visit, f"qk long, query_id long, vec {kind}, leaves array<int>"))
    each = opened.select("qk", "query_id", "vec", F.explode("leaves").alias("leaf"))
    visitors = {r.leaf: r.n for r in each.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    cuts = [(leaf, -(-index.sizes[leaf] // BLOCK_ROWS), -(-n // BLOCK_QUERIES)) for leaf, n in visitors.items() if leaf in index.sizes]
    # one row for each leaf of the tree, so of bounded size
    cuts = F.broadcast(queries.sparkSession.createDataFrame(cuts, "leaf int, r long, c long"))
    rows = index.rows.join(cuts, "leaf").select(
        "leaf", F.pmod(F.xxhash64("vec_id"), "r").alias("rb"), F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("cb"), "vec_id", "vec")
    ask = each.join(cuts, "leaf").select(
        "leaf", F.explode(F.sequence(F.lit(0), F.col("r") - 1)).alias("rb"), F.pmod("qk", "c").alias("cb"), "qk", "query_id", "vec")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        q_ids, ids = np.asarray(left.column("query_id"), np.int64), np.asarray(right.column("vec_id"), np.int64)
        which, row, d = _nearest(_matrix(left.column("vec"), dim), q_ids, _matrix(right.column("vec"), dim), ids, k)
        return pa.table({"qk": np.asarray(left.column("qk"), np.int64)[which], "query_id": q_ids[which], "vec_id": ids[row], "score": d})

    block = ["leaf", "rb", "cb"]
    near = ask.groupBy(*block).cogroup(rows.groupBy(*block)).applyInArrow(meet, "qk long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id", "qk").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
