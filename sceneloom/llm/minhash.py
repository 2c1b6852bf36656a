"""Near duplicates: DartMinHash signatures, banded candidates, exact check, classes.

Darts are thrown at each element's region, a strip as wide as the element's weight. The
strip is cut into weight cells [0,1), [1,2), [2,4) ...; in a cell of width w the darts
arrive along the rank axis as a Poisson process of rate w, all from hashes of (element,
cell, arrival). A dart that lands within the weight goes to one of k coordinates, and each
coordinate keeps the dart of least rank. Two documents keep the same dart there with the
probability of their weighted Jaccard similarity. A document of total weight W needs darts
up to rank (k ln k + 2k) / W only; if a coordinate stays empty, the bound is doubled.

Similarity is that of the sets of five-word shingles by default (each distinct shingle
weighs 1); ``weighting="count"`` lets a shingle weigh as often as it occurs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneloom.llm.common import kept, packed, slices, text_key, unpacked
from sceneloom.llm.wordhash import distinct, mix, owners, shingles, words
from sceneloom.operators.components import components
from sceneloom.session import discard

_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Texts whose darts are thrown at a time.
_GROUP = 1024


def _unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


def dart_minhash(elements: np.ndarray, at: np.ndarray, weights: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Signatures (lists x k) of weighted sets; a set without weight gets zeros.

    ``elements`` holds the sets' members (64-bit) one set after the other, set i from
    ``at[i]``; ``weights`` their positive weights.
    """
    sets = len(at) - 1
    owner = owners(at)
    total = np.bincount(owner, weights, sets)
    signature = np.zeros((sets, k), np.uint64)
    best = np.full((sets, k), np.inf)
    bound = np.zeros(sets)
    some = total > 0
    bound[some] = (k * math.log(k) + 2 * k) / total[some]
    # one entry for each weight cell that an element reaches into
    cells = np.where(weights <= 1, 1, np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64) + 1)
    source = np.repeat(np.arange(len(elements)), cells)
    cell = np.arange(len(source)) - np.repeat(np.cumsum(cells) - cells, cells)
    low = np.where(cell == 0, 0.0, 2.0 ** (cell - 1))
    width = np.where(cell == 0, 1.0, low)
    base = mix(elements[source] + _GOLD * (cell + 64 * seed).astype(np.uint64))
    own, weight = owner[source], weights[source]
    partial = bool((weight < low + width).any())
    flat_best, flat_signature = best.reshape(-1), signature.reshape(-1)
    open_sets = np.flatnonzero(some)
    while len(open_sets):
        todo = np.zeros(sets, bool)
        todo[open_sets] = True
        live = np.flatnonzero(todo[own])
        rank = np.zeros(len(live))
        arrival = 0
        while len(live):
            # few strips with many darts each: several arrivals at once
            block = min(64, max(1, 8192 // len(live)))
            steps = (np.arange(arrival, arrival + block, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * _GOLD
            arrival += block
            gaps = -np.log(_unit(mix(base[live][:, None] + steps)))
            ranks = rank[:, None] + np.cumsum(gaps, axis=1) / width[live][:, None]
            near = ranks <= bound[own[live]][:, None]
            which, when = np.nonzero(near)
            from_cell, dart_rank = live[which], ranks[which, when]
            rank = ranks[near[:, -1], -1]
            live = live[near[:, -1]]
            dart = mix(base[from_cell] + steps[when] + _GOLD)
            if partial:
                place = low[from_cell] + width[from_cell] * _unit(mix(dart + _GOLD))
                hit = place < weight[from_cell]
                from_cell, dart_rank, dart = from_cell[hit], dart_rank[hit], dart[hit]
            slot = own[from_cell] * k + (dart % np.uint64(k)).astype(np.int64)
            np.minimum.at(flat_best, slot, dart_rank)
            won = dart_rank == flat_best[slot]
            flat_signature[slot[won]] = dart[won]
        open_sets = open_sets[np.isinf(best[open_sets]).any(axis=1)]
        bound[open_sets] *= 2
        best[open_sets] = np.inf
    return signature


def sketch(docs: DataFrame, bands: int = 32, rows: int = 5, words_each: int = 5, weighting: str = "set") -> DataFrame:
    """One row per document: id, key (of id and text), node, n, and the hashes of its bands.

    ``node`` is a fingerprint of the whole shingle set (with its weights): documents of one
    node are alike by definition. ``n`` is the number of distinct shingles. A text without
    any word has neither node nor bands.
    """
    k = bands * rows

    def run(batches):
        for part in slices(batches):
            found = distinct(*shingles(*words(part.column("text")), words_each))
            elements, at, times = found
            weight = times.astype(np.float64) if weighting == "count" else np.ones(len(times))
            n = np.diff(at)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(elements + (_GOLD if weighting == "set" else times.astype(np.uint64) * _GOLD)), dtype=np.uint64)))
            node = mix(total[at[1:]] - total[at[:-1]] + n.astype(np.uint64))
            band = np.zeros((len(n), bands), np.uint64)
            for start in range(0, len(n), _GROUP):
                end = min(start + _GROUP, len(n))
                a, b = at[start], at[end]
                signature = dart_minhash(elements[a:b], at[start:end + 1] - a, weight[a:b], k)
                h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (end - start, bands)).copy()
                for r in range(rows):
                    h = mix(h * _GOLD + signature[:, r::rows])
                band[start:end] = h
            empty = n == 0
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(n) + 1) * bands, pa.int32()), pa.array(band.reshape(-1).view(np.int64)), mask=pa.array(empty))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("key"), pa.array(node.view(np.int64), mask=empty), pa.array(n.astype(np.int32)), lists],
                ["id", "key", "node", "n", "bands"])

    read = docs.select(F.expr("try_cast(doc_id as long)").alias("id"), text_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    return read.mapInArrow(run, "id long, key long, node long, n int, bands array<long>")


def _bitmaps(elements: np.ndarray, at: np.ndarray) -> pa.ListArray:
    """A bitmap of each set as 64-bit words: at least four bits for each element, a power of two in all."""
    n = np.diff(at)
    bits = np.maximum(64, 4 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    begin = np.concatenate(([0], np.cumsum(bits)))
    own = owners(at)
    flags = np.zeros(begin[-1], np.uint8)
    flags[begin[own] + (mix(elements) & (bits[own] - 1).astype(np.uint64)).astype(np.int64)] = 1
    packed_bits = np.packbits(flags, bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array(begin // 64, pa.int32()), pa.array(packed_bits))


def shingle_sets(texts: DataFrame, words_each: int = 5) -> DataFrame:
    """(node, sh, bits): the distinct shingles of each text as 44-bit numbers, and a bitmap of them."""

    def run(batches):
        for part in slices(batches):
            elements, at, _ = distinct(*shingles(*words(part.column("text")), words_each))
            yield pa.RecordBatch.from_arrays(
                [part.column("node"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(elements.view(np.int64))), _bitmaps(elements, at)],
                ["node", "sh", "bits"])

    return texts.select("node", "text").mapInArrow(run, "node long, sh array<long>, bits array<long>")


def _differing(x: str, y: str) -> str:
    """How many bits two bitmaps differ in, the longer one folded to the other's length: no more than elements differ."""
    def folded(a, b):
        half = f"cast(size({a}) / 2 as int)"
        return f"if(size({a}) > size({b}), zip_with(slice({a}, 1, {half}), slice({a}, {half} + 1, {half}), (p, q) -> p | q), {a})"
    return f"aggregate(zip_with({folded(x, y)}, {folded(y, x)}, (p, q) -> bit_count(p ^ q)), 0, (s, d) -> s + d)"


def links(docs: DataFrame, sketches: DataFrame, threshold: float = 0.8, words_each: int = 5, leaders: int = 4) -> tuple[DataFrame, DataFrame]:
    """Verified pairs (a, b) of nodes that hold the classes together, and (node, label) of the linked nodes.

    Members of a bucket are first compared with a few leaders of the bucket only, so a
    group of m near copies costs some m comparisons, not m * m / 2. Leaders are drawn from
    the nodes that share most buckets with others: the least edited copies, to which the
    rest is most alike. What is then still in different classes of a bucket is compared
    pair by pair, however few bands it shares, but becomes a pair only if the bitmaps
    allow it: sets of n and m elements and a similarity of t or more differ in at most
    (n + m)(1 - t) / (1 + t) elements, and bitmaps never differ in more bits than that.
    For a threshold below 0.5 bitmaps are not used. Pairs are checked on the exact shingle sets.
    """
    nodes = kept(sketches.filter("node is not null").groupBy("node").agg(
        F.min("key").alias("key"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    banded = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    full = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1")
    multi = banded.join(full, "bucket")
    met = multi.groupBy("node").agg(F.sum("_m").alias("met"))
    multi = kept(multi.drop("_m").join(met, "node"))
    wanted = nodes.join(multi.select("node").distinct(), "node", "left_semi").select("node", "key")
    texts = docs.select(text_key(F.col("doc_id"), F.col("text")).alias("key"), "text").join(wanted, "key")
    sets = kept(shingle_sets(texts, words_each).dropDuplicates(["node"]))
    discard(nodes)
    near = "node <> other and least(n, n2) >= greatest(n, n2) * %r" % threshold
    ordered = [F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")]

    def check(pairs: DataFrame) -> DataFrame:
        both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("sh").alias("x")), "a")
                .join(sets.select(F.col("node").alias("b"), F.col("sh").alias("y")), "b"))
        same = F.size(F.array_intersect("x", "y"))
        return kept(both.select("a", "b", (same / (F.size("x") + F.size("y") - same) >= threshold).alias("ok")))

    def classes(linked: DataFrame) -> DataFrame:
        return components(linked.select(F.lit(0).alias("group"), "a", "b")).select("node", "label")

    first = [F.max(F.struct((F.col("met") * (3 + F.pmod(F.xxhash64(F.col("node"), F.lit(i)), F.lit(1000)) / 1000)).alias("o"), F.col("node").alias("other"), F.col("n").alias("n2"))) for i in range(leaders)]
    lead = multi.groupBy("bucket").agg(F.array(*first).alias("_l"))
    star = multi.join(lead, "bucket").select("node", "n", F.explode("_l").alias("_l")).select("node", "n", "_l.other", "_l.n2").filter(near)
    tested = check(star.select(*ordered).distinct())
    linked = tested.filter("ok").select("a", "b")
    labels = classes(linked)
    now = multi.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = now.groupBy("bucket").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).filter("_lo < _hi").select("bucket")
    now = kept(now.drop("met").join(mixed, "bucket").join(sets.select("node", "bits"), "node"))
    discard(multi)
    other = now.select("bucket", F.col("node").alias("other"), F.col("n").alias("n2"), F.col("label").alias("l2"), F.col("bits").alias("bits2"))
    apart = (F.col("node") < F.col("other")) & (F.col("label") != F.col("l2")) & F.expr(near)
    if threshold >= 0.5:
        apart &= F.expr(f"{_differing('bits', 'bits2')} <= (n + n2) * {(1 - threshold) / (1 + threshold) + 1e-9!r}")
    rest = now.alias("x").join(other.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & apart).select(*ordered).distinct()
    more = check(rest.join(tested.select("a", "b"), ["a", "b"], "left_anti"))
    discard(now, sets)
    more = more.filter("ok").select("a", "b")
    if more.isEmpty():
        return linked, labels
    linked = linked.unionByName(more)
    return linked, classes(linked)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = 32, rows: int = 5, words_each: int = 5,
                    sketches: DataFrame | None = None) -> DataFrame:
    """(doc_id, key, class_id, keeper, n_links) for every row of ``docs``.

    A class is a connected component of documents whose five-word shingle sets have a
    Jaccard similarity of ``threshold`` or more (found with a probability of 1 - 3e-6
    at the threshold itself, and more above it). ``class_id`` is its
    smallest doc_id; a document like no other, and one without words, is its own class.
    ``keeper`` is true for the row that stays: the smallest doc_id, then the smallest key.
    Rows without doc_id are never the keeper beside one that has it; a class of only such
    rows has a null class_id. Rows equal in doc_id and text share key and keeper. ``n_links``
    counts the checked links of the row's text to other texts that hold its class together.
    Empty tables give no row, texts of any length count whole, further columns are left out;
    a doc_id that is no number counts as null.
    """
    s = kept(sketch(docs, bands, rows, words_each)) if sketches is None else sketches
    linked, labels = links(docs, s, threshold, words_each)
    degree = linked.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    by_node = s.select("id", "key", "node").join(labels.join(degree, "node", "left"), "node", "left").select(
        "id", "key", F.coalesce("label", "node", "key").alias("cls"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    least = by_node.groupBy("cls").agg(F.min(F.struct(F.col("id").isNull(), F.col("id").alias("id"), F.col("key").alias("key"))).alias("_k"))
    return by_node.join(least, "cls").select(
        F.col("id").alias("doc_id"), "key", F.col("_k.id").alias("class_id"), (F.col("key") == F.col("_k.key")).alias("keeper"), "n_links")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class.

    Of rows equal in doc_id and text, but not elsewhere, the one of least hash stays.
    """
    kept_keys = near_duplicates(docs, **options).filter("keeper").select(F.col("key").alias("_k")).distinct()
    rows = packed(docs, _key=text_key(F.col("doc_id"), F.col("text")))
    stay = rows.join(kept_keys, F.col("_key") == F.col("_k"), "left_semi")
    return unpacked(stay.groupBy("_key").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")))
