"""Instance masks as run-length rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.functions.batches import column, plain, within
from sceneloom.schema import DET, FRAME
from sceneloom.session import ensure_checkpoint_dir, written

TILE = 512  # side of the squares that masks meet in
JOIN = "merge"
WORD = 32  # columns to a word of bits


def mask_to_spans(lines: DataFrame, bits: str = "bits") -> DataFrame:
    """Runs of a dense mask given as one ``array<boolean>`` per raster line.

    Row local: starts and ends are found inside the array, nothing is shuffled.
    """
    b = F.col(bits)
    n = F.size(b)
    idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    on = lambda i: F.coalesce(F.try_element_at(b, i + 1), F.lit(False))
    starts = F.filter(idx, lambda i: on(i) & ((i == 0) | ~on(F.greatest(i - 1, F.lit(0)))))
    ends = F.filter(idx, lambda i: on(i) & ((i == n - 1) | ~on(i + 1)))
    runs = F.arrays_zip(starts.alias("s"), F.transform(ends, lambda e: e + 1).alias("e"))
    keep = [c for c in lines.columns if c not in (bits, "w")]
    out = lines.select(*keep, n.alias("w"), F.explode(runs).alias("_run"))
    return out.select(*keep, "w", F.col("_run")["s"].alias("u0"), F.col("_run")["e"].alias("u1"))


def pixels_to_spans(pixels: DataFrame, keys: list[str] = DET) -> DataFrame:
    """Runs of pixel rows (keys, v, u): islands of consecutive u on each line.

    A task folds its pixels into words of 32 columns, one bit each, before anything is
    shuffled; the words of a line then meet in one row, which is bounded by the raster.
    """
    kind = pixels.schema["u"].dataType.simpleString()
    words = pixels.filter(F.col("u").isNotNull()).groupBy(*keys, "v", F.expr(f"cast(floor(u / {WORD}) as bigint)").alias("_w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(u, {WORD}) as int))")).alias("_bits"))
    lines = words.groupBy(*keys, "v").agg(F.array_sort(F.collect_list(F.struct("_w", "_bits"))).alias("_words"))
    lines = lines.select(*keys, "v", F.expr(
        f"flatten(transform(_words, w -> transform(filter(sequence(0, {WORD - 1}), i -> (shiftright(w._bits, i) & 1) = 1), "
        f"i -> cast(w._w * {WORD} + i as {kind}))))").alias("_us"))
    starts = F.filter("_us", lambda u, i: (i == 0) | (F.get("_us", i - 1) != u - 1))
    ends = F.filter("_us", lambda u, i: (i == F.size("_us") - 1) | (F.get("_us", i + 1) != u + 1))
    runs = F.arrays_zip(starts.alias("u0"), F.transform(ends, lambda u: (u + 1).cast(kind)).alias("u1"))
    return lines.select(*keys, "v", F.inline(runs))


def spans_to_pixels(spans: DataFrame) -> DataFrame:
    keep = [c for c in spans.columns if c not in ("u0", "u1")]
    return spans.filter("u1 > u0").select(*keep, F.explode(F.sequence("u0", F.col("u1") - 1)).alias("u"))


def mask_stats(spans: DataFrame, keys: list[str] = DET) -> DataFrame:
    """Area and mean (row, col) of each mask, without expanding a pixel."""
    n = (F.col("u1") - F.col("u0")).cast("bigint")
    # u0 + ... + (u1-1) is half of n*(u0+u1-1); the factor stays in until the division
    return (spans.groupBy(*keys)
            .agg(F.sum(n).alias("area"), F.sum(F.col("v") * n).alias("_sv"),
                 F.sum((F.col("u0") + F.col("u1") - 1) * n).alias("_su2"))
            .select(*keys, "area",
                    F.when(F.col("area") > 0, F.col("_sv") / F.col("area")).otherwise(0.0).alias("row_mean"),
                    F.when(F.col("area") > 0, F.col("_su2") / (F.col("area") * 2)).otherwise(0.0).alias("col_mean")))


def mask_bbox(spans: DataFrame, keys: list[str] = DET) -> DataFrame:
    """Normalised x, y, w, h of each mask's bounding box."""
    return (spans.filter("u1 > u0").groupBy(*keys)
            .agg(F.min("u0").alias("_l"), F.max("u1").alias("_r"), F.min("v").alias("_t"),
                 F.max("v").alias("_b"), F.first("h").alias("_h"), F.first("w").alias("_w"))
            .select(*keys, (F.col("_l") / F.col("_w")).alias("x"), (F.col("_t") / F.col("_h")).alias("y"),
                    ((F.col("_r") - F.col("_l")) / F.col("_w")).alias("bw"),
                    ((F.col("_b") - F.col("_t") + 1) / F.col("_h")).alias("bh")))


def pack_masks(spans: DataFrame, size: bool = False, *more: str) -> DataFrame:
    """Each mask as one row, DET and ``runs`` (v, u0, u1), bounded by the raster; with ``size`` also its h and w.

    ``more`` columns come along. Masks that are packed already pass, so a caller that needs them twice packs once.
    """
    if "runs" in spans.columns:
        return spans
    sizes = [F.first(c).alias(c) for c in ("h", "w")] if size else []
    run = F.struct(*[F.col(c).cast("int").alias(c) for c in ("v", "u0", "u1")])
    return spans.filter("u1 > u0 and v is not null").groupBy(*DET, *more).agg(F.collect_list(run).alias("runs"), *sizes)


def _boxed(spans: DataFrame, cols: list[str], tile: int, heavy: DataFrame | None) -> DataFrame:
    """Each mask as one row (its area and runs, bounded by the raster), copied to the tiles that its box touches.

    ``heavy`` names frames with more runs than one task should take; there the masks are dealt
    into blocks.
    """
    packed = pack_masks(spans, False, *cols[1:])
    least = lambda c: F.array_min(F.transform("runs", lambda r: r[c]))
    most = lambda c: F.array_max(F.transform("runs", lambda r: r[c]))
    area = F.aggregate("runs", F.lit(0).cast("bigint"), lambda n, r: n + (r["u1"] - r["u0"]))
    packed = packed.select(*FRAME, *cols, area.alias("area"), "runs", *[F.floor(x / tile).cast("int").alias(n) for n, x in (
        ("_t", least("v")), ("_b", most("v")), ("_l", least("u0")), ("_r", most("u1") - 1))])
    cut = packed.withColumn("ty", F.explode(F.sequence("_t", "_b"))).withColumn("tx", F.explode(F.sequence("_l", "_r"))).drop("_t", "_b", "_l", "_r")
    if heavy is None:
        return cut.withColumns({"_block": F.lit(0), "_blocks": F.lit(1)})
    cut = cut.join(heavy, FRAME, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    return cut.withColumn("_block", F.pmod(F.xxhash64("det_seq"), F.col("_blocks")).cast("int"))


#: Runs of one tile that meet as a block, and pairs that are looked at together.
_BLOCK = 1 << 14
_AT_ONCE = 1 << 19
_BOTH, _A, _B = 0, 1, 2  # side of a mask in a block that meets itself, or another
_GROUP = [*FRAME, "ty", "tx", "_i", "_j"]


def _heavy(spans: DataFrame, block: int) -> DataFrame | None:
    """Frames with more runs than a block, and how many blocks they take; usually there are none."""
    many = spans.groupBy(*FRAME).agg(F.sum("_n").alias("_n")).filter(F.col("_n") > block)
    heavy = written(many.select(*FRAME, F.ceil(F.col("_n") / F.lit(block)).cast("int").alias("_blocks")))
    return None if heavy.isEmpty() else heavy


def _overlap(a: DataFrame, b: DataFrame | None, cols: list[str], differ: str | None, tile: int, block: int) -> DataFrame:
    """Pairs of masks of one frame that share pixels: of a, or of a and b.

    Masks are shuffled once, packed, and meet by tile in Arrow batches. A pair is judged in the
    tile where the boxes' overlap begins, so no partial result is left to add up.
    """
    spark = a.sparkSession
    ensure_checkpoint_dir(spark)
    size = lambda df: df.select(*FRAME, (F.size("runs") if "runs" in df.columns else F.lit(1)).cast("bigint").alias("_n"))
    heavy = _heavy(size(a) if b is None else size(a).unionByName(size(b)), block)

    def to_blocks(df: DataFrame, side: int, i: str, j: str) -> DataFrame:
        met = F.explode(F.expr(f"transform(sequence({i}, {j}), k -> {'struct(_block as i, k as j)' if side == _A else 'struct(k as i, _block as j)'})"))
        out = df.withColumn("_at", met).select(*FRAME, "ty", "tx", F.col("_at")["i"].alias("_i"), F.col("_at")["j"].alias("_j"), *cols, "area", "runs")
        return out.withColumn("_side", F.lit(side) if b is not None else F.when(F.col("_i") == F.col("_j"), _BOTH).otherwise(side))

    left = _boxed(a, cols, tile, heavy)
    if b is not None:
        rows = to_blocks(left, _A, "0", "_blocks - 1").unionByName(to_blocks(_boxed(b, cols, tile, heavy), _B, "0", "_blocks - 1"))
    elif heavy is None:
        rows = to_blocks(left, _A, "0", "0")
    else:
        later = left.filter("_block > 0")
        rows = to_blocks(left, _A, "_block", "_blocks - 1").unionByName(to_blocks(later, _B, "0", "_block - 1"))
    rows = rows.filter(" and ".join(f"{c} is not null" for c in FRAME))
    # dealt by a value of its own: see fuse, a shuffle by columns that the parts are dealt by might be left out
    rows = rows.withColumn("_deal", F.xxhash64(*_GROUP)).repartition("_deal").drop("_deal").sortWithinPartitions(*_GROUP, "_side")
    type_of = {c: a.schema[c].dataType.simpleString() for c in [*FRAME, *cols]} | {"area": "bigint"}
    fields = [f"{c} {type_of[c]}" for c in FRAME] + [f"{c}_{s} {type_of[c]}" for s in "ab" for c in [*cols, "area"]] + ["inter bigint"]

    one_set = b is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the last group so far
        for batch in batches:
            if not batch.num_rows:
                continue
            here = pa.Table.from_batches([batch])
            table = here if held is None else pa.concat_tables([held, here])
            key = np.stack([plain(table.column(c)) for c in _GROUP], axis=1)
            whole = int(np.flatnonzero((key != key[-1]).any(axis=1))[-1]) + 1 if (key[0] != key[-1]).any() else 0
            if whole:
                yield from _meet(table.slice(0, whole), key[:whole], cols, differ, tile, one_set)
            held = table.slice(whole)
        if held is not None:
            yield from _meet(held, np.stack([plain(held.column(c)) for c in _GROUP], axis=1), cols, differ, tile, one_set)

    total = rows.mapInArrow(run, ", ".join(fields))
    union = F.col("area_a") + F.col("area_b") - F.col("inter")
    return total.withColumn("iou", F.col("inter") / union)


def _meet(table: pa.Table, key: np.ndarray, cols: list[str], differ: str | None, tile: int, one_set: bool) -> Iterator[pa.RecordBatch]:
    """Pairs that share pixels among rows sorted by group and side."""
    rows = table.num_rows
    runs = column(table, "runs")
    many = plain(pc.list_value_length(runs))
    owner = np.repeat(np.arange(rows), many)
    flat = runs.flatten()
    v, u0, u1 = (plain(flat.field(i)) for i in range(3))
    order = np.lexsort((u0, v, owner))
    owner, v, u0, u1 = owner[order], v[order], u0[order], u1[order]
    at = np.cumsum(many) - many  # every mask has a run
    top, bottom = np.minimum.reduceat(v, at), np.maximum.reduceat(v, at)
    left, right = np.minimum.reduceat(u0, at), np.maximum.reduceat(u1, at)
    low = v.min()
    line = owner * (v.max() - low + 1) + (v - low)
    span = v.max() - low + 1
    group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).any(axis=1)]))
    end = np.searchsorted(group, group, side="right")
    side = plain(table.column("_side"))
    det = plain(table.column("det_seq"))
    me = np.arange(rows)
    # in a block that meets itself a mask meets those after it, else the side b of its group
    first_b = np.searchsorted(group * 3 + side, group * 3 + _B)
    begin = np.where(side == _BOTH, me + 1, first_b)
    mates = np.where(side == _B, 0, end - begin)
    kind = None
    if differ:
        kind = pc.fill_null(pc.dictionary_encode(column(table, differ)).indices, -1).to_numpy(zero_copy_only=False)
    ends = np.cumsum(mates)
    first = 0
    while first < rows:
        done = ends[first - 1] if first else 0
        last = max(int(np.searchsorted(ends, done + _AT_ONCE, side="right")), first + 1)
        n = mates[first:last]
        x = np.repeat(me[first:last], n)
        y = within(n) + np.repeat(begin[first:last], n)
        first = last
        y0, x0 = np.maximum(top[x], top[y]), np.maximum(left[x], left[y])
        near = (y0 <= np.minimum(bottom[x], bottom[y])) & (x0 < np.minimum(right[x], right[y])) & (y0 // tile == key[x, 2]) & (x0 // tile == key[x, 3])
        if one_set:
            near &= det[x] != det[y]
        if differ:
            near &= (kind[x] != kind[y]) & (kind[x] >= 0) & (kind[y] >= 0)
        x, y = x[near], y[near]
        for lo in range(0, len(x), _AT_ONCE // 16):
            yield from _shared(table, x[lo:lo + _AT_ONCE // 16], y[lo:lo + _AT_ONCE // 16], cols, det, one_set, (at, many, v - low, u0, u1, line, span))


def _shared(table: pa.Table, x: np.ndarray, y: np.ndarray, cols: list[str], det: np.ndarray, one_set: bool, runs: tuple) -> Iterator[pa.RecordBatch]:
    """The shared pixels of masks x and y, run by run."""
    at, many, v, u0, u1, line, span = runs
    n = many[x]
    pair = np.repeat(np.arange(len(x)), n)
    mine = within(n) + np.repeat(at[x], n)
    wanted = y[pair] * span + v[mine]
    lo, hi = np.searchsorted(line, wanted), np.searchsorted(line, wanted, side="right")
    n = hi - lo
    pair, mine, other = np.repeat(pair, n), np.repeat(mine, n), within(n) + np.repeat(lo, n)
    shared = np.maximum(np.minimum(u1[mine], u1[other]) - np.maximum(u0[mine], u0[other]), 0)
    inter = np.zeros(len(x), dtype=np.int64)
    np.add.at(inter, pair, shared)
    some = inter > 0
    if not some.any():
        return
    x, y, inter = x[some], y[some], inter[some]
    if one_set:
        swap = det[x] > det[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
    a, b = table.take(pa.array(x)), table.take(pa.array(y))
    out = {c: a.column(c) for c in FRAME}
    for s, part in (("a", a), ("b", b)):
        out |= {f"{c}_{s}": part.column(c) for c in [*cols, "area"]}
    out["inter"] = pa.array(inter)
    yield from pa.table(out).combine_chunks().to_batches()


def mask_iou_pairs(spans: DataFrame, differ: str | None = None, tile: int = TILE, block: int = _BLOCK) -> DataFrame:
    """Every overlapping pair of masks of one frame, with its IoU.

    Masks meet by tile, and in a crowded frame block by block, so it spreads over tasks;
    masks with disjoint boxes are never compared run by run (their IoU is 0).
    ``differ`` names a column of the spans that must not be equal, such as run_id. Masks may come packed.
    """
    return _overlap(spans, None, ["det_seq"] + ([differ] if differ else []), differ, tile, block)


def mask_iou_cross(left: DataFrame, right: DataFrame, tile: int = TILE, block: int = _BLOCK) -> DataFrame:
    """IoU of overlapping masks taken from two sets, side ``a`` and side ``b``."""
    return _overlap(left, right, ["det_seq"], None, tile, block)


def patch_cells(spans: DataFrame, grid: int = 16, threshold: float = 0.5, keys: list[str] = DET) -> DataFrame:
    """Grid cells covered more than ``threshold``: keys, row, col, iou.

    A run touches a range of columns of one cell row; its share of each follows
    from the borders, so pixels are never expanded. The last row and column take
    the remainder of the raster.
    """
    small = (F.col("h") < grid) | (F.col("w") < grid)
    checked = F.when(small, F.raise_error(F.lit(f"mask is smaller than the {grid}x{grid} grid"))
                     ).otherwise(F.col("h"))
    ch, cw = F.floor(F.col("h") / grid).cast("int"), F.floor(F.col("w") / grid).cast("int")
    top = F.lit(grid - 1)
    s = spans.filter("u1 > u0").withColumn("h", checked.cast("int"))
    s = s.select(*keys, "v", "u0", "u1", "h", "w", ch.alias("_ch"), cw.alias("_cw"))
    s = s.withColumn("row", F.least(F.floor(F.col("v") / F.col("_ch")).cast("int"), top))
    c0 = F.least(F.floor(F.col("u0") / F.col("_cw")).cast("int"), top)
    c1 = F.least(F.floor((F.col("u1") - 1) / F.col("_cw")).cast("int"), top)
    s = s.withColumn("col", F.explode(F.sequence(c0, c1)))
    x0 = F.col("col") * F.col("_cw")
    x1 = F.when(F.col("col") == top, F.col("w")).otherwise(x0 + F.col("_cw"))
    tall = F.when(F.col("row") == top, F.col("h") - F.col("row") * F.col("_ch")).otherwise(F.col("_ch"))
    part = F.least("u1", x1) - F.greatest("u0", x0)
    return (s.groupBy(*keys, "row", "col")
            .agg(F.sum(part.cast("bigint")).alias("_in"), F.first((tall * (x1 - x0)).cast("bigint")).alias("_area"))
            .select(*keys, "row", "col", (F.col("_in") / F.col("_area")).alias("iou"))
            .filter(F.col("iou") > threshold))


def patch_tokens(spans: DataFrame, grid: int = 16, threshold: float = 0.5, keys: list[str] = DET) -> DataFrame:
    """The cells of each mask as one row-major array (at most grid*grid entries)."""
    cells = patch_cells(spans, grid, threshold, keys)
    return cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row", "col", "iou"))).alias("tau"))


def top_tau(tau: Column, k: int) -> Column:
    """The k best covered cells, or the array untouched when it is short or k is 0."""
    if k <= 0:
        return tau
    ranked = F.array_sort(F.transform(
        tau, lambda p: F.struct((-p["iou"]).alias("o"), p["row"].alias("row"), p["col"].alias("col"),
                                p["iou"].alias("iou"))))
    best = F.transform(F.slice(ranked, 1, k),
                       lambda p: F.struct(p["row"].alias("row"), p["col"].alias("col"), p["iou"].alias("iou")))
    return F.when(F.size(tau) > k, best).otherwise(tau)


def token_codes(tau: Column) -> Column:
    """The cells of a token array as distinct whole numbers."""
    return F.array_distinct(F.transform(tau, lambda p: p["row"].cast("int") * 65536 + p["col"].cast("int")))


def codes_jaccard(a: Column, b: Column, both: Column | None = None) -> Column:
    """Shared share of two arrays of distinct numbers, ``both`` of them if that is known; an empty or missing side gives 0."""
    both = F.size(F.array_intersect(a, b)) if both is None else both
    empty = (F.coalesce(F.size(a), F.lit(0)) <= 0) | (F.coalesce(F.size(b), F.lit(0)) <= 0)
    return F.when(empty, F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def patch_jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token arrays by (row, col); an empty side gives 0."""
    return codes_jaccard(token_codes(a), token_codes(b))
