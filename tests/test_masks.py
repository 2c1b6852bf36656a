"""Masks, detections, boxes, tags on hand-computed cases."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sceneloom import schema
from sceneloom.operators import detections as D
from sceneloom.operators import masks as M


def mask(spark, *rects, h=64, w=64):
    """Several rectangles (det, y0, y1, x0, x1) in one frame."""
    return spark.createDataFrame([(0, 0, d, v, x0, x1, h, w) for d, y0, y1, x0, x1 in rects for v in range(y0, y1)], schema.SPANS)


def test_runs_of_a_dense_line(spark):
    lines = spark.createDataFrame([(0, 0, 0, 0, [True, True, False, True]), (0, 0, 0, 1, [False] * 4), (0, 0, 0, 2, [False, True, True, True])],
                                  "video_id long, frame_idx long, det_seq long, v int, bits array<boolean>")
    spans = M.mask_to_spans(lines)
    assert rows(spans, "v", "u0", "u1", "w") == [(0, 0, 2, 4), (0, 3, 4, 4), (2, 1, 4, 4)]
    assert rows(M.pixels_to_spans(M.spans_to_pixels(spans)), "v", "u0", "u1") == [(0, 0, 2), (0, 3, 4), (2, 1, 4)]


@pytest.mark.parametrize("tile", [3, 16, 64])
def test_iou(spark, tile):
    s = mask(spark, (0, 0, 10, 0, 10), (1, 0, 10, 5, 15), (2, 0, 10, 0, 10), (3, 40, 50, 40, 50))
    got = {(r.det_seq_a, r.det_seq_b): r.iou for r in M.mask_iou_pairs(s, tile=tile).collect()}
    assert got == {(0, 1): pytest.approx(1 / 3), (0, 2): 1.0, (1, 2): pytest.approx(1 / 3)}


def test_iou_only_between_runs(spark):
    s = mask(spark, (0, 0, 4, 0, 4), (1, 0, 4, 0, 4), (2, 0, 4, 0, 4)).withColumn(
        "run_id", F.when(F.col("det_seq") < 2, "a").otherwise("b"))
    got = M.mask_iou_pairs(s, differ="run_id")
    assert rows(got, "det_seq_a", "det_seq_b") == [(0, 2), (1, 2)]


def test_half_covered_cell_is_not_enough(spark):
    """4x4 cells of 4x4 pixels: half covered stays out, a pixel more is in."""
    s = mask(spark, (0, 0, 2, 0, 4), (1, 0, 3, 0, 3), h=16, w=16)
    assert rows(M.patch_cells(s, 4), "det_seq", "row", "col") == [(1, 0, 0)]


def test_last_cells_take_the_remainder(spark):
    s = mask(spark, (0, 0, 10, 0, 11), h=10, w=11)
    cells = {(r.row, r.col): r.iou for r in M.patch_cells(s, 3).collect()}
    assert len(cells) == 9 and set(cells.values()) == {1.0}


def test_mask_smaller_than_grid(spark):
    with pytest.raises(Exception, match="smaller than"):
        M.patch_cells(mask(spark, (0, 0, 2, 0, 2), h=8, w=8), 16).collect()


TAU = "array<struct<row:int,col:int,iou:double>>"


def test_top_tau_is_stable(spark):
    df = spark.createDataFrame([([(0, 0, 0.6), (0, 1, 0.9), (1, 0, 0.9), (1, 1, 0.7)],)], f"tau {TAU}")
    pick = lambda k: [(p.row, p.col) for p in df.select(M.top_tau(F.col("tau"), k).alias("t")).first().t]
    assert pick(2) == [(0, 1), (1, 0)]
    assert pick(0) == pick(9) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_jaccard(spark):
    df = spark.createDataFrame([([(0, 0, 1.0), (0, 1, 1.0)], [(0, 1, 5.0)], [])], f"a {TAU}, b {TAU}, c {TAU}")
    r = df.select(M.patch_jaccard(F.col("a"), F.col("b")).alias("x"), M.patch_jaccard(F.col("a"), F.col("c")).alias("y"),
                  M.patch_jaccard(F.col("c"), F.col("c")).alias("z")).first()
    assert (r.x, r.y, r.z) == (0.5, 0.0, 0.0)


def test_boxes(spark):
    b = spark.createDataFrame([(0, 0, i, s, *map(float, xy)) for i, (s, xy) in enumerate([
        (0.5, (-10, -10, 50, 50)), (0.9, (50, 50, 120, 90)), (0.7, (10, 10, 10, 40)), (0.7, (40, 40, 20, 60)), (0.8, (120, 0, 140, 10))])],
        "video_id long, frame_idx long, det_seq long, score double, x1 double, y1 double, x2 double, y2 double")
    got = D.ordered_boxes(D.clamp_boxes(b, 100, 100)).orderBy("rank").collect()
    assert [(r.det_seq, r.nx1, r.ny1, round(r.bw, 6), round(r.bh, 6)) for r in got] == [(1, 0.5, 0.5, 0.5, 0.4), (0, 0.0, 0.0, 0.5, 0.5)]


def test_class_names():
    assert D.parse_classes(" Person, car,person,,") == ["person", "car"]
    assert D.parse_classes(None) == []


def test_tags(spark):
    df = spark.createDataFrame([(" Cat | dog || CAT |",)], "t string")
    r = df.select(D.split_tags(F.col("t")).alias("a"), D.split_tags(F.col("t"), lower=False).alias("b")).first()
    assert (r.a, r.b) == (["cat", "dog"], ["Cat", "dog", "CAT"])


def test_discovery_threshold_is_inclusive_and_skips_frame_zero(spark):
    prop = mask(spark, (0, 0, 10, 0, 10), (1, 30, 40, 30, 40)).withColumn("frame_idx", F.lit(1).cast("long"))
    seen = mask(spark, (7, 0, 10, 7, 17)).withColumn("frame_idx", F.lit(1).cast("long"))  # shares 30 of 170
    assert rows(D.discover_new(prop, seen, 30 / 170), "det_seq", "px", "py") == [(1, 34.5, 34.5)]
    assert D.discover_new(prop, seen, 0.2).count() == 2
    assert D.discover_new(prop.withColumn("frame_idx", F.lit(0).cast("long")), seen).count() == 0


def test_best_keeps_the_first_of_equals(spark):
    det = spark.createDataFrame([(0, 0, i, "r", 1, s) for i, s in enumerate([0.4, 0.9, 0.9])], schema.DETECTIONS)
    assert rows(D.best_per_object(det), "det_seq") == [(1,)]


def test_missing_score_counts_as_zero(spark):
    det = spark.createDataFrame([(0, 0, 0, "r", 1, None), (0, 0, 1, "r", 2, 0.3)], schema.DETECTIONS)
    assert rows(D.filter_score(det, 0.3), "det_seq") == [(1,)]
    assert D.filter_score(det, 0.0).count() == 2


def test_ids_continue_the_numbering(spark):
    new = spark.createDataFrame([(0, 2, 5, 10), (0, 1, 6, 4), (0, 1, 7, 9)], "video_id long, frame_idx long, det_seq long, area long")
    old = spark.createDataFrame([(0, 3)], "video_id long, local_obj_id long")
    assert rows(D.assign_new_ids(new, old), "det_seq", "new_id") == [(5, 6), (6, 5), (7, 4)]


@pytest.mark.parametrize("tile, block", [(512, 1 << 14), (8, 40), (16, 7)])
def test_overlaps_equal_those_of_pixel_sets(spark, tile, block):
    """Ragged masks in several frames, one crowded; tiles and blocks change nothing, and no run meets by line in the plan."""
    rng = random.Random(3)
    table = [(0, f, d, v, u, u + rng.randint(-1, 5), 40, 40, rng.choice("xy") if d else None) for f, n in ((0, 12), (1, 3), (2, 1))
             for d in range(n) for v in rng.sample(range(30), 6) for u in rng.sample(range(0, 30, 7), 2)]
    runs = {r[:3]: rng.choice(["x", "y", None]) for r in table}
    table = [(*r[:8], runs[r[:3]]) for r in table]
    s = spark.createDataFrame(table, "video_id long, frame_idx long, det_seq long, v int, u0 int, u1 int, h int, w int, run_id string")
    pixels = {k: {(r[3], u) for r in table if r[:3] == k for u in range(r[4], r[5])} for k in runs}

    def want(keep):
        return sorted((p[1], p[2], q[2], len(pixels[p]), len(pixels[q]), len(pixels[p] & pixels[q])) for p in runs for q in runs
                      if p[:2] == q[:2] and keep(p, q) and pixels[p] & pixels[q])

    cols = ("frame_idx", "det_seq_a", "det_seq_b", "area_a", "area_b", "inter")
    assert rows(M.mask_iou_pairs(s, tile=tile, block=block), *cols) == want(lambda p, q: p[2] < q[2])
    got = M.mask_iou_pairs(s, differ="run_id", tile=tile, block=block)
    assert rows(got, *cols) == want(lambda p, q: p[2] < q[2] and None not in (runs[p], runs[q]) and runs[p] != runs[q])
    assert "(v" not in got._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    odd, even = s.filter("det_seq % 2 = 1"), s.filter("det_seq % 2 = 0")
    assert rows(M.mask_iou_cross(odd, even, tile, block), *cols) == want(lambda p, q: p[2] % 2 == 1 and q[2] % 2 == 0)


def test_packed_masks_pair_like_their_runs(spark):
    s = mask(spark, (0, 0, 10, 0, 10), (1, 0, 10, 5, 15), (2, 20, 30, 0, 10)).withColumn("run_id", F.col("det_seq").cast("string"))
    packed = M.pack_masks(s, True, "run_id")
    assert M.pack_masks(packed) is packed and packed.count() == 3
    assert rows(M.mask_iou_pairs(packed, "run_id")) == rows(M.mask_iou_pairs(s, "run_id")) == [(0, 0, 0, "0", 100, 1, "1", 100, 50, 1 / 3)]
