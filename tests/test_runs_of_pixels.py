"""Runs of pixels through words of bits."""

import random

from conftest import rows

from sceneloom.operators import masks as M


def test_runs_cross_words_and_copies_count_once(spark):
    rng = random.Random(1)
    at = {(d, v): sorted(set(rng.sample(range(-40, 140), 90)) | {31, 32, 63, 64}) for d in range(2) for v in range(3)}
    px = [(0, 0, d, v, u) for (d, v), us in at.items() for u in us for _ in range(1 + u % 2)]
    rng.shuffle(px)
    df = spark.createDataFrame(px, "video_id long, frame_idx long, det_seq long, v int, u int").repartition(3)
    want = []
    for (d, v), us in at.items():
        for u in us:
            if u - 1 not in us:
                end = u
                while end in us:
                    end += 1
                want.append((0, 0, d, v, u, end))
    out = M.pixels_to_spans(df)
    assert rows(out, "video_id", "frame_idx", "det_seq", "v", "u0", "u1") == sorted(want)
    assert dict(out.dtypes)["u0"] == dict(out.dtypes)["u1"] == "int"


def test_no_pixel_row_is_shuffled(spark):
    px = spark.range(64 * 50).selectExpr("0L video_id", "0L frame_idx", "0L det_seq", "cast(id div 64 as int) v", "cast(id % 64 as int) u")
    plan = M.pixels_to_spans(px)._jdf.queryExecution().executedPlan().toString()
    moved = plan[:plan.index("bit_or")] if "bit_or" in plan else plan
    assert "partial_bit_or" in plan and "Window" not in moved
