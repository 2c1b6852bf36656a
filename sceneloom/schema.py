"""Column contracts of the tables the operators exchange.

Masks travel as run-length rows: one row per raster line and run of set pixels,
half open ``[u0, u1)``. Depth travels as one row per raster line with the whole
line in an array, so that a pixel is only materialised inside the stage that
aggregates it.
"""

from __future__ import annotations

from pyspark.sql import types as T

FRAME = ["video_id", "frame_idx"]
DET = ["video_id", "frame_idx", "det_seq"]
KEY = ["video_id", "run_id", "local_obj_id"]

FRAMES = T.StructType([
    T.StructField("video_id", T.LongType()),
    T.StructField("frame_idx", T.LongType()),
    T.StructField("ts", T.DoubleType()),
    T.StructField("is_metric", T.BooleanType()),
    T.StructField("k", T.ArrayType(T.DoubleType())),      # 3x3, row major
    T.StructField("t_wc", T.ArrayType(T.DoubleType())),   # 4x4, row major, world to camera
])

MANIFEST = T.StructType([
    T.StructField("video_id", T.LongType()),
    T.StructField("source_idx", T.LongType()),
    T.StructField("fps", T.DoubleType()),
    T.StructField("path", T.StringType()),
])

DEPTH_ROWS = T.StructType([
    T.StructField("video_id", T.LongType()),
    T.StructField("frame_idx", T.LongType()),
    T.StructField("v", T.IntegerType()),
    T.StructField("depth", T.ArrayType(T.FloatType())),
    T.StructField("conf", T.ArrayType(T.FloatType())),    # null: every pixel is trusted
])

DETECTIONS = T.StructType([
    T.StructField("video_id", T.LongType()),
    T.StructField("frame_idx", T.LongType()),
    T.StructField("det_seq", T.LongType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("local_obj_id", T.LongType()),
    T.StructField("score", T.DoubleType()),
])

SPANS = T.StructType([
    T.StructField("video_id", T.LongType()),
    T.StructField("frame_idx", T.LongType()),
    T.StructField("det_seq", T.LongType()),
    T.StructField("v", T.IntegerType()),
    T.StructField("u0", T.IntegerType()),
    T.StructField("u1", T.IntegerType()),
    T.StructField("h", T.IntegerType()),                  # raster size, repeated so that no
    T.StructField("w", T.IntegerType()),                  # join is needed to normalise
])

QA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("video", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("choices", T.MapType(T.StringType(), T.StringType())),
    T.StructField("answer", T.StringType()),
])

PREDICTION = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("prediction", T.StringType()),
    T.StructField("ground_truth", T.StringType()),
    T.StructField("correct", T.BooleanType()),
    T.StructField("response", T.StringType()),
])

PREDICTION_FILE = T.StructType([
    T.StructField("config", T.MapType(T.StringType(), T.StringType())),
    T.StructField("predictions", T.ArrayType(PREDICTION)),
])

AXIS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("mu", "sigma", "min", "max")])
STEP = T.StructType([
    T.StructField("t", T.LongType()),
    T.StructField("tau", T.ArrayType(T.StructType([
        T.StructField("row", T.IntegerType()),
        T.StructField("col", T.IntegerType()),
        T.StructField("iou", T.DoubleType()),
    ]))),
    T.StructField("c", T.ArrayType(T.DoubleType())),
    T.StructField("s", T.StructType([T.StructField(a, AXIS) for a in "xyz"])),
    T.StructField("theta", T.ArrayType(T.LongType())),
])
SCENE = T.StructType([
    T.StructField("metadata", T.StructType([
        T.StructField("grid", T.StringType()),
        T.StructField("num_frames", T.LongType()),
        T.StructField("num_tracks", T.LongType()),
        T.StructField("coordinate_system", T.StringType()),
    ])),
    T.StructField("ego", T.ArrayType(T.StructType([
        T.StructField("t", T.LongType()),
        T.StructField("xyz", T.ArrayType(T.DoubleType())),
    ]))),
    T.StructField("tracks", T.ArrayType(T.StructType([
        T.StructField("object_id", T.LongType()),
        T.StructField("F_k", T.ArrayType(STEP)),
    ]))),
])
