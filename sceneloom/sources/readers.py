"""Reading frames, depth, questions, predictions and live observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sceneloom import schema
from sceneloom.functions.geometry import pose_to_4x4
from sceneloom.operators.evaluate import tag_split_by_file

#: Frames of a video that are written by one task.
STRETCH = 1024


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frame manifest with the time of each source frame; a frame without rate is at 0."""
    d = spark.read.schema(schema.MANIFEST).parquet(path)
    return frame_times(d)


def frame_times(manifest: DataFrame) -> DataFrame:
    return manifest.withColumn("ts", F.when(F.col("fps") > 0, F.col("source_idx") / F.col("fps")).otherwise(0.0))


def read_stills(spark: SparkSession, path: str) -> DataFrame:
    """Manifest of a folder of stills named <video>/<index>.<ext>; the bytes are not read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return d.select("path", "length",
                    F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("video"),
                    F.regexp_extract("path", r"([0-9]+)\.[^./]+$", 1).cast("bigint").alias("source_idx"))


def read_depth_rows(spark: SparkSession, path: str, columns: tuple[str, ...] = ("depth", "conf")) -> DataFrame:
    """Depth lines; a folder partitioned by video_id prunes to the videos asked for."""
    fields = [f for f in schema.DEPTH_ROWS.fields if f.name not in ("depth", "conf") or f.name in columns]
    # a partitioned folder would put its partition columns last
    return spark.read.schema(T.StructType(fields)).parquet(path).select(*[f.name for f in fields])


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """Frames whose pose may have 12 or 16 values."""
    return spark.read.schema(schema.FRAMES).parquet(path).withColumn("t_wc", pose_to_4x4(F.col("t_wc")))


def write_depth_rows(depth_rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Depth lines by video, each file sorted by frame and line so that scans prune.

    A video's lines are dealt by stretches of ``STRETCH`` frames: few files to a folder at any
    size, while a long video still goes to many tasks.
    """
    stretch = F.floor(F.col("frame_idx") / STRETCH)
    (depth_rows.repartition("video_id", stretch).sortWithinPartitions("video_id", "frame_idx", "v")
     .write.mode(mode).partitionBy("video_id").parquet(path))


def write_depth_table(depth_rows: DataFrame, table: str, buckets: int) -> None:
    """Depth lines bucketed by the key the lift joins on: the big side then never moves."""
    (depth_rows.write.mode("errorifexists").bucketBy(buckets, "video_id", "frame_idx", "v")
     .sortBy("video_id", "frame_idx", "v").saveAsTable(table))


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """Questions from JSON arrays; choice texts and answers become strings."""
    return spark.read.schema(schema.QA).option("multiLine", True).json(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """One row per prediction of result files, with the file's split and name."""
    d = tag_split_by_file(spark.read.schema(schema.PREDICTION_FILE).option("multiLine", True).json(path))
    d = d.withColumn("model", F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1))
    return d.select("model", "split", "split_known", F.explode("predictions").alias("p")).select(
        "model", "split", "split_known", "p.*")


def stream_observations(spark: SparkSession, path: str, row_schema: T.StructType, files_per_trigger: int = 16,
                        fmt: str = "parquet") -> DataFrame:
    """Rows of files as they arrive."""
    return (spark.readStream.schema(row_schema).option("maxFilesPerTrigger", files_per_trigger)
            .format(fmt).load(path))
