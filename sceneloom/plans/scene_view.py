"""Scene tables derived by Spark from the driver's tables.

The given data has no video. These views read ``events`` and ``embeddings`` as
detections, points, questions and so on, at every scale factor; the oracle SQL
states the same derivations (see ``scene_sql``).
"""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneloom.session import ensure_checkpoint_dir

RASTER = 64
N_FRAMES = 120
EPOCH_US = 1704067200000000
FRAME_US = 21600000000
#: Events to a task of what is derived from their videos: some twenty videos.
EVENTS_A_TASK = 20_000


def micros(ts: str = "ts") -> Column:
    """Microseconds since 1970 of a wall-clock timestamp, whatever the session zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


class SceneView:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def _tasks(self) -> int:
        """Tasks for what is derived from the events: as many as the input asks for, so that none grows with it."""
        return max(self.spark.sparkContext.defaultParallelism, math.ceil(self.table("events").count() / EVENTS_A_TASK))

    def spread(self, df: DataFrame, key: str) -> DataFrame:
        """One small input file is one task; what is derived from it need not be."""
        return df.repartition(self._tasks, key) if len(df.inputFiles()) < self._tasks else df

    @staticmethod
    def settle(df: DataFrame) -> DataFrame:
        """Materialise a costly table that a query reads more than once."""
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint()

    @cached_property
    def events(self) -> DataFrame:
        return self.spread(self.table("events"), "event_id")

    @cached_property
    def boxes_raw(self) -> DataFrame:
        """Detections with the rectangle their mask fills."""
        e, u = F.col("event_id"), F.col("user_id")
        return self.events.select(
            e.alias("det_seq"), F.expr("user_id div 15").alias("video_id"),
            micros().alias("_us"),
            F.col("event_type").alias("run_id"), u.alias("local_obj_id"),
            (F.col("value") / (F.col("value") + F.lit(10.0))).alias("score"),
            ((u * 5) % 40 + e % 4).cast("int").alias("y0"), ((u * 11) % 40 + (e * 3) % 4).cast("int").alias("x0"),
            (F.lit(8) + u % 12).cast("int").alias("bh"), (F.lit(8) + (u * 7) % 12).cast("int").alias("bw"),
        ).withColumn("frame_idx", F.expr(f"(_us - {EPOCH_US}) div {FRAME_US}")).drop("_us")

    @cached_property
    def detections(self) -> DataFrame:
        return self.boxes_raw.select("video_id", "frame_idx", "det_seq", "run_id", "local_obj_id", "score")

    def spans_of(self, boxes: DataFrame, *extra: str) -> DataFrame:
        side = F.lit(RASTER)
        return boxes.select(
            "video_id", "frame_idx", "det_seq", *extra,
            F.explode(F.sequence("y0", F.col("y0") + F.col("bh") - 1)).alias("v"),
            F.col("x0").alias("u0"), (F.col("x0") + F.col("bw")).alias("u1"), side.alias("h"), side.alias("w"))

    @cached_property
    def spans(self) -> DataFrame:
        return self.spans_of(self.boxes_raw, "run_id")

    @cached_property
    def best_boxes(self) -> DataFrame:
        from sceneloom.operators.detections import best_per_object
        return best_per_object(self.boxes_raw)

    @cached_property
    def videos(self) -> DataFrame:
        """A video becomes half a million pixels, but its id is few bytes, of which one task would get all otherwise."""
        return self.table("events").select(F.expr("user_id div 15").alias("video_id")).distinct().repartition(self._tasks, "video_id")

    def _frames(self, n: int, name: str) -> DataFrame:
        return self.videos.select("video_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias(name))

    @cached_property
    def frames(self) -> DataFrame:
        """120 processed frames per video: the camera moves along x."""
        zero, one = F.lit(0.0), F.lit(1.0)
        tx = F.lit(0.01) * F.col("frame_idx")
        return self._frames(N_FRAMES, "frame_idx").select(
            "video_id", "frame_idx", F.col("frame_idx").cast("double").alias("ts"),
            (F.col("video_id") % 2 == 0).alias("is_metric"),
            F.array(*[F.lit(x) for x in (500.0, 0.0, 32.0, 0.0, 500.0, 32.0, 0.0, 0.0, 1.0)]).alias("k"),
            F.array(one, zero, zero, tx, zero, one, zero, zero, zero, zero, one, zero, zero, zero, zero, one).alias("t_wc"))

    @cached_property
    def turning_frames(self) -> DataFrame:
        """Frames whose camera also turns, by whole-number rotations and a tilt."""
        # rows of R for quarter turns about the vertical axis and one 3-4-5 tilt
        turns = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in (
            (1, 0, 0, 0, 1, 0, 0, 0, 1), (0, 0, 1, 0, 1, 0, -1, 0, 0),
            (1, 0, 0, 0, .6, -.8, 0, .8, .6), (-1, 0, 0, 0, 1, 0, 0, 0, -1))])
        r = turns[(F.col("frame_idx") % 4).cast("int")]
        f = F.col("frame_idx").cast("double")
        t = [F.lit(0.5) * f, F.lit(-0.25) * f, F.lit(2.0) * (F.col("video_id") % 3)]
        z, one = F.lit(0.0), F.lit(1.0)
        pose = F.array(r[0], r[1], r[2], t[0], r[3], r[4], r[5], t[1], r[6], r[7], r[8], t[2], z, z, z, one)
        return self.frames.withColumn("t_wc", pose)

    def _lines(self) -> DataFrame:
        return self.frames.select("video_id", "frame_idx", F.explode(F.sequence(F.lit(0), F.lit(RASTER - 1))).alias("v"))

    def _conf_lines(self) -> DataFrame:
        """The 100 different confidence lines; line r serves all (17*v + frame) % 100 = r."""
        return F.broadcast(self.spark.range(100).select(F.col("id").alias("_r"), F.transform(
            F.sequence(F.lit(0), F.lit(RASTER - 1)),
            lambda u: (((u * 31 + F.col("id")) % 100) / F.lit(100.0)).cast("float")).alias("conf")))

    @cached_property
    def depth_rows(self) -> DataFrame:
        """Depth and confidence lines of every frame; depth is exact in single precision."""
        d = (F.lit(5.0) + F.col("v") / F.lit(64.0) * F.lit(0.5)).cast("float")
        lines = self._lines().withColumn("_r", (F.col("v") * 17 + F.col("frame_idx")) % 100)
        return lines.join(self._conf_lines(), "_r").select(
            "video_id", "frame_idx", "v", F.array_repeat(d, RASTER).alias("depth"), "conf")

    @cached_property
    def flawed_depth_rows(self) -> DataFrame:
        """The same lines with invalid depth strewn in, by (u + v + frame) % 97."""
        d = (F.lit(5.0) + (F.col("id") % 64) / F.lit(64.0) * F.lit(0.5)).cast("float")
        bad = lambda u: (u + F.floor(F.col("id") / 64)) % 97
        flawed = F.broadcast(self.spark.range(97 * 64).select(
            (F.col("id") % 64).cast("int").alias("v"), F.floor(F.col("id") / 64).alias("_q"),
            F.transform(F.sequence(F.lit(0), F.lit(RASTER - 1)), lambda u: F.when(bad(u) == 0, F.lit(float("nan")))
                        .when(bad(u) == 1, F.lit(0.0)).when(bad(u) == 2, F.lit(-1.0))
                        .when(bad(u) == 3, F.lit(float("inf"))).otherwise(d).cast("float")).alias("depth")))
        lines = (self._lines().withColumn("_r", (F.col("v") * 17 + F.col("frame_idx")) % 100)
                 .withColumn("_q", (F.col("v") + F.col("frame_idx")) % 97))
        return lines.join(self._conf_lines(), "_r").join(flawed, ["v", "_q"]).select(
            "video_id", "frame_idx", "v", "depth", "conf")

    @cached_property
    def manifest(self) -> DataFrame:
        """300 source frames per video at mixed rates; one more video has no rate."""
        rates = F.array(*[F.lit(x) for x in (24.0, 25.0, 29.97, 30.0, 60.0, 5.0)])
        src = self._frames(300, "source_idx").withColumn("fps", rates[(F.col("video_id") % 6).cast("int")])
        extra = self.videos.agg((F.max("video_id") + 1).alias("video_id")).select(
            "video_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(299).cast("bigint"))).alias("source_idx"),
            F.lit(0.0).alias("fps"))
        return src.unionByName(extra)

    @cached_property
    def points(self) -> DataFrame:
        """3D points read off the first three embedding values; the label is the frame."""
        return self.table("embeddings").select(
            F.lit(0).cast("bigint").alias("video_id"), F.col("label").cast("bigint").alias("frame_idx"),
            F.col("vec_id").alias("object_id"),
            *[(F.col("embedding")[i].cast("double") * F.lit(20.0)).alias(n) for i, n in enumerate("xyz")])

    @cached_property
    def qa(self) -> DataFrame:
        """Multiple-choice questions with one model response each."""
        return self.events.selectExpr(
            "event_id",
            "case when event_id % 4 < 3 then concat('real_mc_', 1 + event_id % 1371) "
            "else concat('synth_mc_', event_id) end as id",
            "case when event_id % 4 < 3 then 'real' else 'synthetic' end as split",
            "case when event_id % 4 = 3 and event_id % 5 = 0 then 'no' "
            "else element_at(array('left', 'right', 'forward', 'backward'), cast(1 + user_id % 4 as int)) end as answer",
            "map('A', 'left', 'B', 'right', 'C', 'forward', 'D', "
            "case when event_id % 4 = 3 and event_id % 5 = 0 then 'no' else 'backward' end) as choices",
            "case (event_id + event_id % 3) % 8 "
            "when 0 then concat('Therefore, the final answer is: ', substr('ABCD', cast(1 + (event_id div 8) % 4 as int), 1)) "
            "when 1 then substr('abcd', cast(1 + user_id % 4 as int), 1) "
            "when 2 then concat(substr('ABCD', cast(1 + user_id % 4 as int), 1), ') it moves') "
            "when 3 then concat('I pick option: ', substr('ABCD', cast(1 + user_id % 4 as int), 1)) "
            "when 4 then concat('it is (', substr('ABCD', cast(1 + user_id % 4 as int), 1), ')') "
            "when 5 then 'it is clearly moving right' "
            "when 6 then 'so D seems best' else 'unknown' end as response",
            "concat('Which way does object ', user_id, ' move?') as question",
            "case event_id % 3 when 0 then concat('https://media.example.org/data/videos_real/clip', user_id, '.mp4') "
            "when 1 then concat('https://cdn.example.org/x/videos_synthetic/s/clip', user_id, '.mp4?dl=1') "
            "else concat('https://elsewhere.example.org/clip', user_id, '.mp4') end as video")
