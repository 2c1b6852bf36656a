"""Scenes built while frames arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sceneloom.operators.chains import chain_ends
from sceneloom.operators.fuse import EpisodeFold, Life
from sceneloom.operators.tracks import ARCHIVE, LOST
from sceneloom.schema import DET, FRAME


def clean_arrivals(stream: DataFrame, delay: str = "1 minute", keys: tuple[str, ...] = ("video_id", "frame_idx"),
                   ts: str = "event_ts") -> DataFrame:
    """Drop frames that arrive twice or too late."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def session_tracks(obs: DataFrame, lost: int = LOST, archive: int = ARCHIVE, fps: float = 10.0,
                   ts: str = "event_ts", keys: tuple[str, ...] = ("video_id", "local_obj_id")) -> DataFrame:
    """Object lives as sessions: a gap of lost+archive frame times ends one.

    A frame seen exactly one gap after the last still belongs, so with evenly
    spaced frames this equals the frame-counting rule. Works on streams and tables.
    """
    gap_us = round((lost + archive) * 1e6 / fps)
    w = F.session_window(ts, f"{gap_us} microseconds")
    return (obs.groupBy(*keys, w).agg(F.min("frame_idx").alias("t_start"), F.max("frame_idx").alias("t_end"),
                                      F.count(F.lit(1)).alias("n_obs")).drop("session_window"))


def rolling_scene(obs: DataFrame, length: str, step: str, ts: str = "event_ts") -> DataFrame:
    """Size of the scene over a sliding stretch of time: frames, objects and observations."""
    w = F.window(ts, length, step)
    return (obs.groupBy("video_id", w).agg(F.size(F.collect_set("frame_idx")).cast("bigint").alias("frames"),
                                           F.count(F.lit(1)).alias("observations"),
                                           F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"))
            .select("video_id", F.col("window.start").alias("window_start"), "frames", "observations",
                    "first_frame", "last_frame"))


SCENE_ROWS = ("kind string, video_id long, frame_idx long, det_seq long, object_id long, other_id long")
FRAME_ROWS = ("video_id long, frame_idx long, dets array<struct<det_seq:long,run_id:string,local_obj_id:long,"
              "score:double,mates:array<long>>>")


class SceneState(StatefulProcessor):
    """Fusion state of one video: owners of tracker objects, live ids, the frame count.

    Observations leave with the id they have when they are made; a later merge leaves
    an ``alias`` row (object_id absorbed other_id). Nothing already emitted is kept,
    so the state is the live objects. A frame that is not after the last one leaves a
    ``late`` row and changes nothing.
    """

    def __init__(self, lost: int = LOST, archive: int = ARCHIVE, gap: int = 2):
        self.patience, self.gap = max(lost + archive, 1), gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.owners = handle.getMapState("owners", "run_id string, obj long", "gid long")
        self.lives = handle.getMapState("lives", "gid long", "seen long, at long")
        self.clock = handle.getValueState("clock", "frames long, last_frame long, next_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        video = int(key[0])
        frames = pd.concat(list(rows)).sort_values("frame_idx") if rows else pd.DataFrame()
        count, last, next_id = self.clock.get() if self.clock.exists() else (0, -1, 0)
        out: list = []
        frame_idx = 0

        def emit(kind, *what):
            if kind == "obs":
                out.append(("obs", video, frame_idx, what[0], what[1], None))

        fold = _LiveFold(self.patience, self.gap, emit, next_id)
        fold.load({(k[0], k[1]): v[0] for k, v in self.owners.iterator()},
                  {k[0]: Life(v[0], v[1], []) for k, v in self.lives.iterator()})
        owners, lives = dict(fold.owner), {g: (x.seen, x.at) for g, x in fold.lives.items()}
        for f in frames.itertuples(index=False):
            if f.frame_idx <= last:
                out.append(("late", video, int(f.frame_idx), None, None, None))
                continue
            last = frame_idx = int(f.frame_idx)
            dets = self.detections(f.dets)
            fold.frame(count, frame_idx, [
                (d["det_seq"], (d["run_id"], d["local_obj_id"]), d["score"],
                 tuple(d["mates"]) if d["mates"] is not None else ()) for d in dets])
            out += [("alias", video, frame_idx, None, keep, drop) for keep, drop in fold.drain()]
            count += 1
        fold.expire(count)
        self._save(fold, owners, lives)
        self.clock.update((count, last, fold.next_id))
        table = pd.DataFrame(out, columns=["kind", "video_id", "frame_idx", "det_seq", "object_id", "other_id"],
                             dtype=object)
        for c in table.columns[1:]:
            table[c] = table[c].astype("Int64")
        yield table

    def detections(self, raw) -> list:
        """A frame's detections in order."""
        return sorted(raw if raw is not None else [], key=lambda d: d["det_seq"])

    def _save(self, fold, owners, lives) -> None:
        for k in owners.keys() - fold.owner.keys():
            self.owners.removeKey(k)
        for k, gid in fold.owner.items():
            if owners.get(k) != gid:
                self.owners.updateValue(k, (gid,))
        for g in lives.keys() - fold.lives.keys():
            self.lives.removeKey((g,))
        for g, x in fold.lives.items():
            if lives.get(g) != (x.seen, x.at):
                self.lives.updateValue((g,), (x.seen, x.at))

    def close(self) -> None:
        pass


class _LiveFold(EpisodeFold):
    """The same rules with whole-number ids and an absorption log."""

    def __init__(self, patience: int, gap: int, emit, next_id: int):
        super().__init__(patience, gap, emit)
        self.next_id, self.log = next_id, []

    def fresh_id(self, _frame_idx, _det):
        self.next_id += 1
        return self.next_id - 1

    def _absorb(self, keep, drop) -> None:
        if drop in self.lives:
            self.log.append((keep, drop))
        super()._absorb(keep, drop)
        if keep in self.lives:
            self.lives[keep].members = []

    def _close(self, gid) -> None:
        self.lives.pop(gid)

    def load(self, owner: dict, lives: dict) -> None:
        """Go on from a saved state."""
        for key, gid in owner.items():
            self._own(key, gid)
        self.lives = lives
        self.sightings.extend(sorted((x.at, gid) for gid, x in lives.items()))

    def expire(self, at: int) -> None:
        """Forget what can't be seen again in frame ``at`` or later."""
        self._expire(at)

    def drain(self) -> list:
        log, self.log = self.log, []
        return log


def stream_scene(frames: DataFrame, lost: int = LOST, archive: int = ARCHIVE, gap: int = 2) -> DataFrame:
    """Observations and aliases of every video as its frames arrive.

    ``frames`` has one row per processed frame, FRAME_ROWS: also frames without
    detections, since they count as missed. Needs the RocksDB state store.
    """
    return frames.groupBy("video_id").transformWithStateInPandas(
        SceneState(lost, archive, gap), outputStructType=SCENE_ROWS, outputMode="Append", timeMode="None")


def frame_rows(candidates: DataFrame, gated: DataFrame, frames: DataFrame) -> DataFrame:
    """Candidates and gated pairs packed as FRAME_ROWS; a frame's detections bound each row."""
    pairs = gated.select(*FRAME, F.col("det_seq_a").alias("det_seq"), F.col("det_seq_b").alias("p")).unionByName(
        gated.select(*FRAME, F.col("det_seq_b").alias("det_seq"), F.col("det_seq_a").alias("p")))
    mates = pairs.groupBy(*DET).agg(F.array_sort(F.collect_list("p")).alias("mates"))
    dets = candidates.join(mates, DET, "left").groupBy(*FRAME).agg(
        F.array_sort(F.collect_list(F.struct("det_seq", "run_id", "local_obj_id", "score", "mates"))).alias("dets"))
    return frames.select(*FRAME).join(dets, FRAME, "left")


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what has arrived so far, then stop; a later call goes on from the checkpoint."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    query = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()


def absorbed(aliases: DataFrame) -> DataFrame:
    """Where every absorbed id ended: root, and its path of absorptions below it.

    Paths in array order are the order of precedence: a keeper before what it
    absorbed, earlier absorptions before later ones. A chain of n absorptions takes log2(n) joins.
    """
    log = aliases.select("video_id", F.col("other_id").alias("node"), F.col("object_id").alias("up"),
                         F.array(F.struct("frame_idx", F.col("other_id").alias("gone"))).alias("path"))
    return chain_ends(log, ["video_id"]).withColumnRenamed("node", "object_id")


def relabel(observations: DataFrame, aliases: DataFrame) -> DataFrame:
    """Stream output in the batch view: every observation under the id it ended in,
    one per frame, the keeping side first."""
    d = observations.join(absorbed(aliases), ["video_id", "object_id"], "left")
    d = d.withColumn("root", F.coalesce("root", "object_id"))
    w = Window.partitionBy("video_id", "root", "frame_idx").orderBy(F.col("path").asc_nulls_first())
    return (d.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
            .select("video_id", F.col("root").alias("object_id"), "frame_idx", "det_seq"))
