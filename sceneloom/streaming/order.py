"""Streams put in order, and object lives and scene graphs kept over the last frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sceneloom.functions.ordered import running_sum

_TIME = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _milliseconds(interval: str) -> int:
    unit = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}
    n, name = interval.split()
    return int(float(n) * unit[name.rstrip("s")])


class _Reorder(StatefulProcessor):
    """Rows of one key held until the watermark passes them.

    The stream's watermark trails by the delay and the grace, so that rows up to the grace
    too late still come through and can be told: what the watermark plus the grace has
    passed is late. A held row's timer is set the grace before its own time.
    """

    def __init__(self, grace_ms: int):
        self.grace = grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "at long, place long, n long", "payload string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() + self.grace if timerValues.getCurrentWatermarkInMs() > 0 else 0
        late = []
        for pdf in rows:
            for at, place, payload in zip(pdf["at_ms"], pdf["place_no"], pdf["payload"]):
                at, place = int(at), int(place)
                if at <= passed:
                    late.append(payload)
                    continue
                n = 0
                while self.held.containsKey((at, place, n)):
                    n += 1
                self.held.updateValue((at, place, n), (payload,))
                self.handle.registerTimer(at - self.grace)
        if late:
            yield self._table(key, late, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() + self.grace
        ready = sorted((tuple(k), v[0]) for k, v in self.held.iterator() if k[0] <= passed)
        for k, _ in ready:
            self.held.removeKey(k)
        if ready:
            yield self._table(key, [payload for _, payload in ready], False)

    @staticmethod
    def _table(key, payloads: list, late: bool) -> pd.DataFrame:
        return pd.DataFrame({"_payload": payloads, "_late": late, "_seq": range(len(payloads))})

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, delay: str = "1 minute", grace: str = "10 minutes", keys: tuple[str, ...] = ("video_id",),
             ts: str = "event_ts", place: str = "frame_idx") -> DataFrame:
    """The rows of a stream in order of time, then ``place``, for each key, with ``late`` and ``seq``.

    A row is held until the stream has gone ``delay`` further; ``seq`` is its place among
    those let go together. One that comes later than that is passed on at once as ``late``;
    beyond ``delay`` and ``grace`` Spark drops it. Needs the RocksDB state store.
    """
    wait = _milliseconds(delay) + _milliseconds(grace)
    kind = stream.schema
    rows = stream.withWatermark(ts, f"{wait} milliseconds").select(
        *keys, ts, F.unix_millis(ts).alias("at_ms"), F.col(place).cast("long").alias("place_no"), F.to_json(F.struct(*stream.columns), _TIME).alias("payload"))
    out = rows.groupBy(*keys).transformWithStateInPandas(
        _Reorder(_milliseconds(grace)), outputStructType="_payload string, _late boolean, _seq long", outputMode="Append", timeMode="EventTime")
    return out.select(F.from_json("_payload", kind, _TIME).alias("_row"), "_late", "_seq").select("_row.*", F.col("_late").alias("late"), F.col("_seq").alias("seq"))


LIFE_ROWS = "video_id long, object_id long, segment long, t_start long, t_end long, n_obs long"


class _Lives(StatefulProcessor):
    """Open lives of one video, counted in processed frames."""

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "object_id long", "segment long, t_start long, t_end long, last long, n_obs long")
        self.clock = handle.getValueState("clock", "frames long, last_frame long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows)).sort_values("frame_idx")
        count, last = self.clock.get() if self.clock.exists() else (0, -1)
        lives = {k[0]: list(v) for k, v in self.open.iterator()}
        touched, closed = set(), []
        for frame, objects in zip(frames["frame_idx"], frames["objects"]):
            frame = int(frame)
            if frame <= last:
                continue
            for obj in sorted({int(o) for o in (objects if objects is not None else [])}):
                life = lives.get(obj)
                if life is None:
                    lives[obj] = [0, frame, frame, count, 1]
                elif count - life[3] - 1 >= self.patience:
                    closed.append((obj, *life))
                    lives[obj] = [life[0] + 1, frame, frame, count, 1]
                else:
                    life[2], life[3], life[4] = frame, count, life[4] + 1
                touched.add(obj)
            last, count = frame, count + 1
        for obj in touched:
            self.open.updateValue((obj,), tuple(lives[obj]))
        self.clock.update((count, last))
        rows_out = [(int(key[0]), o, s, a, b, n) for o, s, a, b, _, n in closed] + [
            (int(key[0]), o, lives[o][0], lives[o][1], lives[o][2], lives[o][4]) for o in sorted(touched)]
        yield pd.DataFrame(rows_out, columns=["video_id", "object_id", "segment", "t_start", "t_end", "n_obs"])

    def close(self) -> None:
        pass


def stream_lives(frames: DataFrame, patience: int) -> DataFrame:
    """Object lives by counted frames: a life ends when its object misses ``patience`` processed frames, however far apart they are.

    ``frames`` has video_id, frame_idx and objects (array), also for frames without any. A life
    leaves a row in every batch that changed it; ``latest_lives`` takes the last. The state
    is one entry for each object of a video. Needs the RocksDB state store.
    """
    return frames.groupBy("video_id").transformWithStateInPandas(
        _Lives(patience), outputStructType=LIFE_ROWS, outputMode="Append", timeMode="None")


def latest_lives(log: DataFrame) -> DataFrame:
    """Each life once, as its last row has it."""
    last = F.max_by(F.struct("t_start", "t_end", "n_obs"), "n_obs").alias("_l")
    return log.groupBy("video_id", "object_id", "segment").agg(last).select("video_id", "object_id", "segment", "_l.*")


GRAPH_ROWS = "video_id long, frame_idx long, change string, kind string, a long, b long"


class _Graph(StatefulProcessor):
    """The nodes and edges that the last frames of one video showed."""

    def __init__(self, length: int):
        self.length = length

    def init(self, handle: StatefulProcessorHandle) -> None:
        # a ring of frames: what slot i last showed
        self.ring = handle.getMapState("ring", "slot long", "parts string")
        self.clock = handle.getValueState("clock", "frames long, last_frame long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows)).sort_values("frame_idx")
        count, last = self.clock.get() if self.clock.exists() else (0, -1)
        # read once for all frames of the batch, and written once: each look at the state is a message to the JVM
        ring = {k[0]: v[0] for k, v in self.ring.iterator()}
        shown: dict[tuple, int] = {}  # when each part of the graph was last shown; the ring tells
        for at in range(max(count - self.length, 0), count):
            shown.update(dict.fromkeys(_parts(ring.get(at % self.length, "")), at))
        touched, out = set(), []
        for frame, nodes, edges in zip(frames["frame_idx"], frames["nodes"], frames["edges"]):
            frame = int(frame)
            if frame <= last:
                continue
            now = {("node", int(n), -1) for n in (nodes if nodes is not None else [])}
            now |= {("edge", int(e["a"]), int(e["b"])) for e in (edges if edges is not None else [])}
            slot = count % self.length
            for part in sorted(now):
                if part not in shown:
                    out.append((frame, "add", *part))
                shown[part] = count
            for part in _parts(ring.get(slot, "")):
                if shown.get(part, count) <= count - self.length:
                    del shown[part]
                    out.append((frame, "expire", *part))
            ring[slot] = ";".join(f"{k},{a},{b}" for k, a, b in sorted(now))
            touched.add(slot)
            last, count = frame, count + 1
        for slot in touched:
            self.ring.updateValue((slot,), (ring[slot],))
        self.clock.update((count, last))
        yield pd.DataFrame([(int(key[0]), *row) for row in out], columns=["video_id", "frame_idx", "change", "kind", "a", "b"])

    def close(self) -> None:
        pass


def _parts(text: str) -> list[tuple[str, int, int]]:
    return [(k, int(a), int(b)) for k, a, b in (p.split(",") for p in text.split(";") if p)]


def rolling_graph(frames: DataFrame, length: int) -> DataFrame:
    """Changes of the scene graph of each video's last ``length`` frames, as frames arrive.

    ``frames`` has video_id, frame_idx, nodes (array of ids) and edges (array of (a, b)), also
    for frames without any. A node or edge is added with the frame that first shows it and
    expires with the frame by which none of the last ``length`` shows it. The state is a ring
    of ``length`` frames. Adds up to a frame less the expiries give the graph at that frame.
    """
    return frames.groupBy("video_id").transformWithStateInPandas(
        _Graph(length), outputStructType=GRAPH_ROWS, outputMode="Append", timeMode="None")


def graph_at(changes: DataFrame, frames: DataFrame) -> DataFrame:
    """(video_id, frame_idx, nodes, edges): the size of the graph after each frame, from the log of changes."""
    count = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.when(F.col("change") == "add", 1).otherwise(-1))), F.lit(0))
    step = changes.groupBy("video_id", "frame_idx").agg(count("node").alias("_n"), count("edge").alias("_e"))
    out = frames.select("video_id", "frame_idx").join(step, ["video_id", "frame_idx"], "left")
    for part, name in (("_n", "nodes"), ("_e", "edges")):
        out = running_sum(out, ["video_id"], "frame_idx", F.coalesce(part, F.lit(0)), name)
    return out.select("video_id", "frame_idx", "nodes", "edges")
