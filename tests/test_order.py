"""Frames put in order while they arrive, and what comes too late."""

import time
import uuid

from pyspark.sql import functions as F

from sceneloom.session import ensure_checkpoint_dir
from sceneloom.sources.readers import stream_observations
from sceneloom.streaming import live, order


def test_frames_within_the_delay_come_in_order_and_later_ones_are_told(spark):
    base = f"{ensure_checkpoint_dir(spark)}/order-{uuid.uuid4().hex}"
    start = 1_700_000_000
    files = [[0, 30, 10], [500, 460], [450, 350, 480], [5000]]
    for seconds in files:
        df = spark.createDataFrame([(1, s, f"frame {s}", 0.1 * s) for s in seconds], "video_id long, frame_idx long, name string, x double")
        df.withColumn("event_ts", F.timestamp_seconds(F.lit(start) + F.col("frame_idx"))).coalesce(1).write.mode("append").parquet(f"{base}/in")
        time.sleep(0.05)
    stream = stream_observations(spark, f"{base}/in", spark.read.parquet(f"{base}/in").schema, files_per_trigger=1)
    live.run_to_end(order.in_order(stream, "100 seconds", "1000 seconds"), f"{base}/out", f"{base}/state")
    rows = spark.read.parquet(f"{base}/out").collect()
    assert [r.frame_idx for r in rows if r.late] == [350]
    held = sorted((r.seq, r.frame_idx) for r in rows if not r.late and r.frame_idx > 100)
    assert [f for _, f in held] == [450, 460, 480, 500] and {r.frame_idx for r in rows if not r.late} == {0, 10, 30, 450, 460, 480, 500}
    assert all(r.name == f"frame {r.frame_idx}" and r.x == 0.1 * r.frame_idx and r.event_ts.timestamp() == start + r.frame_idx for r in rows)


class _State:
    """A map or value state that counts what goes to the JVM."""

    calls = 0

    def __init__(self):
        self.held = {}

    def __getattr__(self, name):
        def call(*args):
            _State.calls += 1
            key = args[0] if len(args) > 1 or name in ("getValue", "containsKey", "removeKey") else ()
            return {"exists": lambda: () in self.held, "get": lambda: self.held[()], "update": lambda: self.held.update({(): args[-1]}),
                    "iterator": lambda: iter(list(self.held.items())), "getValue": lambda: self.held.get(key),
                    "containsKey": lambda: key in self.held, "removeKey": lambda: self.held.pop(key),
                    "updateValue": lambda: self.held.update({key: args[-1]})}[name]()
        return call


class _Handle:
    def getMapState(self, *args):
        return _State()

    def getValueState(self, *args):
        return _State()


def test_a_graph_over_batches_equals_a_recount_and_asks_the_state_seldom():
    import random

    import pandas as pd
    rng, length = random.Random(3), 4
    frames = []
    for f in range(60):
        ids = sorted(rng.sample(range(30), rng.randrange(0, 12))) if f % 7 else None
        edges = [{"a": a, "b": b} for a in ids for b in ids if a < b] if ids else None
        frames.append((f, ids, edges))
    p = order._Graph(length)
    p.init(_Handle())
    log, _State.calls = [], 0
    for part in range(0, 60, 15):
        pdf = pd.DataFrame(frames[part:part + 15], columns=["frame_idx", "nodes", "edges"], dtype=object)
        for out in p.handleInputRows((1,), iter([pdf]), None):
            log += [tuple(r) for r in out.itertuples(index=False)]
    assert _State.calls < 4 * (length + 6)
    graph = set()
    for f in range(60):
        for _, at, change, *part in log:
            if at == f:
                assert (tuple(part) in graph) == (change == "expire")
                (graph.add if change == "add" else graph.discard)(tuple(part))
        near = frames[max(0, f - length + 1):f + 1]
        want = {("node", n, -1) for _, ids, _ in near for n in ids or []} | {("edge", e["a"], e["b"]) for _, _, es in near for e in es or []}
        assert graph == want
