"""Identity fusion against a plain model of its rules, on random histories."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from sceneloom.operators import fuse
from sceneloom.operators.fuse import fuse_tracks
from sceneloom.sources.readers import stream_observations
from sceneloom.session import ensure_checkpoint_dir
from sceneloom.streaming import live


def model(frames, patience, gap):
    """One video. ``frames``: (frame_idx, [(det, key, score)], {frozenset of two dets}) ascending.

    Every track is a dict; statuses are counted frame by frame, ids are numbers.
    """
    ids, tracks, counter = {}, {}, 0
    for t, dets, gate in frames:
        of = []
        for _det, key, _score in dets:
            g = ids.get(key)
            if g is None or (g in tracks and tracks[g]["missed"] >= patience):
                g, counter = counter, counter + 1
                ids[key] = g
            of.append(g)
        group = {g: g for g in of}
        ranked = sorted(range(len(dets)), key=lambda i: (-dets[i][2], i))
        for a, i in enumerate(ranked):
            for j in ranked[a + 1:]:
                gi, gj = group[of[i]], group[of[j]]
                if gi == gj or frozenset((dets[i][0], dets[j][0])) not in gate:
                    continue
                si, sj = (tracks[g]["seen"] if g in tracks else t for g in (gi, gj))
                if abs(si - sj) <= gap:
                    group = {g: gi if r == gj else r for g, r in group.items()}
        for g in sorted(group):
            r = group[g]
            if r != g and g in tracks:
                old = tracks.pop(g)
                new = tracks.setdefault(r, {"obs": {}, "seen": old["seen"], "missed": old["missed"]})
                new["obs"] = {**old["obs"], **new["obs"]}
                new["seen"] = max(new["seen"], old["seen"])
                new["missed"] = min(new["missed"], old["missed"])
        ids = {k: group.get(g, g) for k, g in ids.items()}
        best = {}
        for i, (_det, _key, score) in enumerate(dets):
            r = group[of[i]]
            if r not in best or score > dets[best[r]][2]:
                best[r] = i
        for g, i in best.items():
            track = tracks.setdefault(g, {"obs": {}, "seen": t, "missed": 0})
            track["obs"][t] = dets[i][0]
            track["seen"], track["missed"] = t, 0
        for g, track in tracks.items():
            if g not in best:
                track["missed"] += 1
    return sorted((g, t, d) for g, track in tracks.items() for t, d in track["obs"].items())


def history(seed):
    """A random video: objects seen by several runs, absences, flickering gates, strided frames."""
    rnd = random.Random(seed)
    n, stride, det = rnd.randint(5, 60), rnd.choice([1, 1, 3]), 0
    objects, runs = rnd.randint(1, 5), rnd.randint(1, 4)
    there = {(r, o): rnd.random() < 0.7 for r in range(runs) for o in range(objects)}
    frames = []
    for f in range(n):
        dets = []
        for key in there:
            if rnd.random() < 0.2:
                there[key] = not there[key]
            if there[key]:
                for _ in range(2 if rnd.random() < 0.05 else 1):
                    dets.append((det, key, rnd.choice([0.3, 0.5, 0.7, 0.9])))
                    det += 1
        gate = set()
        for i, a in enumerate(dets):
            for b in dets[i + 1:]:
                same = a[1][1] == b[1][1]
                if a[1][0] != b[1][0] and rnd.random() < (0.6 if same else 0.03):
                    gate.add(frozenset((a[0], b[0])))
        frames.append((f * stride, dets, gate))
    return frames


def tables(spark, videos):
    cands, gates, frames = [], [], []
    for v, hist in videos.items():
        for t, dets, gate in hist:
            frames.append((v, t))
            cands += [(v, t, d, f"run{k[0]}", k[1], s) for d, k, s in dets]
            gates += [(v, t, *sorted(pair)) for pair in gate]
    return (spark.createDataFrame(cands, "video_id long, frame_idx long, det_seq long, run_id string, local_obj_id long, score double"),
            spark.createDataFrame(gates, "video_id long, frame_idx long, det_seq_a long, det_seq_b long"),
            spark.createDataFrame(frames, "video_id long, frame_idx long"))


@pytest.fixture(scope="module")
def world():
    return {v: history(v) for v in range(60)}


@pytest.mark.parametrize("lost,archive,gap,span", [(1, 1, 2, 4096), (2, 4, 100, 4096), (5, 30, 2, 4096), (1, 1, 2, 5), (2, 4, 100, 9), (5, 30, 2, 3)])
def test_fusion_equals_model(spark, world, lost, archive, gap, span):
    """Also with episodes cut into pieces of a few frames, folded at the same time."""
    got = fuse_tracks(*tables(spark, world), lost=lost, archive=archive, gap=gap, bucket=7, span=span).collect()
    want = [(v, *row) for v, hist in world.items() for row in model(hist, lost + archive, gap)]
    assert sorted((r.video_id, r.object_id, r.frame_idx, r.det_seq) for r in got) == sorted(want)


@pytest.mark.parametrize("limit", [5, 4096])
def test_episodes_fold_their_changes_only(spark, limit):
    """Histories with long unchanged stretches: the same result from fewer folded rows."""
    world = {}
    for v in range(12):
        hist = []
        rnd = random.Random(v)
        for _t, dets, gate in history(100 + v):
            for _ in range(rnd.choice([1, 1, 2, 3, 6])):
                hist.append((dets, gate))
        det, frames = 0, []
        for t, (dets, gate) in enumerate(hist):
            name = {d[0]: det + i for i, d in enumerate(dets)}
            frames.append((t, [(name[d], k, rnd.choice([0.3, 0.5, 0.9])) for d, k, _s in dets],
                           {frozenset(name[d] for d in pair) for pair in gate}))
            det += len(dets)
        world[v] = frames
    got = fuse_tracks(*tables(spark, world), lost=1, archive=2, bucket=limit).collect()
    want = [(v, *row) for v, hist in world.items() for row in model(hist, 3, 2)]
    assert sorted((r.video_id, r.object_id, r.frame_idx, r.det_seq) for r in got) == sorted(want)


def test_one_component_over_many_pieces(spark, monkeypatch):
    """One episode as long as its video: pieces are folded apart, few of them twice, and give the same rows."""
    rnd = random.Random(3)
    hist, det = [], 0
    for t in range(400):
        dets = [(det + i, (r, o), rnd.choice([0.4, 0.8])) for i, (r, o) in enumerate((r, o) for r in range(3) for o in range(2) if rnd.random() < 0.9)]
        det += 6
        gate = {frozenset((a[0], b[0])) for a in dets for b in dets if a[1][1] == b[1][1] and a[1][0] < b[1][0] and rnd.random() < 0.5}
        hist.append((t, dets, gate))
    folds = []
    plain = fuse._with_states
    monkeypatch.setattr(fuse, "_with_states", lambda rows, states: folds.append(rows.select("piece").distinct().count()) or plain(rows, states))
    got = fuse_tracks(*tables(spark, {7: hist}), lost=3, archive=30, span=20).collect()
    assert sorted((r.object_id, r.frame_idx, r.det_seq) for r in got) == model(hist, 33, 2)
    assert folds[0] == folds[-1] == 20 and len(folds) <= 6 and sum(folds[1:-1]) < 40


def test_stream_equals_batch(spark, world):
    cands, gates, frames = tables(spark, world)
    want = fuse_tracks(cands, gates, frames, lost=2, archive=4)
    rows = live.frame_rows(cands, gates, frames)
    base = f"{ensure_checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
    for lo in (0, 10, 30):
        hi = {0: 10, 10: 30, 30: 10 ** 6}[lo]
        rows.filter((F.col("frame_idx") >= lo) & (F.col("frame_idx") < hi)).coalesce(1).write.mode("append").parquet(f"{base}/in")
    # frames that arrive again are ignored
    rows.filter("frame_idx < 4").coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = stream_observations(spark, f"{base}/in", rows.schema, files_per_trigger=1)
    live.run_to_end(live.stream_scene(stream, 2, 4, 2), f"{base}/out", f"{base}/state")
    out = spark.read.parquet(f"{base}/out")
    got = live.relabel(out.filter("kind = 'obs'"), out.filter("kind = 'alias'"))
    key = lambda df: sorted((r.video_id, r.object_id, r.frame_idx, r.det_seq) for r in df.collect())
    assert key(got) == key(want)


def test_two_runs_one_object(spark):
    """Two runs see one object in one frame: one track, the better score's row."""
    hist = {0: [(0, [(0, (0, 0), 0.95), (1, (1, 0), 0.80)], {frozenset((0, 1))})]}
    got = fuse_tracks(*tables(spark, hist)).collect()
    assert [(r.object_id, r.det_seq) for r in got] == [(0, 0)]


def test_delayed_merge_keeps_the_keepers_row(spark):
    """Apart in frame 0, together in frame 1: one track whose frame 0 is the keeper's."""
    hist = {0: [(0, [(0, (0, 0), 0.9), (1, (1, 0), 0.8)], set()),
                (1, [(2, (0, 0), 0.6), (3, (1, 0), 0.9)], {frozenset((2, 3))})]}
    got = sorted((r.object_id, r.frame_idx, r.det_seq) for r in fuse_tracks(*tables(spark, hist)).collect())
    assert got == [(1, 0, 1), (1, 1, 3)]


def test_archived_object_gets_a_new_id(spark):
    hist = {0: [(t, [(t, (0, 0), 0.9)] if t in (0, 4) else [], set()) for t in range(5)]}
    got = sorted((r.frame_idx, r.object_id) for r in fuse_tracks(*tables(spark, hist), lost=1, archive=1).collect())
    assert got == [(0, 0), (4, 1)]


def test_fold_forgets_what_is_away():
    """Two new objects each frame for 5,000 frames: only those within reach are held."""
    from sceneloom.operators.fuse import EpisodeFold
    closed = []
    fold = EpisodeFold(2, 2, lambda kind, *what: closed.append(what[0]) if kind == "map" else None)
    most = 0
    for t in range(5000):
        rows = [(2 * t + k, ("r", 2 * t + k), 0.5, (2 * t + 1 - k,) if t % 3 == 0 else ()) for k in (0, 1)]
        fold.frame(t, t, rows)
        most = max(most, len(fold.lives), len(fold.owner), len(fold.owned), len(fold.sightings))
    fold.finish()
    assert most <= 8 and len(closed) == 5000 * 2 - 1667


def test_gate_of_no_candidate_and_no_patience(spark):
    """Pairs with detections that are no candidates are left out; an object seen in every frame keeps its id at lost+archive = 0."""
    c = spark.createDataFrame([(1, t, 10 * t + k, r, 5, 0.5) for t in range(6) for k, r in enumerate("ab") if (t, r) != (3, "b")],
                              "video_id long, frame_idx long, det_seq long, run_id string, local_obj_id long, score double")
    gate = spark.createDataFrame([(1, t, 10 * t, 10 * t + 1) for t in (2, 3)], "video_id long, frame_idx long, det_seq_a long, det_seq_b long")
    frames = spark.createDataFrame([(1, t) for t in range(6)], "video_id long, frame_idx long")
    got = fuse_tracks(c, gate, frames, lost=0, archive=0).collect()
    assert sorted((r.object_id, r.frame_idx) for r in got) == [(0, t) for t in range(6)]
