"""Identity fusion across tracker runs.

Ids are given frame by frame, and each merge changes what later frames see, so a
video is a sequential problem. But two tracker objects influence each other only
through chains of mask pairs that pass the merge gate, and everything is
forgotten once all of them have been away long enough to be archived. So the
work is cut, with joins and windows, into independent *episodes*: a connected
component of tracker objects between two such absences. An object that never
meets another needs no sequence at all and is solved by gaps and runs. The rest
is folded episode by episode over rows of a few numbers each, in streams sorted
by frame, holding one frame and the live ids of one episode.

An episode may last a whole video. It is cut into pieces of ``span`` frames that
are folded at the same time, each as if nothing came before it. What a piece hands
on is its live ids, without names: when each was last seen and which tracker
objects it holds, oldest first. A piece whose predecessor hands on something else
than it started from is folded again, until nothing changes; as live ids depend on
little more than the last frames, that takes few rounds. A piece names what it was
given by place; names and absorptions are then followed through the pieces by
pointer doubling.

Global ids are the order of first use over the video; they are numbered at the
end from the (frame, detection) at which each id was allocated.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.functions import geometry as g
from sceneloom.functions.ordered import gap_segments, global_row_number, running_sum, with_previous
from sceneloom.operators.chains import chain_ends
from sceneloom.operators.components import components
from sceneloom.operators.tracks import ARCHIVE, LOST, frame_ordinals
from sceneloom.schema import DET, FRAME
from sceneloom.session import discard, ensure_checkpoint_dir, written

# Default merge gate.
IOU = 0.5
CENTROID_DIST = 2.0
TEMPORAL_GAP = 2
#: Frames of an episode that are folded in one piece.
SPAN = 4096


def merge_gate(pairs: DataFrame, obs: DataFrame, iou: float = IOU, dist: float = CENTROID_DIST) -> DataFrame:
    """Mask pairs of different runs that overlap and lie close enough to be one object.

    ``pairs`` comes from mask_iou_pairs over run_id. The temporal part of the gate
    depends on the ids and is judged in the fold.
    """
    c = obs.select(*DET, F.struct("cx", "cy", "cz").alias("c"))
    side = lambda s: c.select(*FRAME, F.col("det_seq").alias(f"det_seq_{s}"), F.col("c").alias(f"c_{s}"))
    near = (pairs.filter(F.col("iou") > iou)
            .join(side("a"), [*FRAME, "det_seq_a"]).join(side("b"), [*FRAME, "det_seq_b"]))
    d = g.distance([F.col("c_a")[f"c{x}"] for x in "xyz"], [F.col("c_b")[f"c{x}"] for x in "xyz"])
    return near.withColumn("centroid_dist", d).filter(F.col("centroid_dist") < dist).drop("c_a", "c_b")


@dataclass
class Life:
    """A live id."""

    seen: int          # frame index of the last sighting
    at: int            # its ordinal; missed frames count from here
    members: list = field(default_factory=list)  # ids merged into it, first in precedence first


class EpisodeFold:
    """Ids of one episode, frame by frame, over a few rows per frame.

    ``emit`` receives ("alloc", id), ("obs", det_seq, id) and, once an id can no
    longer change, ("map", id, root, precedence). An id that has been away for
    ``patience`` frames is closed and forgotten, so what is held are the live ids
    and their sightings of the last ``patience`` frames.
    """

    def __init__(self, patience: int, gap: int, emit):
        # only a missed frame can archive: an object seen in every frame lives on
        self.patience, self.gap, self.emit = max(patience, 1), gap, emit
        self.owner: dict = {}     # (run, object) -> id
        self.owned: dict = {}     # id -> its keys in owner
        self.lives: dict = {}     # id -> Life
        self.sightings: deque = deque()  # (ordinal, id), oldest first

    def frame(self, at: int, frame_idx: int, rows: list) -> None:
        """``rows``: (det_seq, key, score, partner det_seqs) in detection order."""
        self._expire(at)
        ids = [self._id_of(key, frame_idx, det) for det, key, _s, _p in rows]
        root = self._unite(frame_idx, rows, ids)

        def top(gid):
            while root.get(gid, gid) != gid:
                gid = root[gid]
            return gid

        for gid in sorted(set(ids)):
            keep = top(gid)
            if keep != gid:
                self._absorb(keep, gid)
                for key in self.owned.pop(gid, ()):
                    self._own(key, keep)
        best: dict = {}
        for row, gid in zip(rows, ids):
            held = best.get(top(gid))
            if held is None or row[2] > held[2]:
                best[top(gid)] = row
        for gid, row in best.items():
            life = self.lives.setdefault(gid, Life(frame_idx, at, [gid]))
            life.seen, life.at = frame_idx, at
            self.sightings.append((at, gid))
            self.emit("obs", row[0], gid)

    def hold(self, at: int, frame_idx: int, rows: list) -> None:
        """The frame just folded repeats unchanged up to ``at``: everyone is seen until then."""
        for key in dict.fromkeys(row[1] for row in rows):
            gid = self.owner[key]
            self.lives[gid].seen, self.lives[gid].at = frame_idx, at
            self.sightings.append((at, gid))
            self.emit("hold", key, gid)

    def take_over(self, state: list) -> None:
        """Start from the lives that an earlier piece handed on; they are named (-1, place)."""
        for place, (seen, at, keys) in enumerate(state):
            self.lives[-1, place] = Life(seen, at, [(-1, place)])
            for key in keys:
                self._own(tuple(key), (-1, place))
        self.sightings.extend(sorted((life.at, gid) for gid, life in self.lives.items()))

    def hand_on(self) -> tuple[list, list]:
        """The live ids, oldest first, and what a later piece needs to know of them."""
        ids = sorted(self.lives)
        return ids, [(self.lives[i].seen, self.lives[i].at, sorted(self.owned.get(i, ()))) for i in ids]

    def fresh_id(self, frame_idx: int, det: int):
        """Ids are named by the detection that first used them, and numbered at the end."""
        return (frame_idx, det)

    def _own(self, key, gid) -> None:
        self.owner[key] = gid
        self.owned.setdefault(gid, set()).add(key)

    def _expire(self, at: int) -> None:
        """Close the ids that were last seen more than ``patience`` frames before this one."""
        while self.sightings and at - self.sightings[0][0] - 1 >= self.patience:
            seen, gid = self.sightings.popleft()
            life = self.lives.get(gid)
            if life is not None and life.at == seen:
                for key in self.owned.pop(gid, ()):
                    del self.owner[key]
                self._close(gid)

    def _id_of(self, key, frame_idx: int, det: int):
        gid = self.owner.get(key)
        if gid is None:
            gid = self.fresh_id(frame_idx, det)
            self._own(key, gid)
            self.emit("alloc", gid)
        return gid

    def _unite(self, frame_idx: int, rows: list, ids: list) -> dict:
        """Merges of this frame, best score first; the better side's id stays the root."""
        root: dict = {}

        def top(gid):
            while root.get(gid, gid) != gid:
                gid = root[gid]
            return gid

        def seen(gid):
            return self.lives[gid].seen if gid in self.lives else frame_idx

        order = sorted(range(len(rows)), key=lambda i: -rows[i][2])
        rank = {rows[i][0]: r for r, i in enumerate(order)}
        for i in order:
            mine = top(ids[i])
            mates = sorted(rank[p] for p in rows[i][3] if rank[p] > rank[rows[i][0]])
            for other in (top(ids[order[r]]) for r in mates):
                # ``other`` is looked up lazily, after the merges before it
                if other != mine and abs(seen(mine) - seen(other)) <= self.gap:
                    root[other] = mine
        return root

    def _absorb(self, keep, drop) -> None:
        gone = self.lives.pop(drop, None)
        if gone is None:  # first used in this frame: a number is spent, nothing is inherited
            return
        life = self.lives.setdefault(keep, Life(gone.seen, gone.at, [keep]))
        life.seen, life.at = max(life.seen, gone.seen), max(life.at, gone.at)
        life.members = life.members + gone.members

    def _close(self, gid) -> None:
        for precedence, member in enumerate(self.lives.pop(gid).members):
            self.emit("map", member, gid, precedence)

    def finish(self) -> None:
        for gid in list(self.lives):
            self._close(gid)


_FIELDS = [("kind", "string"), ("video_id", "bigint"), ("label", "bigint"), ("_ep", "bigint"), ("piece", "bigint"),
           ("frame_idx", "bigint"), ("det_seq", "bigint"), ("gid_frame", "bigint"), ("gid_det", "bigint"), ("root_frame", "bigint"),
           ("root_det", "bigint"), ("precedence", "int"), ("stretch", "string"), ("run_id", "string"), ("local_obj_id", "bigint")]
_NUMBERS = [n for n, t in _FIELDS if t != "string"]
_FOLDED = ", ".join(f"{n} {t}" for n, t in _FIELDS)


def _fold_episodes(patience: int, gap: int, states_only: bool = False, emit_rows: int = 20000):
    """Folds a stream sorted by (episode, piece, frame, detection); holds one frame and one piece's live ids.

    A row with det_seq -1 comes before a piece's others and brings the state it starts
    from. ``states_only`` leaves out everything but what the pieces hand on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list = []
        frame_idx = at = piece = fold = until = None
        rows: list = []

        def put(kind, **what):
            out.append({"kind": kind, "video_id": piece[0], "label": piece[1], "_ep": piece[2], "piece": piece[3], **what})

        def emit(kind, *what):
            if states_only:
                return
            if kind == "hold":
                (run_id, obj), (f, d) = what
                put(kind, run_id=run_id, local_obj_id=obj, gid_frame=f, gid_det=d, stretch=until[0])
            elif kind == "map":
                (f, d), (root_f, root_d), precedence = what
                put(kind, gid_frame=f, gid_det=d, root_frame=root_f, root_det=root_d, precedence=precedence)
            elif kind == "obs":
                put(kind, gid_frame=what[1][0], gid_det=what[1][1], frame_idx=frame_idx, det_seq=what[0])
            else:
                put(kind, gid_frame=what[0][0], gid_det=what[0][1])

        def table() -> pd.DataFrame:
            # as objects: whole numbers beside nulls must not pass through floats
            pdf = pd.DataFrame([[row.get(n) for n, _t in _FIELDS] for row in out], columns=[n for n, _t in _FIELDS],
                               dtype=object)
            for n in _NUMBERS:
                pdf[n] = pdf[n].astype("Int64")
            out.clear()
            return pdf

        def flush():
            fold.frame(at, frame_idx, rows)
            if until is not None:
                fold.hold(until[1], until[2], rows)

        def leave():
            ids, state = fold.hand_on()
            if states_only:
                put("state", stretch=json.dumps(state))
            else:
                for place, (f, d) in enumerate(ids):
                    put("life", precedence=place, gid_frame=f, gid_det=d)
            fold.finish()

        for batch in batches:
            for v, label, ep, part, o, f, det, run_id, obj, score, mates, *rest in batch.itertuples(index=False, name=None):
                new_piece = (v, label, ep, part) != piece
                if rows and (new_piece or o != at):
                    flush()
                    rows = []
                if new_piece:
                    if fold is not None:
                        leave()
                    piece, fold = (v, label, ep, part), EpisodeFold(patience, gap, emit)
                if det == -1:
                    fold.take_over(json.loads(rest[3]))
                    continue
                at, frame_idx = o, f
                until = (rest[0], int(rest[1]), int(rest[2])) if rest[0] is not None else None
                rows.append((det, (run_id, obj), score, () if mates is None else mates))
            if len(out) >= emit_rows:
                yield table()
        if fold is not None:
            if rows:
                flush()
            leave()
        if out:
            yield table()

    return run


def _with_states(rows: DataFrame, states: DataFrame | None) -> DataFrame:
    """The rows of pieces, and before each the state (json) it starts from, dealt by piece and sorted."""
    names = [*_EPISODE, "piece", "ord", "frame_idx", "det_seq", "run_id", "local_obj_id", "score", "partners", "stretch", "end_ord", "end_frame"]
    rows = rows.select(*names, F.lit(None).cast("string").alias("state"))
    if states is not None:
        # no nulls in whole-number columns, which pandas would turn into floats
        blank = [F.lit(-1 if n in ("ord", "frame_idx", "det_seq", "local_obj_id") else None).cast(rows.schema[n].dataType).alias(n) for n in names[4:]]
        rows = rows.unionByName(states.select(*_EPISODE, "piece", *blank, "state"))
    by = [*_EPISODE, "piece"]
    # dealt by a value of its own: a shuffle by columns that both sides of a union are dealt by would be left
    # out, though adaptive execution may have merged their partitions in different ways
    return rows.withColumn("_deal", F.xxhash64(*by)).repartition("_deal").drop("_deal").sortWithinPartitions(*by, "ord", "det_seq")


def _settled_states(rows: DataFrame, patience: int, gap: int) -> DataFrame:
    """(episode, piece, state): what each piece but the first of its episode starts from.

    Every piece is folded from nothing; those that should have started from something else
    are folded again with what their predecessor handed on, and so on. Piece n is right
    after n rounds at the latest, and a round folds only the pieces whose start changed.
    """
    by = [*_EPISODE, "piece"]
    start = rows.select(*by).distinct().select(*by, F.lit("[]").alias("state"))
    todo, ran = start, written(start.withColumn("out", F.lit(None).cast("string")))
    while True:
        some = rows.join(todo.select(*by), by, "left_semi")
        new = _with_states(some, todo).mapInPandas(_fold_episodes(patience, gap, True), _FOLDED).select(*by, F.col("stretch").alias("_new"))
        after = written(ran.join(todo.select(*by, F.col("state").alias("_from")), by, "left").join(new, by, "left").select(
            *by, F.coalesce("_from", "state").alias("state"), F.coalesce("_new", "out").alias("out")))
        discard(ran)
        ran = after
        given = ran.select(*_EPISODE, (F.col("piece") + 1).alias("piece"), F.col("out").alias("_given"))
        todo = ran.join(given, by).filter("_given <> state").select(*by, F.col("_given").alias("state"))
        if todo.isEmpty():
            return ran.filter("piece > 0").select(*by, "state")


def _named(folded: DataFrame) -> DataFrame:
    """Rows of folded pieces with ids that were named by place given their own name, that of the detection that first used them."""
    place = lambda piece, f, d: F.struct(piece.alias("piece"), f.alias("f"), d.alias("d"))
    none = F.lit(-1).cast("bigint")
    own = place(F.when(F.col("gid_frame") == -1, F.col("piece")).otherwise(none), F.col("gid_frame"), F.col("gid_det"))
    links = folded.filter("kind = 'life'").select(
        *_EPISODE, place(F.col("piece") + 1, none, F.col("precedence").cast("bigint")).alias("node"), own.alias("up"), F.array().cast("array<int>").alias("path"))
    # one key for each named place: many equal columns in one condition would cost the planner more than the join
    key = lambda piece, at: F.concat_ws("/", *_EPISODE, piece, at)
    names = chain_ends(links, _EPISODE).select(key(F.col("node.piece"), F.col("node.d")).alias("_k"), F.col("root").alias("_name"))
    for c in ("gid", "root"):
        folded = folded.withColumn("_k", F.when(F.col(f"{c}_frame") == -1, key(F.col("piece"), F.col(f"{c}_det")))).join(names, "_k", "left").withColumns({
            f"{c}_frame": F.coalesce("_name.f", f"{c}_frame"), f"{c}_det": F.coalesce("_name.d", f"{c}_det")}).drop("_name", "_k")
    return folded.filter("kind <> 'life'")


_EPISODE = ["video_id", "label", "_ep"]


def _stretches(group: DataFrame, gate: DataFrame, bucket: int) -> DataFrame:
    """Rows of episodes with the stretch of unchanged frames they belong to.

    A stretch is a run of consecutive frames showing the same tracker objects with
    the same gated pairs. Its first frame may allocate and merge, its second may
    merge what a long absence held apart in the first; from the third on nothing
    can change, whatever the scores. Adds stretch, _idx (position), end_ord and
    end_frame.
    """
    key = F.struct("run_id", "local_obj_id")
    at = [*_EPISODE, "ord"]
    shown = group.groupBy(*at, "frame_idx").agg(F.sort_array(F.collect_list(key)).alias("_keys"))
    side = lambda s: group.select(*at, *FRAME[1:], F.col("det_seq").alias(f"det_seq_{s}"), key.alias(s))
    met = (gate.join(side("a"), [*FRAME, "det_seq_a"])
           .join(side("b").drop(*at[1:]), [*FRAME, "det_seq_b"])
           .groupBy(*at).agg(F.sort_array(F.collect_list(F.struct(F.least("a", "b"), F.greatest("a", "b")))).alias("_met")))
    d = shown.join(met, at, "left").select(
        *at, "frame_idx", F.md5(F.to_json(F.struct("_keys", "_met"))).alias("_sig"))
    d = with_previous(d.withColumn("_cur", F.struct("ord", "_sig")), _EPISODE, "ord", "_cur", "_was", bucket=bucket).drop("_cur")
    same = F.coalesce((F.col("_was")["ord"] == F.col("ord") - 1) & (F.col("_was")["_sig"] == F.col("_sig")), F.lit(False))
    d = running_sum(d.withColumn("_new", (~same).cast("int")).drop("_sig", "_was"), _EPISODE, "ord", F.col("_new"), "_run", bucket=bucket)
    ends = d.groupBy(*_EPISODE, "_run").agg(F.min("ord").alias("_start"), F.max("ord").alias("end_ord"),
                                            F.max("frame_idx").alias("end_frame"))
    d = d.join(ends, [*_EPISODE, "_run"]).select(
        *at, F.concat_ws("/", *_EPISODE, "_run").alias("stretch"), (F.col("ord") - F.col("_start")).alias("_idx"), "end_ord", "end_frame")
    return group.join(d, at)


def fuse_tracks(candidates: DataFrame, gated: DataFrame, frames: DataFrame, lost: int = LOST,
                archive: int = ARCHIVE, gap: int = TEMPORAL_GAP, bucket: int = 4096, span: int = SPAN) -> DataFrame:
    """Fused observations: video_id, object_id, frame_idx, det_seq.

    ``candidates`` (DET, run_id, local_obj_id, score), ``gated`` from merge_gate,
    ``frames`` every processed frame, also those without candidates; gated pairs of
    detections that are no candidates don't count. Episodes are folded over their
    changes only, since frames that repeat the ones before them change nothing, and
    in pieces of ``span`` frames.
    """
    spark = candidates.sparkSession
    ensure_checkpoint_dir(spark)
    patience = max(lost + archive, 1)
    node = F.xxhash64("run_id", "local_obj_id")
    c = candidates.select(*DET, "run_id", "local_obj_id", "score", node.alias("_node"))
    c = c.join(frame_ordinals(frames, bucket), FRAME).checkpoint()

    # components of tracker objects; a hash clash would only join two of them
    nodes = c.select(*FRAME, "det_seq", "_node")
    side = lambda s: nodes.select(*FRAME, F.col("det_seq").alias(f"det_seq_{s}"), F.col("_node").alias(s))
    there = nodes.select(*DET)
    gate = gated.select(*FRAME, "det_seq_a", "det_seq_b")
    for side_name in ("det_seq_a", "det_seq_b"):
        gate = gate.join(there.withColumnRenamed("det_seq", side_name), [*FRAME, side_name], "left_semi")
    gate = gate.checkpoint()
    edges = (gate.join(side("a"), [*FRAME, "det_seq_a"]).join(side("b"), [*FRAME, "det_seq_b"])
             .select(F.col("video_id").alias("group"), "a", "b").distinct())
    labels = components(edges).select(F.col("group").alias("video_id"), F.col("node").alias("_node"), "label")
    c = c.join(labels, ["video_id", "_node"], "left")

    # alone: a life is a run without a long absence; the id is its first detection
    alone = c.filter("label is null").drop("label")
    keys = ["video_id", "run_id", "local_obj_id"]
    alone = gap_segments(alone, keys, "ord", patience, name="_seg", bucket=bucket)
    first = F.min(F.struct("frame_idx", "det_seq"))
    lives = alone.groupBy(*keys, "_seg").agg(first.alias("_id"))
    w = Window.partitionBy(*FRAME, "run_id", "local_obj_id").orderBy(F.desc("score"), "det_seq")
    solo = (alone.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
            .join(lives, [*keys, "_seg"])
            .select("video_id", "frame_idx", "det_seq", F.col("_id.frame_idx").alias("root_frame"),
                    F.col("_id.det_seq").alias("root_det")))
    solo_ids = lives.select("video_id", F.col("_id.frame_idx").alias("gid_frame"), F.col("_id.det_seq").alias("gid_det"))

    # together: episodes of each component, folded in frame order
    group = c.filter("label is not null")
    group = gap_segments(group, ["video_id", "label"], "ord", patience, name="_ep", ties=["det_seq"], bucket=bucket)
    pairs = gate.select(*FRAME, F.col("det_seq_a").alias("det_seq"), F.col("det_seq_b").alias("p")).unionByName(
        gate.select(*FRAME, F.col("det_seq_b").alias("det_seq"), F.col("det_seq_a").alias("p")))
    partners = pairs.groupBy(*DET).agg(F.collect_list("p").alias("partners"))
    cut = _stretches(group, gate, bucket).checkpoint()
    repeats = (F.col("_idx") == 1) & (F.col("end_ord") > F.col("ord"))
    changes = cut.filter("_idx < 2")
    for c in ("stretch", "end_ord", "end_frame"):
        changes = changes.withColumn(c, F.when(repeats, F.col(c)))
    steady = cut.filter("_idx > 1").select(*DET, "run_id", "local_obj_id", "score", "stretch")
    rows = changes.join(partners, DET, "left").select(
        *_EPISODE, "ord", "frame_idx", "det_seq", "run_id", "local_obj_id", "score", "partners",
        "stretch", "end_ord", "end_frame")
    # an episode within one span is one piece; the others' pieces are numbered without gaps
    spans = rows.select(*_EPISODE, F.expr(f"ord div {int(span)}").alias("_span")).distinct()
    inside = Window.partitionBy(*_EPISODE)
    pieces = spans.withColumn("_many", F.count(F.lit(1)).over(inside) > 1).filter("_many").select(
        *_EPISODE, "_span", (F.row_number().over(inside.orderBy("_span")) - 1).cast("bigint").alias("piece")).checkpoint()
    split = not pieces.isEmpty()
    states = None
    if split:
        rows = written(rows.withColumn("_span", F.expr(f"ord div {int(span)}")).join(pieces, [*_EPISODE, "_span"], "left").drop("_span"))
        states = _settled_states(rows.filter("piece is not null"), patience, gap)
        rows = rows.withColumn("piece", F.coalesce("piece", F.lit(0).cast("bigint")))
    else:
        rows = rows.withColumn("piece", F.lit(0).cast("bigint"))
    folded = _with_states(rows, states).mapInPandas(_fold_episodes(patience, gap), _FOLDED)
    folded = written(_named(written(folded))) if split else folded.filter("kind <> 'life'").checkpoint()

    # where each absorbed id ended, and its place among the absorbed: by piece, then as they came
    name = lambda c: F.struct(F.col(f"{c}_frame").alias("f"), F.col(f"{c}_det").alias("d"))
    ids = folded.filter("kind = 'map' and precedence > 0").select(
        "video_id", name("gid").alias("node"), name("root").alias("up"), F.array(F.struct("piece", "precedence")).alias("path"))
    ids = chain_ends(ids, ["video_id"]) if split else ids.withColumnRenamed("up", "root")
    ids = ids.select("video_id", F.col("node.f").alias("gid_frame"), F.col("node.d").alias("gid_det"), F.col("root.f").alias("root_frame"),
                     F.col("root.d").alias("root_det"), F.col("path").alias("precedence"))
    seen = folded.filter("kind = 'obs'").select("video_id", "frame_idx", "det_seq", "gid_frame", "gid_det")
    held = folded.filter("kind = 'hold'").select("stretch", "run_id", "local_obj_id", "gid_frame", "gid_det")
    best = Window.partitionBy(*FRAME, "gid_frame", "gid_det").orderBy(F.desc("score"), "det_seq")
    seen = seen.unionByName(
        steady.join(held, ["stretch", "run_id", "local_obj_id"]).withColumn("_rn", F.row_number().over(best))
        .filter("_rn = 1").select("video_id", "frame_idx", "det_seq", "gid_frame", "gid_det"))
    seen = seen.join(ids, ["video_id", "gid_frame", "gid_det"], "left").withColumns({
        "root_frame": F.coalesce("root_frame", "gid_frame"), "root_det": F.coalesce("root_det", "gid_det")})
    # the id that kept the object comes first, then what it absorbed
    first_wins = Window.partitionBy("video_id", "root_frame", "root_det", "frame_idx").orderBy(F.col("precedence").asc_nulls_first())
    together = (seen.withColumn("_rn", F.row_number().over(first_wins)).filter("_rn = 1")
                .select("video_id", "frame_idx", "det_seq", "root_frame", "root_det"))

    # every allocation takes a number, also those merged away in their first frame
    used = folded.filter("kind = 'alloc'").select("video_id", "gid_frame", "gid_det")
    number = global_row_number(used.unionByName(solo_ids), ["video_id"], "gid_frame", ["gid_det"],
                               name="_rn", bucket=bucket)
    number = number.select("video_id", F.col("gid_frame").alias("root_frame"), F.col("gid_det").alias("root_det"),
                           (F.col("_rn") - 1).alias("object_id"))
    fused = (together.unionByName(solo).join(number, ["video_id", "root_frame", "root_det"])
             .select("video_id", "object_id", "frame_idx", "det_seq"))
    return fused.checkpoint()  # every scene table reads it, most of them twice

