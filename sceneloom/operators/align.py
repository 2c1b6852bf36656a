"""Overlapping clips brought into one coordinate system."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneloom.functions import geometry as g
from sceneloom.operators.masks import JOIN
from sceneloom.operators.tracks import frame_ordinals
from sceneloom.schema import FRAME
from sceneloom.session import ensure_checkpoint_dir

PAIR = ["video_id", "pair_id"]
_ANCHORS = [f"{n}a{i}" for n in "st" for i in range(3)]


def chunk_frames(frames: DataFrame, size: int, overlap: int = 5, bucket: int = 4096) -> DataFrame:
    """Overlapping windows over the processed frames: chunk_id, local position, n_chunks.

    Windows start every size-overlap frames; the last may be short. Size 0, or a
    video that fits, gives one window.
    """
    if size and not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the chunk size")
    d = frame_ordinals(frames, bucket)
    n = frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n"))
    d = d.join(n.hint(JOIN), "video_id")
    if size <= 0:
        one = F.lit(0).cast("bigint")
        return d.select(*FRAME, one.alias("chunk_id"), F.col("ord").alias("local"), F.lit(1).cast("bigint").alias("n_chunks"))
    step = size - overlap
    count = F.when(F.col("_n") <= size, F.lit(1)).otherwise(F.ceil((F.col("_n") - size) / step) + 1).cast("bigint")
    d = d.withColumn("n_chunks", count)
    first = F.greatest(F.lit(0), F.ceil((F.col("ord") - size + 1) / step)).cast("bigint")
    last = F.least(F.floor(F.col("ord") / step), F.col("n_chunks") - 1).cast("bigint")
    d = d.withColumn("chunk_id", F.explode(F.sequence(first, last)))
    return d.select(*FRAME, "chunk_id", (F.col("ord") - F.col("chunk_id") * step).alias("local"), "n_chunks")


def chunk_owner(chunks: DataFrame, size: int, overlap: int = 5) -> DataFrame:
    """Each window keeps its first size-overlap frames, the last one all of its own."""
    last = F.col("chunk_id") == F.col("n_chunks") - 1
    return chunks.filter(last | (F.col("local") < size - overlap))


def frame_cover(owned: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames not owned exactly once, with their number of owners; empty when all is well."""
    n = owned.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("owners"))
    d = frames.select(*FRAME).join(n, FRAME, "left").withColumn("owners", F.coalesce("owners", F.lit(0)))
    return d.filter("owners <> 1")


def overlap_pairs(points: DataFrame, conf_threshold: float = 0.2, depth_max: float = 100.0) -> DataFrame:
    """The same pixel seen by neighbouring chunks: source (later) and target (earlier) point.

    ``points`` has video_id, chunk_id, frame_idx, v, u, x, y, z, conf. Only sums
    over the pairs are used later, so all pairs are kept; none are sampled away.
    """
    far = F.lit(float(depth_max))
    p = points.filter((F.col("conf") > conf_threshold) & ~F.isnan("conf") & (g.norm([F.col(c) for c in "xyz"]) < far))
    key = ["video_id", "frame_idx", "v", "u"]
    earlier = p.select(*key, F.col("chunk_id").alias("pair_id"), F.col("conf").alias("_ct"),
                       *[F.col(c).alias(f"t{c}") for c in "xyz"])
    later = p.select(*key, (F.col("chunk_id") - 1).alias("pair_id"), F.col("conf").alias("_cs"),
                     *[F.col(c).alias(f"s{c}") for c in "xyz"])
    met = earlier.join(later.hint(JOIN), [*key, "pair_id"])
    return met.select(*key, "pair_id", *[f"s{c}" for c in "xyz"], *[f"t{c}" for c in "xyz"],
                      F.least("_cs", "_ct").cast("double").alias("w"))


def overlap_lines(lines: DataFrame, frames: DataFrame) -> DataFrame:
    """Depth lines of the frames that neighbouring chunks share, side by side, each with its camera.

    Both tables carry chunk_id: a chunk has depth and poses of its own. Lines meet, not
    pixels; ``line_pairs`` makes the pixels inside the stage that sums over them. The
    anchors of a pair are the two camera positions of its first shared frame.
    """
    cam = g.with_rays(frames.select("video_id", "chunk_id", "frame_idx", "k", "t_wc")).select(*FRAME, "chunk_id", "ray")
    cams = cam.groupBy(*FRAME).agg(F.collect_list(F.struct("chunk_id", "ray")).alias("_cams"))
    pairs = cams.select(*FRAME, "_cams", F.explode("_cams").alias("_t"))
    pairs = pairs.select(*FRAME, F.col("_t.chunk_id").alias("pair_id"), F.col("_t.ray").alias("t"),
                         F.explode(F.filter("_cams", lambda e: e["chunk_id"] == F.col("_t.chunk_id") + 1)).alias("_s"))
    pairs = pairs.select(*FRAME, "pair_id", "t", F.col("_s.ray").alias("s"))
    first = pairs.groupBy(*PAIR).agg(F.min_by(F.struct("s", "t"), "frame_idx").alias("_r"))
    first = first.select(*PAIR, *[F.col(f"_r.{n}")[4 * i + 3].alias(f"{n}a{i}") for n in "st" for i in range(3)])
    # whatever a frame's lines need in one row of the frame: they meet it once, by frame
    held = pairs.join(first.hint(JOIN), PAIR).groupBy(*FRAME).agg(F.collect_list(F.struct("pair_id", "s", "t", *_ANCHORS)).alias("_pairs"))
    at = lines.join(held.hint(JOIN), FRAME).filter(
        F.exists("_pairs", lambda p: (p["pair_id"] == F.col("chunk_id")) | (p["pair_id"] + 1 == F.col("chunk_id"))))
    # and lie by frame then, so that the sides of a line meet without moving again
    met = at.groupBy(*FRAME, "v").agg(F.first("_pairs").alias("_pairs"), F.collect_list(F.struct("chunk_id", "depth", "conf")).alias("_sides"))
    met = met.select(*FRAME, "v", "_sides", F.explode("_pairs").alias("_p"))
    for n, o in (("_t", 0), ("_s", 1)):
        met = met.select("*", F.explode(F.filter("_sides", lambda e: e["chunk_id"] == F.col("_p.pair_id") + o)).alias(n))  # noqa: B023
    side = lambda n: F.struct(F.col(f"_{n}.depth"), F.col(f"_{n}.conf"), F.col(f"_p.{n}").alias("ray")).alias(n)
    return met.select(*FRAME, "v", "_p.pair_id", side("t"), side("s"), *[f"_p.{a}" for a in _ANCHORS])


def line_pairs(met: DataFrame, conf_threshold: float = 0.2, depth_max: float = 100.0) -> DataFrame:
    """The point pairs of ``overlap_lines``, under the rules of ``overlap_pairs``; a missing confidence counts as 1."""
    more = [c for c in met.columns if c not in ("s", "t")]
    d = met.select(*more, "s", "t", F.posexplode("s.depth").alias("u", "_ds"))
    trust = lambda n: F.coalesce(F.col(f"{n}.conf")[F.col("u")], F.lit(1.0).cast("float"))
    d = d.withColumn("_cs", trust("s")).withColumn("_ct", trust("t")).withColumn("_dt", F.col("t.depth")[F.col("u")])
    for n in "st":
        d = d.filter((F.col(f"_c{n}") > conf_threshold) & ~F.isnan(f"_c{n}"))
        ray, far = F.col(f"{n}.ray"), F.col(f"_d{n}").cast("double")
        for i, c in enumerate("xyz"):
            d = d.withColumn(f"{n}{c}", (ray[4 * i] * F.col("u") + ray[4 * i + 1] * F.col("v") + ray[4 * i + 2]) * far + ray[4 * i + 3])
    for n in "st":
        d = d.filter(g.norm([F.col(f"{n}{c}") for c in "xyz"]) < F.lit(float(depth_max)))
    return d.select(*more, "u", *[f"{n}{c}" for n in "st" for c in "xyz"], F.least("_cs", "_ct").cast("double").alias("w"))


def anchored(pairs: DataFrame) -> DataFrame:
    """The pairs with a point near each cloud, from which moments are taken: its least coordinates."""
    least = pairs.groupBy(*PAIR).agg(*[F.min(f"{n}{c}").alias(f"{n}a{i}") for n in "st" for i, c in enumerate("xyz")])
    return pairs.join(least, PAIR)


def umeyama_moments(pairs: DataFrame, weight: str = "w") -> DataFrame:
    """The weighted sums a similarity needs, per pair of chunks: one aggregate of 18 sums.

    With anchors (sa0..2, ta0..2, alike in all rows of a pair) the sums are taken about
    them and they come along; sums far from the origin lose their digits otherwise.
    """
    w = F.col(weight)
    s, t = [F.col(f"s{c}") for c in "xyz"], [F.col(f"t{c}") for c in "xyz"]
    about = set(_ANCHORS) <= set(pairs.columns)
    if about:
        s, t = ([x - F.col(f"{n}a{i}") for i, x in enumerate(p)] for n, p in (("s", s), ("t", t)))
    sums = [F.count(F.lit(1)).alias("n"), F.sum(w).alias("sw")]
    sums += [F.sum(w * s[i]).alias(f"ms{i}") for i in range(3)]
    sums += [F.sum(w * t[i]).alias(f"mt{i}") for i in range(3)]
    sums += [F.sum(w * t[i] * s[j]).alias(f"c{i}{j}") for i in range(3) for j in range(3)]
    sums += [F.sum(w * (s[0] * s[0] + s[1] * s[1] + s[2] * s[2])).alias("ss")]
    sums += [F.first(a).alias(a) for a in _ANCHORS if about]
    return pairs.groupBy(*PAIR).agg(*sums)


_SUMS = (["sw"] + [f"m{n}{i}" for n in "st" for i in range(3)] + [f"c{i}{j}" for i in range(3) for j in range(3)] + ["ss"])


def line_moments(met: DataFrame, conf_threshold: float = 0.2, depth_max: float = 100.0, delta: float = 0.5,
                 weighted: bool = True) -> DataFrame:
    """The sums of ``umeyama_moments`` straight from lines side by side, a batch of lines at a time.

    Equals the moments of ``line_pairs``, but pixels never become rows: a batch gives one row for each
    pair of chunks in it. With a column last (s, r, t) the weights are those of the next robust round.
    Without ``weighted`` all sums but that of the weights count each pixel once.
    """
    again = "last" in met.columns
    lists = [F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in "st" for c in ("depth", "ray")]
    lists += [F.coalesce(F.col(f"{n}.conf"), F.transform(f"{n}.depth", lambda _: F.lit(1.0).cast("float"))).alias(f"{n}_conf") for n in "st"]
    lists += [F.concat(F.array("last.s"), "last.r", "last.t").alias("_last")] if again else []
    rows = met.select(*PAIR, "v", *_ANCHORS, *lists)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(c).to_numpy() for c in PAIR], axis=1)
            pairs, start, group = np.unique(key, axis=0, return_index=True, return_inverse=True)
            group = group.ravel()
            many = pc.list_value_length(b.column("s_depth")).to_numpy(zero_copy_only=False)
            # lines as rows of one raster, short ones filled up with no depth
            inside = np.arange(many.max(initial=0)) < many[:, None]

            def flat(name: str, missing: float) -> np.ndarray:
                return pc.fill_null(b.column(name).flatten(), missing).to_numpy(zero_copy_only=False).astype(float)

            def raster(name: str, missing: float) -> np.ndarray:
                out = np.full(inside.shape, missing)
                out[inside] = flat(name, missing)
                return out

            u, v = np.arange(inside.shape[1], dtype=float), b.column("v").to_numpy()[:, None]
            at, conf, keep = {}, {}, inside.copy()
            with np.errstate(invalid="ignore", over="ignore"):
                for n in "st":
                    d, ray = raster(f"{n}_depth", np.nan), flat(f"{n}_ray", np.nan).reshape(-1, 12, 1)
                    at[n] = [(ray[:, i] * u + ray[:, i + 1] * v + ray[:, i + 2]) * d + ray[:, i + 3] for i in (0, 4, 8)]
                    conf[n] = raster(f"{n}_conf", 1.0)
                    keep &= (conf[n] > conf_threshold) & (np.sqrt(at[n][0] ** 2 + at[n][1] ** 2 + at[n][2] ** 2) < depth_max)
                at = {n: [np.where(keep, c, 0.0) for c in p] for n, p in at.items()}
                total = np.where(keep, np.minimum(conf["s"], conf["t"]), 0.0)
            w = total if weighted else keep.astype(float)
            if again:
                last = flat("_last", np.nan).reshape(-1, 13, 1)
                moved = [last[:, 0] * sum(last[:, 1 + 3 * i + j] * at["s"][j] for j in range(3)) + last[:, 10 + i] for i in range(3)]
                res = np.sqrt(sum((m - q) ** 2 for m, q in zip(moved, at["t"])))
                w = w * np.where(res < delta, 1.0, delta / (res + 1e-12))
            anchor = {n: np.stack([b.column(f"{n}a{i}").to_numpy() for i in range(3)], axis=1) for n in "st"}
            # per line all products of (1, source, target) at once; outside, weights are zero
            x = np.stack([np.ones(inside.shape), *(c - anchor[n][:, i, None] for n in "st" for i, c in enumerate(at[n]))], axis=1)
            m = (x * w[:, None]) @ x.transpose(0, 2, 1)
            cols = [total.sum(axis=1), *(m[:, 0, i] for i in range(1, 7)), *(m[:, 4 + i, 1 + j] for i in range(3) for j in range(3)),
                    m[:, 1, 1] + m[:, 2, 2] + m[:, 3, 3]]
            if again:
                cols[0] = w.sum(axis=1)
            k = len(pairs)
            out = [pairs[:, 0], pairs[:, 1], np.bincount(group, weights=keep.sum(axis=1), minlength=k).astype(np.int64)]
            out += [np.bincount(group, weights=c, minlength=k) for c in cols]
            out += [anchor[n][start, i] for n in "st" for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=[*PAIR, "n", *_SUMS, *_ANCHORS])

    schema = "video_id long, pair_id long, n long, " + ", ".join(f"{c} double" for c in [*_SUMS, *_ANCHORS])
    part = rows.mapInArrow(sums, schema)
    total = part.groupBy(*PAIR).agg(*[F.sum(c).alias(c) for c in ("n", *_SUMS)], *[F.first(c).alias(c) for c in _ANCHORS])
    return total.filter("n > 0")


_SIM = "video_id long, pair_id long, n long, s double, r array<double>, t array<double>"


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Scale, rotation and translation from the sums; a batch of 3x3 problems at a time."""
    for m in batches:
        k = len(m)
        sw = m["sw"].to_numpy()
        ok = (m["n"].to_numpy() >= 3) & (sw >= 1e-12)
        safe = np.where(ok, sw, 1.0)
        mu_s = m[["ms0", "ms1", "ms2"]].to_numpy() / safe[:, None]
        mu_t = m[["mt0", "mt1", "mt2"]].to_numpy() / safe[:, None]
        cov = m[[f"c{i}{j}" for i in range(3) for j in range(3)]].to_numpy().reshape(k, 3, 3) / safe[:, None, None]
        cov = np.where(ok[:, None, None], cov - mu_t[:, :, None] * mu_s[:, None, :], np.eye(3))
        spread = m["ss"].to_numpy() / safe - (mu_s ** 2).sum(axis=1)
        left, sing, right = np.linalg.svd(cov)
        flip = np.ones((k, 3))
        flip[:, 2] = np.where(np.linalg.det(left) * np.linalg.det(right) < 0, -1.0, 1.0)
        rot = (left * flip[:, None, :]) @ right
        scale = np.where(spread > 1e-12, (sing * flip).sum(axis=1) / np.where(spread > 1e-12, spread, 1.0), 1.0)
        rot = np.where(ok[:, None, None], rot, np.eye(3))
        scale = np.where(ok, scale, 1.0)
        if "sa0" in m:
            mu_s, mu_t = (mu + m[[f"{n}a{i}" for i in range(3)]].to_numpy() for n, mu in (("s", mu_s), ("t", mu_t)))
        shift = np.where(ok[:, None], mu_t - scale[:, None] * np.einsum("nij,nj->ni", rot, mu_s), 0.0)
        yield pd.DataFrame({"video_id": m["video_id"], "pair_id": m["pair_id"], "n": m["n"], "s": scale,
                            "r": list(rot.reshape(k, 9)), "t": list(shift)})


def estimate_similarity(pairs: DataFrame, robust: bool = True, delta: float = 0.5, max_iters: int = 5) -> DataFrame:
    """Similarity target = s R source + t of every pair of chunks at once.

    Each robust round is one aggregate over all pairs with Huber weights from the
    last estimate. A pair of chunks that has settled keeps its estimate. ``pairs`` are
    point pairs (``overlap_pairs``), or lines side by side (``overlap_lines``), which
    are kept as lines between the rounds.
    """
    spark = pairs.sparkSession
    ensure_checkpoint_dir(spark)
    if robust:
        pairs = pairs.persist()  # read again each round; a single pass keeps nothing
    lines = "s" in pairs.columns
    points = (lambda p: p) if set(_ANCHORS) <= set(pairs.columns) else anchored
    try:
        first = line_moments(pairs) if lines else umeyama_moments(points(pairs))
        sim = first.mapInPandas(_solve, _SIM).withColumn("done", F.lit(not robust)).checkpoint()
        for _ in range(max_iters):
            if not sim.filter("not done").limit(1).count():
                break
            last = sim.filter("not done").select(*PAIR, F.struct("s", "r", "t").alias("last"))
            cur = pairs.join(last.hint(JOIN), PAIR)
            if lines:
                sums = line_moments(cur, delta=delta)
            else:
                cur = points(cur)
                src = [F.col(f"s{c}") for c in "xyz"]
                moved = [F.col("last.s") * m + F.col("last.t")[i] for i, m in enumerate(g.apply3(g.cells(F.col("last.r"), 9), src))]
                res = g.distance(moved, [F.col(f"t{c}") for c in "xyz"])
                huber = F.when(res < delta, F.lit(1.0)).otherwise(F.lit(delta) / (res + F.lit(1e-12)))
                sums = umeyama_moments(cur.withColumn("hw", F.col("w") * huber), "hw")
            new = sums.mapInPandas(_solve, _SIM)
            new = new.select(*PAIR, F.struct("s", "r", "t").alias("new"))
            both = sim.join(new.hint(JOIN), PAIR, "left")
            near = F.forall(F.arrays_zip(F.col("r").alias("a"), F.col("new.r").alias("b")),
                            lambda p: F.abs(p["a"] - p["b"]) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(p["a"]))
            settled = (F.abs(F.col("new.s") - F.col("s")) < 1e-8) & near
            take = F.col("new").isNotNull() & ~settled
            sim = both.select(*PAIR, "n", *[F.when(take, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in "srt"],
                              (F.col("done") | F.coalesce(settled, F.lit(True))).alias("done")).checkpoint()
    finally:
        if robust:
            pairs.unpersist()
    return sim.drop("done")


def align_chunks(points: DataFrame, chunk_pairs: DataFrame | None = None, min_pairs: int = 10,
                 robust: bool = True) -> DataFrame:
    """Pairwise similarities with the fallbacks: too few pairs or an absurd scale mean identity.

    ``chunk_pairs`` (video_id, pair_id) lists neighbours that may share no valid pixel.
    """
    return _accept(estimate_similarity(overlap_pairs(points), robust), chunk_pairs, min_pairs)


def align_lines(lines: DataFrame, frames: DataFrame, chunk_pairs: DataFrame | None = None, min_pairs: int = 10,
                robust: bool = True) -> DataFrame:
    """``align_chunks`` from the depth lines and frames of the chunks; no pixel row is shuffled."""
    return _accept(estimate_similarity(overlap_lines(lines, frames), robust), chunk_pairs, min_pairs)


def _accept(sim: DataFrame, chunk_pairs: DataFrame | None, min_pairs: int) -> DataFrame:
    if chunk_pairs is not None:
        sim = chunk_pairs.select(*PAIR).distinct().join(sim.hint(JOIN), PAIR, "left")
    ok = (F.coalesce("n", F.lit(0)) >= min_pairs) & (F.col("s") >= 0.01) & (F.col("s") <= 100.0)
    eye = F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)])
    zero = F.array(*[F.lit(0.0)] * 3)
    return sim.select(*PAIR, F.coalesce("n", F.lit(0)).alias("n"), F.when(ok, F.col("s")).otherwise(1.0).alias("s"),
                      F.when(ok, F.col("r")).otherwise(eye).alias("r"), F.when(ok, F.col("t")).otherwise(zero).alias("t"))


def _chain(pdf: pd.DataFrame) -> list[tuple]:
    """Running composition over rows in order."""
    s, r, t, out = 1.0, np.eye(3), np.zeros(3), []
    for si, ri, ti in zip(pdf["s"], pdf["r"], pdf["t"]):
        ri, ti = np.asarray(ri).reshape(3, 3), np.asarray(ti)
        s, r, t = s * si, r @ ri, s * (r @ ti) + t
        out.append((s, r.ravel(), t))
    return out


def accumulate_similarity(pairwise: DataFrame, bucket: int = 1024) -> DataFrame:
    """From each chunk to chunk 0: ordered products, which do not commute but associate.

    Stretches of ``bucket`` chunks are multiplied on their own; the stretch totals
    are multiplied along the video, and each row gets the total before its stretch.
    """
    schema = "video_id long, pair_id long, b long, s double, r array<double>, t array<double>"

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pair_id")
        done = _chain(pdf)
        return pdf[["video_id", "pair_id", "b"]].assign(s=[x[0] for x in done], r=[x[1] for x in done], t=[x[2] for x in done])

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("b")
        done = [(1.0, np.eye(3).ravel(), np.zeros(3))] + _chain(pdf)[:-1]
        return pdf[["video_id", "b"]].assign(s0=[x[0] for x in done], r0=[x[1] for x in done], t0=[x[2] for x in done])

    d = pairwise.select("video_id", "pair_id", F.floor(F.col("pair_id") / bucket).alias("b"), "s", "r", "t")
    local = d.groupBy("video_id", "b").applyInPandas(within, schema)
    ends = local.groupBy("video_id", "b").agg(F.max_by(F.struct("s", "r", "t"), "pair_id").alias("e")).select("video_id", "b", "e.*")
    before = ends.groupBy("video_id").applyInPandas(
        across, "video_id long, b long, s0 double, r0 array<double>, t0 array<double>")
    j = local.join(before.hint(JOIN), ["video_id", "b"])
    r0, r = g.cells(F.col("r0"), 9), g.cells(F.col("r"), 9)
    turned = g.apply3(r0, [F.col("t")[i] for i in range(3)])
    chained = j.select("video_id", (F.col("pair_id") + 1).alias("chunk_id"), (F.col("s0") * F.col("s")).alias("s"),
                       F.array(*g.product3(r0, r)).alias("r"),
                       F.array(*[F.col("s0") * m + F.col("t0")[i] for i, m in enumerate(turned)]).alias("t"))
    start = pairwise.select("video_id").distinct().select(
        "video_id", F.lit(0).cast("bigint").alias("chunk_id"), F.lit(1.0).alias("s"),
        F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)]).alias("r"),
        F.array(*[F.lit(0.0)] * 3).alias("t"))
    return start.unionByName(chained)


def apply_similarity(frames: DataFrame, sims: DataFrame, depth_rows: DataFrame | None = None):
    """Frames (with chunk_id) moved into chunk 0; their depth lines are scaled alike.

    The scale goes to the depth, the rotation and shift to the pose. Returns the
    frames, or (frames, depth lines) when lines are given; those need chunk_id too.
    """
    j = frames.join(sims.hint(JOIN), ["video_id", "chunk_id"])
    # world to camera is A, d before and A R', s d - A R' t after: no inverse is needed
    a, r = g.rotation_cells(F.col("t_wc")), g.cells(F.col("r"), 9)
    rot = g.product3(a, [r[3 * k + i] for i in range(3) for k in range(3)])
    back = g.apply3(rot, [F.col("t")[i] for i in range(3)])
    pos = [F.col("s") * d - m for d, m in zip(g.translation_cells(F.col("t_wc")), back)]
    j = j.withColumn("t_wc", g.pose_of(rot, pos))
    out = j.select(*frames.columns)
    if depth_rows is None:
        return out
    scaled = scaled_lines(depth_rows.join(sims.select("video_id", "chunk_id", "s").hint(JOIN), ["video_id", "chunk_id"]))
    return out, scaled.select(*depth_rows.columns)


def scaled_lines(lines: DataFrame) -> DataFrame:
    """Depth lines that carry the scale of their chunk in ``s``, multiplied by it."""
    return lines.withColumn("depth", F.transform("depth", lambda d: (d.cast("double") * F.col("s")).cast("float"))).drop("s")


def align_video(frames: DataFrame, lines: DataFrame, size: int, overlap: int = 5, robust: bool = True) -> tuple[DataFrame, DataFrame]:
    """Long videos seen in chunks, each with poses and depth of its own, as one: (frames, lines).

    ``frames`` has the columns of ``chunk_frames`` (chunk_id, local, n_chunks) beside its
    own, ``lines`` has chunk_id. Neighbouring chunks are aligned over the frames they share, the
    similarities chained to chunk 0 and applied, each frame kept from the chunk that owns it,
    and the poses made relative to the video's first frame. Neighbours without enough
    shared pixels count as aligned. Empty tables give empty tables.
    """
    step = frames.select("video_id", F.col("chunk_id").alias("pair_id"), "n_chunks").distinct()
    pairs = step.filter("pair_id < n_chunks - 1").select(*PAIR)
    chained = accumulate_similarity(align_lines(lines, frames, pairs, robust=robust))
    # a video of one chunk has no pair, but keeps its frames
    sims = step.select("video_id", F.col("pair_id").alias("chunk_id")).join(chained.hint(JOIN), ["video_id", "chunk_id"], "left")
    eye = F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)])
    sims = sims.select("video_id", "chunk_id", F.coalesce("s", F.lit(1.0)).alias("s"), F.coalesce("r", eye).alias("r"),
                       F.coalesce("t", F.array(*[F.lit(0.0)] * 3)).alias("t")).checkpoint()
    owned = chunk_owner(frames, size, overlap)
    moved = apply_similarity(owned, sims)
    # owner and scale of a frame in one row of the frame, which its lines meet once
    owner = owned.select(*FRAME, "chunk_id").join(sims.hint(JOIN), ["video_id", "chunk_id"]).groupBy(*FRAME).agg(
        F.collect_set(F.struct("chunk_id", "s")).alias("_own"))
    kept = lines.join(owner.hint(JOIN), FRAME).select(
        *lines.columns, F.explode(F.filter("_own", lambda o: o["chunk_id"] == F.col("chunk_id"))).alias("_own")).withColumn("s", F.col("_own.s"))
    extra = ("chunk_id", "local", "n_chunks")
    return normalise_poses(moved.drop(*extra)), scaled_lines(kept.drop("_own")).drop("chunk_id")


def normalise_poses(frames: DataFrame) -> DataFrame:
    """Poses relative to the first frame of each video, which becomes the identity."""
    first = frames.groupBy("video_id").agg(F.min("frame_idx").alias("_f0"), F.min_by("t_wc", "frame_idx").alias("_t0"))
    first = first.select("video_id", "_f0", g.pose_inverse(F.col("_t0")).alias("_inv0"))
    eye = F.array(*[F.lit(1.0 if i % 5 == 0 else 0.0) for i in range(16)])
    j = frames.join(first.hint(JOIN), "video_id")
    t = F.when(F.col("frame_idx") == F.col("_f0"), eye).otherwise(g.pose_product(F.col("t_wc"), F.col("_inv0")))
    return j.withColumn("t_wc", t).select(*frames.columns)
