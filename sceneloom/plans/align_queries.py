"""Queries over overlapping clips and their alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from sceneloom.operators import align as A
from sceneloom.operators import lift as L
from sceneloom.operators.masks import JOIN
from sceneloom.plans.registry import query
from sceneloom.schema import FRAME

_CHUNKS = """select f.video_id, f.frame_idx, c.chunk_id, f.frame_idx - c.chunk_id * 15 as local, 8::bigint as n_chunks
    from frames f join (select unnest(range(8)) as chunk_id) c
    on f.frame_idx >= c.chunk_id * 15 and f.frame_idx < c.chunk_id * 15 + 20"""


@query("chunk_frames", "select * from chunks", chunks=_CHUNKS)
def chunk_frames(v):
    return A.chunk_frames(v.frames, 20, 5)


@query("chunk_owner", "select video_id, frame_idx, chunk_id from chunks where chunk_id = 7 or local < 15", chunks=_CHUNKS)
def chunk_owner(v):
    return A.chunk_owner(A.chunk_frames(v.frames, 20, 5), 20, 5).select(*FRAME, "chunk_id")


@query("frame_cover", "select video_id, frame_idx, 2::bigint as owners from chunks group by all having count(*) = 2", chunks=_CHUNKS)
def frame_cover(v):
    """Without the owner rule the shared frames are owned twice."""
    return A.frame_cover(A.chunk_frames(v.frames, 20, 5), v.frames).withColumn("owners", F.col("owners").cast("bigint"))


def chunk_views(v):
    """Frames and depth lines as each chunk sees them.

    Chunk j sees the world scaled by 2^-j, turned j quarter turns about the
    vertical axis and shifted by j; halves and quarter turns are exact.
    """
    chunks = A.chunk_frames(v.frames, 20, 5)
    j = F.col("chunk_id")
    turns = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in (
        (1, 0, 0, 0, 1, 0, 0, 0, 1), (0, 0, 1, 0, 1, 0, -1, 0, 0), (-1, 0, 0, 0, 1, 0, 0, 0, -1), (0, 0, -1, 0, 1, 0, 1, 0, 0))])
    far = j.cast("double")
    sims = chunks.select("video_id", "chunk_id").distinct().select(
        "video_id", "chunk_id", F.pow(F.lit(0.5), far).alias("s"), turns[(j % 4).cast("int")].alias("r"),
        F.array(far, -far, F.lit(0.0)).alias("t"))
    # the small side takes chunk and scale first, so that the lines meet it once, by frame
    scales = chunks.select(*FRAME, "chunk_id").join(sims.select("video_id", "chunk_id", "s").hint(JOIN), ["video_id", "chunk_id"])
    frames = A.apply_similarity(v.frames.join(chunks.hint(JOIN), FRAME), sims)
    return frames, A.scaled_lines(v.depth_rows.join(scales.hint(JOIN), FRAME))


def shared_lines(v):
    frames, lines = chunk_views(v)
    return A.overlap_lines(lines, frames)


_CPTS = """select c.video_id, c.frame_idx, c.chunk_id, v, u, s * rx + c.chunk_id as x, s * y - c.chunk_id as y, s * rz as z, conf from (
    select k.*, pow(5e-1, k.chunk_id) as s, v, u, y, conf, case k.chunk_id % 4 when 0 then x when 1 then z when 2 then -x else -z end as rx,
        case k.chunk_id % 4 when 0 then z when 1 then -x when 2 then -z else x end as rz
    from chunks k join (
        select video_id, frame_idx, v, u, (u - 32) / 5e2 * d - tx as x, (v - 32) / 5e2 * d as y,
            d as z, cast(((u * 31 + v * 17 + frame_idx) % 100) / 1e2 as float) as conf from (
            select *, 5e0 + v / 64e0 * 5e-1 as d from frames, (select unnest(range(64)) as v), (select unnest(range(64)) as u))) p using (video_id, frame_idx)) c"""
_SHARED = """select a.video_id, a.chunk_id as pair_id, b.x as sx, b.y as sy, b.z as sz, a.x as tx, a.y as ty, a.z as tz,
        least(a.conf, b.conf)::double as w
    from cpts a join cpts b using (video_id, frame_idx, v, u) where b.chunk_id = a.chunk_id + 1 and a.conf > 2e-1 and b.conf > 2e-1"""
_BOTH = [f"{n}{c}" for n in "st" for c in "xyz"]


@query("overlap_pairs", "select video_id, pair_id, count(*) as n, round(avg(w), 6) as w, "
       + ", ".join(f"round(avg({c}), 6) + 0e0 as {c}" for c in _BOTH) + " from shared group by all",
       chunks=_CHUNKS, cpts=_CPTS, shared=_SHARED)
def overlap_pairs(v):
    near = lambda c: (F.round(c, 6) + F.lit(0.0))
    m = A.line_moments(shared_lines(v), weighted=False)
    n = F.col("n")
    return m.select("video_id", "pair_id", "n", near(F.col("sw") / n).alias("w"),
                    *[near(F.col(f"m{side}{i}") / n + F.col(f"{side}a{i}")).alias(f"{side}{c}") for side in "st" for i, c in enumerate("xyz")])


@query("umeyama_moments", """select video_id, pair_id, n, round(sw, 3) as sw, round(ss / sw - mx * mx - my * my - mz * mz, 8) as spread, """
       + ", ".join(f"round(c{i}{j} / sw - n{a} * m{b}, 8) + 0e0 as c{i}{j}" for i, a in enumerate("xyz") for j, b in enumerate("xyz"))
       + ", " + ", ".join(f"round({n}{a}, 6) + 0e0 as {n}{a}" for n in "mn" for a in "xyz")
       + " from (select video_id, pair_id, count(*) as n, sum(w) as sw, sum(w * (sx * sx + sy * sy + sz * sz)) as ss, "
       + ", ".join(f"sum(w * t{a} * s{b}) as c{i}{j}" for i, a in enumerate("xyz") for j, b in enumerate("xyz"))
       + ", " + ", ".join(f"sum(w * {p}{a}) / sum(w) as {n}{a}" for n, p in (("m", "s"), ("n", "t")) for a in "xyz")
       + " from shared group by all)", chunks=_CHUNKS, cpts=_CPTS, shared=_SHARED)
def umeyama_moments(v):
    """All sums about the anchors, as spread, covariance and means."""
    m = A.line_moments(shared_lines(v))
    sw = F.col("sw")
    ms, mt = ([F.col(f"m{n}{i}") / sw for i in range(3)] for n in "st")
    near = lambda c, n: F.round(c, n) + F.lit(0.0)
    return m.select("video_id", "pair_id", "n", F.round(sw, 3).alias("sw"),
                    near(F.col("ss") / sw - ms[0] * ms[0] - ms[1] * ms[1] - ms[2] * ms[2], 8).alias("spread"),
                    *[near(F.col(f"c{i}{j}") / sw - mt[i] * ms[j], 8).alias(f"c{i}{j}") for i in range(3) for j in range(3)],
                    *[near(x[i] + F.col(f"{p}a{i}"), 6).alias(f"{n}{a}") for n, p, x in (("m", "s", ms), ("n", "t", mt)) for i, a in enumerate("xyz")])


# chunk j+1 to chunk j, composed from the two known views: scale 2, one quarter turn back, and the shift that is left
_TRUTH = """select f.video_id, c.pair_id, 2e0 as scale, 0e0 as r00, -1e0 as r02, 1e0 as r11, 1e0 as r20,
        pair_id::double as tx, pair_id + 2e0 as ty, -2e0 * (pair_id + 1) as tz
    from videos f, (select unnest(range(7)) as pair_id) c"""


def _rounded(sim):
    near = lambda c: F.round(c, 5) + F.lit(0.0)
    r, t = F.col("r"), F.col("t")
    return sim.select("video_id", "pair_id", near(F.col("s")).alias("scale"), near(r[0]).alias("r00"), near(r[2]).alias("r02"),
                      near(r[4]).alias("r11"), near(r[6]).alias("r20"), *[near(t[i]).alias(n) for i, n in enumerate(("tx", "ty", "tz"))])


@query("estimate_similarity", "select * from truth", truth=_TRUTH)
def estimate_similarity(v):
    return _rounded(A.estimate_similarity(shared_lines(v), robust=False))


@query("align_chunks", "select * from truth", truth=_TRUTH)
def align_chunks(v):
    frames, lines = chunk_views(v)
    return _rounded(A.align_lines(lines, frames))


@query("accumulate_similarity", """select video_id, c.chunk_id, pow(2e0, c.chunk_id) as scale,
        case c.chunk_id % 4 when 0 then 1e0 when 2 then -1e0 else 0e0 end as r00,
        case c.chunk_id % 4 when 1 then -1e0 when 3 then 1e0 else 0e0 end as r02,
        case c.chunk_id % 4 when 0 then -far when 2 then far else 0e0 end + 0e0 as tx, far as ty,
        case c.chunk_id % 4 when 1 then -far when 3 then far else 0e0 end + 0e0 as tz
    from videos, (select chunk_id, pow(2e0, chunk_id) * chunk_id as far from (select unnest(range(8)) as chunk_id)) c""")
def accumulate_similarity(v):
    frames, lines = chunk_views(v)
    sims = A.accumulate_similarity(A.align_lines(lines, frames, robust=False), bucket=3)
    near = lambda c: F.round(c, 3) + F.lit(0.0)
    return sims.select("video_id", "chunk_id", near(F.col("s")).alias("scale"), near(F.col("r")[0]).alias("r00"),
                       near(F.col("r")[2]).alias("r02"), *[near(F.col("t")[i]).alias(n) for i, n in enumerate(("tx", "ty", "tz"))])


@query("align_video", """select video_id, frame_idx, round(tx, 5) as tx, 0e0 as ty, 0e0 as tz, 1e0 as r00, 0e0 as r02, sd from frames,
    (select round(sum(64 * (5e0 + v / 64e0 * 5e-1)), 2) as sd from (select unnest(range(64)) as v))""")
def align_video(v):
    """The views of all chunks brought back to the one world they came from, every frame once."""
    frames, lines = chunk_views(v)
    frames, lines = A.align_video(frames, lines, 20, 5, robust=False)
    near = lambda c, n: F.round(c, n) + F.lit(0.0)
    t = F.col("t_wc")
    total = lines.groupBy(*FRAME).agg(F.sum(F.aggregate("depth", F.lit(0.0), lambda a, d: a + d.cast("double"))).alias("sd"))
    return frames.join(total.hint(JOIN), FRAME).select(*FRAME, near(t[3], 5).alias("tx"), near(t[7], 5).alias("ty"), near(t[11], 5).alias("tz"),
                                            near(t[0], 5).alias("r00"), near(t[2], 5).alias("r02"), near(F.col("sd"), 2).alias("sd"))


@query("apply_similarity", """select video_id, frame_idx, chunk_id, 2e0 * (0e0 - tx) + 3e0 as ego_x, -5e0 as ego_y, 2e0 * 0e0 + 1e0 as ego_z,
    sd from (select f.*, k.chunk_id from frames f join chunks k using (video_id, frame_idx)) f,
    (select sum(2e0 * (5e0 + v / 64e0 * 5e-1))::double as sd from (select unnest(range(64)) as v))""", chunks=_CHUNKS)
def apply_similarity(v):
    """One known similarity for all chunks: scale 2 and a shift."""
    eye = F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)])
    chunks = A.chunk_frames(v.frames, 20, 5).select(*FRAME, "chunk_id")
    sims = chunks.select("video_id", "chunk_id").distinct().select(
        "video_id", "chunk_id", F.lit(2.0).alias("s"), eye.alias("r"), F.array(F.lit(3.0), F.lit(-5.0), F.lit(1.0)).alias("t"))
    frames, lines = A.apply_similarity(v.frames.join(chunks.hint(JOIN), FRAME), sims, v.depth_rows.join(chunks.hint(JOIN), FRAME))
    ego = L.ego_track(frames.withColumn("frame_idx", F.col("frame_idx") * 100 + F.col("chunk_id")))
    ego = ego.select("video_id", F.expr("frame_idx div 100").alias("frame_idx"), (F.col("frame_idx") % 100).alias("chunk_id"),
                     F.col("x").alias("ego_x"), F.col("y").alias("ego_y"), F.col("z").alias("ego_z"))
    total = lines.groupBy(*FRAME, "chunk_id").agg(F.sum(F.col("depth")[0].cast("double")).alias("sd"))
    return ego.join(total, [*FRAME, "chunk_id"])
