"""Spatial relations between objects of one frame, and matches across frames and views."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.functions import geometry as g
from sceneloom.functions.ordered import global_row_number, percentiles, with_previous
from sceneloom.operators.blocks import best_pairs, cheaper, closest, in_cells, meetings
from sceneloom.operators.masks import JOIN, codes_jaccard, token_codes
from sceneloom.operators.matching import least_cost
from sceneloom.operators.tracks import frame_ordinals
from sceneloom.schema import FRAME
from sceneloom.session import discard, ensure_checkpoint_dir, written


def _cell(c: str | Column, size: float | Column) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / size).cast("bigint")


def grid_join(left: DataFrame, right: DataFrame, keys: list[str], radius: float, cell: float = 1.0) -> DataFrame:
    """Pairs within ``radius``: sides carry lx,ly,lz and rx,ry,rz; adds ``dist``.

    The left side looks into the ground cells that its radius touches, the right side
    stays in its own, so a crowded key spreads over its cells. Cells are ``cell`` radii wide:
    wider ones copy the left side less often, but more pairs meet in vain.
    """
    size = cell * radius
    reach = lambda c: F.sequence(_cell(F.col(c) - F.lit(float(radius)), size), _cell(F.col(c) + F.lit(float(radius)), size))
    a = left.select("*", F.explode(reach("lx")).alias("_gx")).select("*", F.explode(reach("lz")).alias("_gz"))
    b = right.select("*", _cell("rx", size).alias("_gx"), _cell("rz", size).alias("_gz"))
    d = g.distance([F.col(c) for c in ("rx", "ry", "rz")], [F.col(c) for c in ("lx", "ly", "lz")])
    return a.join(b, [*keys, "_gx", "_gz"]).withColumn("dist", d).filter(
        F.col("dist") < radius).drop("_gx", "_gz")


#: Points of one cell that meet as a block, and pairs to a task.
_BLOCK = 1024
_PAIRS_A_TASK = 1 << 25


def near_pairs(obs: DataFrame, radius: float, keys: list[str] = FRAME, obj: str = "object_id", block: int = _BLOCK) -> DataFrame:
    """Unordered pairs of one frame closer than ``radius``, smaller id first.

    Half of the neighbouring cells are enough: each pair meets exactly once. A crowded cell is
    cut into blocks, and blocks meet two by two, so a task holds one block however many points
    share a cell, and the pairs of one cell spread over all tasks. Each block is copied to
    those it meets; tasks follow the number of pairs, of which the driver sees the sum.
    """
    spark = obs.sparkSession
    ensure_checkpoint_dir(spark)
    many = spark.sparkContext.defaultParallelism
    # cells far out count as one: differences only shrink, and none of them overflows
    cell = lambda c: F.greatest(F.least(_cell(c, radius), F.lit(1 << 60)), F.lit(-(1 << 60)))
    pts = obs.select(*keys, F.col(obj).alias("id"), *[F.col(c).cast("double").alias(c) for c in "xyz"]).filter(
        " and ".join([f"{k} is not null" for k in [*keys, "id"]] + [f"abs({c}) < double('infinity')" for c in "xyz"]))
    pts = pts.repartition(many, "id").select("*", cell("x").alias("_gx"), cell("z").alias("_gz")).checkpoint()
    cells = pts.groupBy(*keys, "_gx", "_gz").agg(F.count(F.lit(1)).alias("_n"))
    half = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
                     for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    # cells that meet: side a in cell (_ax, _az), side b in (_bx, _bz), each with its number of blocks
    blocks = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    links = cells.select(*keys, F.col("_gx").alias("_ax"), F.col("_gz").alias("_az"), blocks.alias("_na"), F.col("_n").alias("_ca"), F.explode(half).alias("_o"))
    links = links.select(*keys, "_ax", "_az", "_na", "_ca", (F.col("_ax") + F.col("_o")["i"]).alias("_bx"), (F.col("_az") + F.col("_o")["j"]).alias("_bz"))
    links = links.join(cells.select(*keys, F.col("_gx").alias("_bx"), F.col("_gz").alias("_bz"), blocks.alias("_nb"), F.col("_n").alias("_cb")),
                       [*keys, "_bx", "_bz"]).withColumn("_own", F.expr("_ax = _bx and _az = _bz")).checkpoint()
    pairs = links.agg(F.sum(F.col("_ca") * F.col("_cb").cast("double"))).first()[0] or 0
    tasks = min(max(many, math.ceil(pairs / _PAIRS_A_TASK)), 1 << 15)
    meet = [*keys, "_ax", "_az", "_bx", "_bz", "_i", "_j"]
    links = links.drop("_ca", "_cb")

    def side(s: str) -> DataFrame:
        at = pts.withColumnsRenamed({"_gx": f"_{s}x", "_gz": f"_{s}z", **{c: f"{s}_{c}" for c in ("id", *"xyz")}}).join(links, [*keys, f"_{s}x", f"_{s}z"])
        mine, other = ("_i", "_j") if s == "a" else ("_j", "_i")
        at = at.withColumn(mine, F.expr(f"cast(pmod(xxhash64({s}_id), _n{s}) as int)"))
        # within a cell the lower block is side a
        reach = "sequence(if(_own, _i, 0), _nb - 1)" if s == "a" else "sequence(0, if(_own, _j, _na - 1))"
        at = at.withColumn(other, F.explode(F.expr(reach)))
        return at.select(*meet, *(["_own"] if s == "a" else []), *[f"{s}_{c}" for c in ("id", *"xyz")]).repartition(tasks, *meet)

    # a block meets itself both ways round
    met = side("a").join(side("b").hint(JOIN), meet).filter("a_id < b_id or (a_id > b_id and not (_own and _i = _j))")
    dist = g.distance([F.col(f"b_{c}") for c in "xyz"], [F.col(f"a_{c}") for c in "xyz"])
    swap = F.col("a_id") > F.col("b_id")
    pick = lambda yes, no: F.struct(*[F.when(swap, F.col(f"{yes}_{c}")).otherwise(F.col(f"{no}_{c}")).alias(c) for c in ("id", *"xyz")])
    return met.filter(dist < radius).select(*keys, pick("b", "a").alias("s"), pick("a", "b").alias("t"), dist.alias("dist"))


def spatial_edges(obs: DataFrame, max_dist: float = 10.0, variant: str = "paper",
                  keys: list[str] = FRAME, obj: str = "object_id") -> DataFrame:
    """Edges between objects closer than ``max_dist``: relation, distance, unit direction."""
    p = near_pairs(obs, max_dist, keys, obj)
    dx, dy, dz = (F.col(f"t.{c}") - F.col(f"s.{c}") for c in "xyz")
    dist = F.col("dist")
    return p.select(*keys, F.col("s.id").alias("src"), F.col("t.id").alias("dst"), "dist",
                    g.relation_label(dx, dy, dz, dist, variant).alias("relation"),
                    *[(c / (dist + F.lit(1e-8))).alias(n) for c, n in zip((dx, dy, dz), ("ux", "uy", "uz"))])


def top_k_edges(edges: DataFrame, k: int, keys: list[str] = FRAME) -> DataFrame:
    """The first k edges of each frame, in id order."""
    w = Window.partitionBy(*keys).orderBy("src", "dst")
    return edges.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def first_edges(obs: DataFrame, k: int, max_dist: float = 10.0, variant: str = "paper",
                keys: list[str] = FRAME, obj: str = "object_id") -> DataFrame:
    """``top_k_edges`` of ``spatial_edges``, without making the edges that are not among the first k.

    Edges count in order of their source, so sources are taken by their id in blocks that double: a
    frame needs no further block once it has k edges, and a crowded one has them after the first.
    Where edges are rare all sources come up, each once. The driver sees how many frames are left.
    """
    ensure_checkpoint_dir(obs.sparkSession)
    pts = obs.select(*keys, F.col(obj).alias("id"), "x", "y", "z").filter(F.col("id").isNotNull())
    ranks = global_row_number(pts.select(*keys, "id").distinct(), keys, "id", name="_rank", count="_of")
    pts = pts.join(ranks, [*keys, "id"]).checkpoint()
    right = pts.select(*keys, "id", *[F.col(c).alias(f"r{c}") for c in "xyz"])
    first = Window.partitionBy(*keys).orderBy("src", "dst")
    left, found, done, size = pts, None, 0, k
    while True:
        block = left.filter((F.col("_rank") > done) & (F.col("_rank") <= done + size))
        met = grid_join(block.select(*keys, F.col("id").alias("src"), *[F.col(c).alias(f"l{c}") for c in "xyz"]),
                        right.withColumnRenamed("id", "dst"), keys, max_dist).filter("src < dst")
        dx, dy, dz = (F.col(f"r{c}") - F.col(f"l{c}") for c in "xyz")
        dist = F.col("dist")
        edges = met.select(*keys, "src", "dst", "dist", g.relation_label(dx, dy, dz, dist, variant).alias("relation"),
                           *[(c / (dist + F.lit(1e-8))).alias(n) for c, n in zip((dx, dy, dz), ("ux", "uy", "uz"))])
        edges = edges.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= k).drop("_rn")
        found = (edges if found is None else found.unionByName(edges)).checkpoint()
        done, size = done + size, 2 * size
        full = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= k)
        left = pts.filter(F.col("_of") > done).join(full, keys, "left_anti")
        if not left.limit(1).count():
            return top_k_edges(found, k, keys)


def _morton(cols: list[Column], bits: int = 10) -> Column:
    """Interleaved bits of three small whole numbers: near in space, mostly near in order."""
    code = F.lit(0).cast("bigint")
    for axis, c in enumerate(cols):
        for bit in range(bits):
            one = F.shiftright(c, bit).bitwiseAND(F.lit(1).cast("bigint"))
            code = code.bitwiseOR(F.shiftleft(one, 3 * bit + axis))
    return code


def nearest(obs: DataFrame, k: int, keys: list[str] = FRAME, obj: str = "object_id",
            bucket: int = 4096) -> DataFrame:
    """The k nearest other objects of each object in its frame, exactly, without all pairs.

    1. Order each frame along a space-filling curve; the k neighbours on either
       side bound the true k-th distance from above.
    2. Search a grid whose cell is the next power of two above that bound: the 27
       cells around an object hold all that can be nearer.
    Small bounds search fine grids, so dense regions do not meet as a whole.
    """
    pts = obs.select(*keys, F.col(obj).alias("id"), "x", "y", "z")
    box = pts.groupBy(*keys).agg(*[f(c).alias(f"_{n}{c}") for c in "xyz" for n, f in (("l", F.min), ("h", F.max))])
    scaled = [F.floor((F.col(c) - F.col(f"_l{c}")) / F.greatest(F.col(f"_h{c}") - F.col(f"_l{c}"), F.lit(1e-9))
                      * 1023).cast("bigint") for c in "xyz"]
    curve = pts.join(box, keys).select(*pts.columns, _morton(scaled).alias("_m"))
    # the rank is stretched by the curve code itself: 2^30 codes over 2^12 stretches
    ranked = global_row_number(curve, keys, "_m", ["id"], name="_rn", bucket=1 << 18).drop("_m")
    offsets = F.array(*[F.lit(o) for o in range(-k, k + 1) if o])
    a = ranked.withColumn("_o", F.explode(offsets)).select(
        *keys, "id", "x", "y", "z", (F.col("_rn") + F.col("_o")).alias("_rn"))
    b = ranked.select(*keys, "_rn", *[F.col(c).alias(f"r{c}") for c in "xyz"])
    own, other = [F.col(c) for c in "xyz"], [F.col(f"r{c}") for c in "xyz"]
    dist = g.distance(other, own)
    bound = (a.join(b, [*keys, "_rn"]).groupBy(*keys, "id", "x", "y", "z")
             .agg(F.sort_array(F.collect_list(dist)).alias("_d"))  # at most 2k values
             .withColumn("_r", F.element_at("_d", F.least(F.size("_d"), F.lit(k)))).drop("_d"))
    level = F.floor(F.log2(F.greatest(F.col("_r"), F.lit(1e-6)))) + 1
    q = bound.withColumn("_lv", level.cast("int"))
    cube = F.array(*[F.struct(*[F.lit(o).alias(n) for o, n in zip(off, "ijk")])
                     for off in product((-1, 0, 1), repeat=3)])
    size = F.pow(F.lit(2.0), F.col("_lv"))
    q = q.withColumn("_o", F.explode(cube)).select(
        *keys, "_lv", F.col("id").alias("src"), "x", "y", "z", "_r",
        *[(_cell(c, size) + F.col("_o")[n]).alias(f"_g{c}") for c, n in zip("xyz", "ijk")])
    levels = bound.select(*keys, level.cast("int").alias("_lv")).distinct()
    data = pts.join(levels, keys).select(
        *keys, "_lv", F.col("id").alias("dst"), *[F.col(c).alias(f"r{c}") for c in "xyz"],
        *[_cell(c, size).alias(f"_g{c}") for c in "xyz"])
    met = q.join(data, [*keys, "_lv", "_gx", "_gy", "_gz"]).filter(F.col("src") != F.col("dst"))
    met = met.withColumn("dist", dist).filter(F.col("dist") <= F.col("_r"))
    w = Window.partitionBy(*keys, "src").orderBy("dist", "dst")
    return (met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select(*keys, "src", "dst", "rank", "dist", (F.col("rx") - F.col("x")).alias("dx"),
                    (F.col("ry") - F.col("y")).alias("dy"), (F.col("rz") - F.col("z")).alias("dz")))


def knn_edges(obs: DataFrame, k: int = 3, cap: int = 20, keys: list[str] = FRAME, obj: str = "object_id",
              elev_threshold: float = 0.5) -> DataFrame:
    """Each object's k nearest as edges; the ``cap`` shortest of each frame, by distance.

    ``dir`` is the sector of the other object seen along the forward axis, ``elev``
    compares heights; the vertical axis points down.
    """
    e = nearest(obs, k, keys, obj)
    w = Window.partitionBy(*keys).orderBy("dist", "src", "dst")
    e = e.withColumn("order", F.row_number().over(w)).filter(F.col("order") <= cap)
    deg = F.degrees(F.atan2(-F.col("dx"), F.col("dz")))
    return e.select(*keys, "order", "src", "dst", "dist", g.bearing_8way(deg).alias("dir"),
                    g.elevation(-F.col("dy"), elev_threshold).alias("elev"))


def latest_frame(obs: DataFrame) -> DataFrame:
    """Rows of the last frame of each video."""
    last = obs.groupBy("video_id").agg(F.max("frame_idx").alias("frame_idx"))
    return obs.join(last, FRAME, "left_semi")


def ego_relations(obs: DataFrame, frames: DataFrame, elev_threshold: float = 0.5,
                  obj: str = "object_id") -> DataFrame:
    """Bearing, elevation and distance of each object from the camera of its frame."""
    d = obs.join(frames.select(*FRAME, "t_wc"), FRAME)
    p = g.transform_point([F.col(c) for c in "xyz"], F.col("t_wc"))
    d = d.select(*FRAME, F.col(obj), *[c.alias(n) for c, n in zip(p, ("_x", "_y", "_z"))])
    deg = F.degrees(F.atan2(-F.col("_x"), F.col("_z")))
    return d.select(*FRAME, obj, g.bearing_8way(deg).alias("bearing"),
                    g.elevation(-F.col("_y"), elev_threshold).alias("elev"),
                    g.norm([F.col("_x"), F.col("_y"), F.col("_z")]).alias("dist_m"),
                    (-F.col("_x")).alias("side"))


_SHAPE = [f"{a}_{m}" for a in "xyz" for m in ("sigma", "min", "max")]


def associate_frames(obs: DataFrame, frames: DataFrame, threshold: float = 2.0, geometric: float = 0.5,
                     semantic: float = 0.5, obj: str = "object_id", matching: str = "mutual") -> DataFrame:
    """Objects of one frame matched to those of the frame before, below a cost: mutual best, or ``least`` total cost.

    Cost: geometric*(centroid distance + 0.1*shape distance) + semantic*(1 - token
    overlap). A cost below the threshold bounds the centroid distance, which the
    grid join uses; a mutual best over all pairs is one over the gated pairs.
    """
    # cells as numbers, once per object and not once per pair
    d = obs.withColumn("_codes", token_codes(F.col("tau"))).join(frame_ordinals(frames), FRAME)
    pos = dict(zip("xyz", ("cx", "cy", "cz")))
    side = lambda s, shift: d.select(
        "video_id", (F.col("ord") + shift).alias("ord"),
        F.col("frame_idx").alias(f"{s}_frame"), F.col(obj).alias(f"{s}_id"),
        *[F.col(pos[c]).alias(f"{s}{c}") for c in "xyz"],
        F.struct(*_SHAPE).alias(f"{s}_s"), F.col("_codes").alias(f"{s}_tau"))
    met = grid_join(side("l", 0), side("r", 1), ["video_id", "ord"], threshold / geometric, cell=4.0)
    sq = None
    for c in "xyz":
        t = (F.col(f"l{c}") - F.col(f"r{c}")) ** 2
        sq = t if sq is None else sq + t
    for m in _SHAPE:
        sq = sq + (F.col("l_s")[m] - F.col("r_s")[m]) ** 2
    place = F.lit(geometric) * (F.col("dist") + F.lit(0.1) * F.sqrt(sq))
    # tokens are compared once, and only where the place leaves room: a row generated is not worked out again by filters
    met = met.filter(place < threshold) if semantic >= 0 else met
    shared = F.array(F.size(F.array_intersect("l_tau", "r_tau")))
    cost = F.transform(shared, lambda n: place + F.lit(semantic) * (F.lit(1.0) - codes_jaccard(F.col("l_tau"), F.col("r_tau"), n)))
    met = met.withColumn("cost", F.explode(cost)).filter(F.col("cost") < threshold).select(
        "video_id", "ord", "l_frame", "r_frame", "l_id", "r_id", "cost")
    if matching == "least":
        met = least_cost(met, ["video_id", "ord", "l_frame", "r_frame"], "r_id", "l_id", "cost", threshold)
    else:
        met = mutual_best(met, ["video_id", "ord"], "r_id", "l_id", "cost")
    return met.select(
        "video_id", F.col("r_frame").alias("prev_frame"), F.col("l_frame").alias("frame_idx"),
        F.col("r_id").alias("prev_id"), F.col("l_id").alias("object_id"), "cost")


def mutual_best(pairs: DataFrame, keys: list[str], a: str, b: str, cost: str) -> DataFrame:
    """Pairs that are the cheapest choice of both sides; ties go to the smaller id.

    Both ranks are taken over the same rows, so the pairs are worked out once.
    """
    wa = Window.partitionBy(*keys, a).orderBy(cost, b)
    wb = Window.partitionBy(*keys, b).orderBy(cost, a)
    ranked = pairs.withColumn("_ra", F.row_number().over(wa)).withColumn("_rb", F.row_number().over(wb))
    return ranked.filter("_ra = 1 and _rb = 1").drop("_ra", "_rb")


def match_views(obs: DataFrame, max_dist: float = 5.0, obj: str = "object_id", matching: str = "mutual") -> DataFrame:
    """Objects seen by two cameras in one frame, matched by distance: mutual best, or ``least`` total distance.

    Objects without an id, a view or a place take no part. Of the pairs within the distance only the best of each object in
    two blocks that meet leave their task (``best_pairs``): rows follow the objects and the blocks they meet, not the pairs.
    """
    both = _two_views(obs, max_dist, obj)
    links, tasks = meetings(both, _VIEWS)
    if matching == "least":
        return _least_views(both, links, tasks, max_dist)
    found = best_pairs(both, links, tasks, _VIEWS, closest(max_dist))
    own, other = (F.when(F.col("by_left"), F.col(f"{a}_id")).otherwise(F.col(f"{b}_id")) for a, b in ("lr", "rl"))
    best = found.select(*_VIEWS, "by_left", own.alias("_own"), F.struct("dist", other.alias("other")).alias("_b"))
    best = best.groupBy(*_VIEWS, "by_left", "_own").agg(F.min("_b").alias("_b"))
    left = F.col("by_left")
    ends = (F.when(left, F.col("_own")).otherwise(F.col("_b.other")).alias("l_id"), F.when(left, F.col("_b.other")).otherwise(F.col("_own")).alias("r_id"))
    # a pair that both sides named
    named = best.select(*_VIEWS, *ends, F.col("_b.dist").alias("dist")).groupBy(*_VIEWS, "l_id", "r_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("dist").alias("dist"))
    return named.filter("_n = 2").select(*_VIEWS, "l_id", "r_id", "dist")


_VIEWS = [*FRAME, "l_view", "r_view"]


def _two_views(obs: DataFrame, max_dist: float, obj: str) -> DataFrame:
    """The objects of every two views of a frame, with the side they are on and their cell."""
    ensure_checkpoint_dir(obs.sparkSession)
    pts = obs.select(*FRAME, "view", F.col(obj).alias("id"), *[F.col(c).cast("double").alias(c) for c in "xyz"]).filter(
        " and ".join([f"{k} is not null" for k in [*FRAME, "view", "id"]] + [f"abs({c}) < double('infinity')" for c in "xyz"])).checkpoint()
    views = pts.select(*FRAME, "view").distinct()
    two = views.withColumnRenamed("view", "l_view").join(views.withColumnRenamed("view", "r_view"), FRAME).filter("l_view < r_view")
    both = pts.join(two, FRAME).filter("view = l_view or view = r_view").withColumn("left", F.col("view") == F.col("l_view"))
    return in_cells(both.drop("view"), max_dist).checkpoint()


#: Near objects an object starts with, and pairs it gets in a round of ``_least_views``.
_FEW = 12


def _least_views(both: DataFrame, links: DataFrame, tasks: int, max_dist: float) -> DataFrame:
    """The least total distance over all pairs of two views, out of few pairs for each object.

    Objects start with their nearest ones. What a matching of these charges its objects shows
    which other pairs could make it cheaper; each object gets the best of them, until there are
    none (by more than rounding): the matching is then the cheapest of all pairs. The test runs through
    all pairs within the distance, block by block, but keeps and shuffles none that does not come in.
    """
    ends = ["l_id", "r_id"]

    def few(points: DataFrame) -> DataFrame:
        """The pairs that fall furthest below what their objects are charged, some for each left object."""
        met = best_pairs(points, links, tasks, _VIEWS, cheaper(max_dist, _FEW), "price")
        best = Window.partitionBy(*_VIEWS, "l_id").orderBy(F.desc("_gain"), "r_id")
        met = met.withColumn("_gain", F.col("price") - F.col("dist")).withColumn("_rn", F.row_number().over(best))
        return met.filter(F.col("_rn") <= _FEW).select(*_VIEWS, *ends, "dist")

    free = F.when(F.col("left"), F.lit(float(max_dist))).otherwise(0.0)
    pairs, state = written(few(both.withColumn("price", free))), ["chosen", "pays", "takes"]
    while True:
        found = written(least_cost(pairs, _VIEWS, *ends, "dist", max_dist, priced=True))
        charged = found.select(*_VIEWS, F.explode(F.array(
            F.struct(F.lit(True).alias("left"), F.col("l_id").alias("id"), F.col("pays").alias("price")),
            F.struct(F.lit(False).alias("left"), F.col("r_id").alias("id"), F.col("takes").alias("price")))).alias("_c")).select(*_VIEWS, "_c.*")
        charged = charged.groupBy(*_VIEWS, "left", "id").agg(F.first("price").alias("price"))
        priced = written(both.join(charged, [*_VIEWS, "left", "id"], "left").withColumn("price", F.coalesce("price", free)))
        more = written(few(priced).join(found.select(*_VIEWS, *ends), [*_VIEWS, *ends], "left_anti"))
        discard(pairs, priced)
        if more.isEmpty():
            return found.filter("chosen").select(*_VIEWS, *ends, "dist")
        # the matching goes on from what the last one found
        pairs = written(found.select(*_VIEWS, *ends, "dist", *state).unionByName(more, allowMissingColumns=True))
        discard(found, more)


def project_points(points: DataFrame, cams: DataFrame, height: int, width: int, keys: list[str] = FRAME) -> DataFrame:
    """World points in image coordinates of each camera of the key, with a validity flag."""
    d = points.join(cams, keys)
    p = g.transform_point([F.col(c) for c in "xyz"], F.col("t_wc"))
    img = g.apply3(g.cells(F.col("k"), 9), p)
    z = F.when(img[2] == 0, F.lit(1e-8)).otherwise(img[2])
    d = d.withColumn("img_x", img[0] / z).withColumn("img_y", img[1] / z)
    ok = ((p[2] > 0) & (F.col("img_x") >= 0) & (F.col("img_x") < width)
          & (F.col("img_y") >= 0) & (F.col("img_y") < height))
    return d.withColumn("valid", ok).drop("k", "t_wc")


def assign_points(points: DataFrame, spans: DataFrame, point: str = "point_id", tile: int = 64) -> DataFrame:
    """The first mask holding each projected point (whole pixel), -1 for none.

    Runs are cut at tile borders, so a point asks one (line, tile). The final
    pick groups by the join key and the point, which needs no second shuffle.
    """
    s = spans.filter("u1 > u0").withColumn("tile", F.explode(F.sequence(
        F.floor(F.col("u0") / tile).cast("int"), F.floor((F.col("u1") - 1) / tile).cast("int"))))
    s = s.select(*FRAME, "v", "tile", "u0", "u1", "det_seq")
    p = points.withColumn("v", F.col("img_y").cast("int")).withColumn("_u", F.col("img_x").cast("int"))
    p = p.withColumn("tile", F.floor(F.col("_u") / tile).cast("int")).select(*FRAME, "v", "tile", point, "_u")
    key = [*FRAME, "v", "tile"]
    on = [p[c] == s[c] for c in key] + [p["_u"] >= s["u0"], p["_u"] < s["u1"]]
    hit = p.join(s, on, "left").select(*[p[c] for c in [*key, point, "_u"]], s["det_seq"])
    return (hit.groupBy(*key, point, "_u").agg(F.min("det_seq").alias("_m"))
            .select(*FRAME, point, F.coalesce("_m", F.lit(-1).cast("bigint")).alias("det_seq")))


def object_history(obs: DataFrame, object_id: int) -> DataFrame:
    return obs.filter(F.col("object_id") == object_id)


def objects_at(obs: DataFrame, frame_idx: int) -> DataFrame:
    return obs.filter(F.col("frame_idx") == frame_idx)


def relations_at(edges: DataFrame, frame_idx: int) -> DataFrame:
    return edges.filter(F.col("frame_idx") == frame_idx)


def foreground(obs: DataFrame, n: int, keys: list[str] = ("video_id",), obj: str = "object_id") -> DataFrame:
    """The n objects of each video with the least median depth."""
    med = percentiles(obs, [*keys, obj], "z", {"median_z": 0.5})
    w = Window.partitionBy(*keys).orderBy("median_z", obj)
    return med.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def depth_rank(obs: DataFrame, n: int, keys: list[str] = FRAME, obj: str = "object_id") -> DataFrame:
    """Rank by depth (1 = nearest) and order from left to right, in frames showing n objects."""
    per = obs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n).drop("_n")
    full = obs.join(per, list(keys), "left_semi")
    by_z = global_row_number(full, list(keys), "z", [obj], name="z_rank", bucket=1)
    return global_row_number(by_z, list(keys), "x", [obj], name="x_order", bucket=1)


def rank_changes(ranks: DataFrame, bucket: int = 4096) -> DataFrame:
    """Frames whose left-to-right depth ranking differs from the last ranked frame."""
    seq = ranks.groupBy(*FRAME).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("x_order", "z_rank"))), lambda s: s["z_rank"]).alias("ranking"))
    d = with_previous(seq, ["video_id"], "frame_idx", "ranking", "_p", bucket=bucket)
    return d.select(*FRAME, F.array_join(F.col("ranking").cast("array<string>"), ",").alias("ranking"),
                    (F.col("_p").isNotNull() & (F.col("_p") != F.col("ranking"))).alias("changed"))
