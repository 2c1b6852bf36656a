"""Connected components of large edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneloom.session import discard, ensure_checkpoint_dir


def components(edges: DataFrame) -> DataFrame:
    """Label of every node of an undirected edge table (group, a, b): group, node, label.

    The label is the smallest node of the component. Large-star and small-star steps in
    turn hang neighbours under the smallest one they know until every component is a
    star; the number of rounds grows with the logarithm of the largest component. A
    node's neighbours are never gathered: each step is one minimum per node, joined back
    to its edges, and a join with a busy node splits. Lineage is cut by a checkpoint every
    round, which deletes the one before; the driver sees the number of edges and a checksum of them.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    mark = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("group", "a", "b")).alias("x")]
    now = (edges.filter("a <> b").select("group", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
           .distinct().checkpoint())
    before = now.agg(*mark).first()
    while before.n:
        # large star: the larger neighbours of a node move to the smallest of all it knows
        both = now.unionByName(now.select("group", F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("group", "a").agg(F.min("b").alias("_m")).select("group", "a", F.least("_m", "a").alias("_m"))
        large = (both.filter("b > a").join(low, ["group", "a"])
                 .select("group", F.col("b").alias("a"), F.col("_m").alias("b")))
        # small star: a node and its smaller neighbours move to the smallest of them
        low = large.groupBy("group", "a").agg(F.min("b").alias("_m"))
        small = (large.join(low, ["group", "a"])
                 .select("group", F.explode(F.array("a", "b")).alias("a"), F.col("_m").alias("b")).filter("a <> b").distinct())
        small = small.checkpoint()
        discard(now)
        now = small
        after = now.agg(*mark).first()
        if after == before:
            break
        before = after
    roots = now.select("group", F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.select("group", F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)


def merge_views(points: DataFrame, matches: DataFrame) -> DataFrame:
    """Points of matched objects pooled under one id.

    ``matches`` holds (video_id, a, b) over object ids, ``points`` any rows with
    (video_id, object_id); unmatched objects keep their own id.
    """
    ids = components(matches.select(F.col("video_id").alias("group"), "a", "b"))
    ids = ids.select(F.col("group").alias("video_id"), F.col("node").alias("object_id"), "label")
    return points.join(ids, ["video_id", "object_id"], "left").withColumn(
        "pooled_id", F.coalesce("label", "object_id")).drop("label")
