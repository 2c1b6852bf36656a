"""Ends of chains: where each node of a forest of upward links arrives, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneloom.session import discard, written


def chain_ends(links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, root, path) of links (keys, node, up, path): each node has one ``up``, and no cycle.

    ``path`` is an array that belongs to the link; along a chain the arrays are joined from the
    root down. Every round a node jumps to where its ``up`` points, so a chain of n links
    takes log2(n) rounds of one join each; a round's table replaces the one before it.
    """
    names = [*keys, "node", "up", "path"]
    now = written(links.select(*names, F.lit(True).alias("_moved")))
    while not now.filter("_moved").isEmpty():
        above = now.select(*keys, F.col("node").alias("up"), F.col("up").alias("_top"), F.col("path").alias("_path"))
        there = F.col("_path").isNotNull()
        step = written(now.drop("_moved").join(above, [*keys, "up"], "left").select(
            *keys, "node", F.when(there, F.col("_top")).otherwise(F.col("up")).alias("up"),
            F.when(there, F.concat("_path", "path")).otherwise(F.col("path")).alias("path"), there.alias("_moved")))
        discard(now)
        now = step
    return now.select(*keys, "node", F.col("up").alias("root"), "path")
