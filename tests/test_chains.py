"""Pointer doubling over chains and trees of links."""

import random

from pyspark.sql import functions as F

from sceneloom.operators import chains
from sceneloom.streaming import live


def test_chain_ends_of_random_forests(spark):
    rng = random.Random(5)
    links = [(g, n, rng.randrange(n), [f"{g}/{n}"]) for g in range(3) for n in range(1, 60)]
    up = {(g, n): u for g, n, u, _ in links}
    got = {(r.g, r.node): (r.root, r.path) for r in chains.chain_ends(
        spark.createDataFrame(links, "g int, node int, up int, path array<string>"), ["g"]).collect()}
    for (g, n) in up:
        path, at = [], n
        while (g, at) in up:
            path.insert(0, f"{g}/{at}")
            at = up[g, at]
        assert got[g, n] == (at, path)
    assert chains.chain_ends(spark.createDataFrame([], "g int, node int, up int, path array<string>"), ["g"]).count() == 0


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(chains, "discard", lambda *d: rounds.append(1))
    n = 1000
    log = spark.range(n).select(F.lit(1).cast("long").alias("video_id"), F.col("id").alias("frame_idx"), F.col("id").alias("object_id"), (F.col("id") + 1).alias("other_id"))
    got = live.absorbed(log).collect()
    assert len(got) == n and all(r.root == 0 and len(r.path) == r.object_id and r.path[-1].gone == r.object_id for r in got)
    assert len(rounds) <= 11
