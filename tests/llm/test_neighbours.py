"""Nearest vectors against brute force."""

import math

import numpy as np
import pytest

from sceneloom.llm import neighbours, queries


def brute(rows, asked, k):
    """Every query against all rows; sums in plain Python."""
    out = {}
    for q, v in asked:
        every = sorted((math.sqrt(sum((float(a) - float(b)) ** 2 for a, b in zip(v, w))), i) for i, w in rows if i != q)
        out[q] = every[:k]
    return out


def as_lists(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    return {q: [(s, i) for _, s, i in sorted(x)] for q, x in got.items()}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(12, size=3000)] + 0.6 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[500:1500] = x[500]
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_search_of_all_leaves_is_exact(spark, rows, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 100)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 7)
    index = neighbours.build_index(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, leaf string"), leaf_rows=64)
    assert index.tree.leaves > 10 and sum(index.sizes.values()) == len(rows)
    asked = index.rows.filter("vec_id % 50 = 0").select("vec_id", "vec")
    got = as_lists(neighbours.search(index, asked, index.tree.leaves, 10))
    want = brute(rows, [r for r in rows if r[0] % 50 == 0], 10)
    assert {q: [i for _, i in x] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items()}
    assert all(abs(a[0] - b[0]) < 1e-12 for q in want for a, b in zip(got[q], want[q]))


def test_recall_is_calibrated(spark, rows):
    index = neighbours.build_index(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), leaf_rows=64)
    asked = index.rows.filter("vec_id % 10 = 0").select("vec_id", "vec")
    visits, found = neighbours.calibrate(index, asked, 10, 0.95)
    assert found >= 0.95 and visits < index.tree.leaves
    got = as_lists(neighbours.search(index, asked, visits, 10))
    want = brute(rows, [r for r in rows if r[0] % 10 == 0], 10)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.93 * sum(map(len, want.values()))


def test_given_vectors(spark):
    folder = "/root/testdata/sf0.01"
    got = as_lists(queries.op13(spark, folder))
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = brute(rows, [r for r in rows if r[0] % 100 == 0], 10)
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_odd_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    odd = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [None, 1.0]),
           (6, [nan, 1.0]), (7, [inf, 1.0]), (None, [1.0, 1.0]), (200, [0.0, 0.0]), (8, [1.0, 2.0, 3.0]), (300, None)]
    spark.createDataFrame(odd, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert as_lists(queries.op13(spark, str(tmp_path))) == {0: [(0.0, 100), (0.0, 100), (1.0, 1)], 100: [(0.0, 0), (1.0, 1)]}
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    assert queries.op13(spark, str(tmp_path / "none")).count() == 0
    spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "one" / "embeddings.parquet"))
    assert queries.op13(spark, str(tmp_path / "one")).count() == 0
