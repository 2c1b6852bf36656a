"""Periodic runs of words against a search of all lags."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sceneloom.llm import queries, runs


def plain_runs(words, min_length=6, min_periods=4):
    """All maximal stretches of every lag; a stretch belongs to the smallest lag that explains all of it."""
    out, n = [], len(words)
    for q in range(1, n // min_periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j + q - i
            stretch = words[start:start + length]
            if length >= max(min_length, min_periods * q) and not any(
                    all(stretch[x] == stretch[x + p] for x in range(length - p)) for p in range(1, q)):
                out.append((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(texts, **how):
    at = np.cumsum([0] + [len(t) for t in texts])
    ids = np.array([w for t in texts for w in t], np.int64)
    got = runs.find_runs(ids, at, **how)
    return [[(s, n, q) for d, s, n, q in got if d == i] for i in range(len(texts))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4))
def test_runs_of_few_words(texts):
    assert found(texts) == [plain_runs(t) for t in texts]
    assert found(texts, min_length=9, min_periods=3) == [plain_runs(t, 9, 3) for t in texts]


@pytest.mark.parametrize("seed", range(6))
def test_planted_runs(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(5):
        t = []
        while len(t) < 260:
            root = [rng.randrange(4) for _ in range(rng.randint(1, 30))]
            t += (root * rng.randint(1, 6))[rng.randrange(len(root)):]
            t += [rng.randrange(9) for _ in range(rng.randrange(3))]
        texts.append(t)
    assert found(texts) == [plain_runs(t) for t in texts]


def digest(doc_id, text):
    words = (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else None
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    every = plain_runs(words)
    gone = {i for s, k, q in every for i in range(s + q, s + k)}
    best = min(every, key=lambda r: (-r[1] / r[2], r[0], r[2])) if every else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(every), *best, 1000 * best[1] // best[2] if every else None, sha("".join("%d,%d,%d\n" % r for r in every)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice([" ", "\n", "\t ", "\x0b"]).join(rng.choice("a b c the é 日 x.".split()) for _ in range(rng.randint(0, 70)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \n "), (None, "no id " * 9), (None, None), (203, "a " * 3000), rows[4], rows[4], (204, "x y " * 12)]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, runs int").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.op11(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((digest(*r) for r in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 10


def test_collapse_keeps_other_columns(spark):
    docs = spark.createDataFrame([(1, "say " + "a b " * 5 + "c", "mine"), (2, None, None)], "doc_id long, text string, runs string")
    assert [tuple(r) for r in runs.collapse_runs(docs).orderBy("doc_id").collect()] == [(1, "say a b c", "mine"), (2, "", None)]
    assert runs.periodic_runs(docs.limit(0)).count() == 0
