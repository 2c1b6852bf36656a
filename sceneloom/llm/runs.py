"""Periodic runs of words: found by seed and extend on diagonals, and collapsed to one period.

A run is a stretch of words with smallest period q, of ``min_length`` words and
``min_periods`` periods at least, that no neighbour extends. The words i and i + q of such
a stretch agree on max(min_length, min_periods q) - q places in a row, its guaranteed
overlap. Lags are taken in classes 1, 2, 3-4, 5-8 ...; each class indexes the word k-grams
of the least overlap its lags guarantee. As k is no less than the lag, a k-gram inside a run
of period q comes back q words later and not before, so the seeds of a class are pairs of
*neighbouring* occurrences at a lag of the class: never more than there are words. A seed
is extended both ways on its diagonal unless the furthest place covered for its lag lies
beyond it. For the same reason a stretch found has no smaller period.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneloom.llm.common import slices
from sceneloom.llm.wordhash import owners


def _repeated(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """For the keys at the places ``among`` their rank, for all else and for keys that occur once -1."""
    rank = np.full(len(keys), -1, np.int64)
    _, inverse, times = np.unique(keys[among], return_inverse=True, return_counts=True)
    again = times[inverse] > 1
    rank[among[again]] = inverse[again]
    return rank


def _joined(rank: np.ndarray, shift: int) -> np.ndarray:
    """Ranks of the pairs (place, place + shift) of which both parts are repeated."""
    first = np.flatnonzero(rank[:max(len(rank) - shift, 0)] >= 0)
    first = first[rank[first + shift] >= 0]
    keys = np.zeros(len(rank), np.int64)
    keys[first] = rank[first] * (int(rank.max(initial=0)) + 1) + rank[first + shift]
    return _repeated(keys, first)


def _agreeing(ids: np.ndarray, at: int, lag: int, stop: int, step: int) -> int:
    """How many words from ``at`` on (in direction ``step``, before ``stop``) equal those ``lag`` further."""
    total, size = 0, 32
    while True:
        size = min(size, abs(stop - at))
        if not size:
            return total
        here = ids[at:at + size] if step > 0 else ids[at - size + 1:at + 1][::-1]
        there = ids[at + lag:at + lag + size] if step > 0 else ids[at + lag - size + 1:at + lag + 1][::-1]
        differ = np.flatnonzero(here != there)
        if len(differ):
            return total + int(differ[0])
        total, at, size = total + size, at + step * size, size * 2


def find_runs(ids: np.ndarray, at: np.ndarray, min_length: int = 6, min_periods: int = 4) -> list[tuple[int, int, int, int]]:
    """(list, start, length, period) of all runs in lists of word numbers that begin at ``at`` (one entry more than lists)."""
    if min_periods < 3:
        raise ValueError("a run has three periods at least")
    longest = int(np.diff(at).max(initial=0))
    if not len(ids):
        return []
    own = owners(at)
    rank = _repeated(own * (int(ids.max()) + 1) + ids, np.arange(len(ids)))
    width, found = 1, []
    covered: dict[tuple[int, int], int] = {}
    low, high = 1, 1
    while max(min_length, min_periods * low) <= longest:
        turn = min(max(min_length // min_periods, low), high)
        k = min(max(min_length, min_periods * q) - q for q in (low, turn, min(turn + 1, high)))
        while 2 * width <= k:
            rank, width = _joined(rank, width), 2 * width
        gram = _joined(rank, k - width) if k > width else rank
        place = np.flatnonzero(gram >= 0)
        place = place[np.argsort(gram[place], kind="stable")]
        lag = np.diff(place)
        near = (gram[place[1:]] == gram[place[:-1]]) & (lag >= low) & (lag <= high)
        seed, lag = place[:-1][near], lag[near]
        order = np.lexsort((seed, lag))
        seed, lag = seed[order], lag[order]
        # a seed right behind one of its lag lies in what that one covers
        head = np.ones(len(seed), bool)
        head[1:] = (np.diff(seed) != 1) | (np.diff(lag) != 0)
        for a, q in zip(seed[head].tolist(), lag[head].tolist()):
            doc = int(own[a])
            if a < covered.get((doc, q), 0):
                continue
            left = a - _agreeing(ids, a - 1, q, int(at[doc]) - 1, -1)
            right = a + k + _agreeing(ids, a + k, q, int(at[doc + 1]) - q, 1)
            covered[doc, q] = right
            if right + q - left >= max(min_length, min_periods * q):
                found.append((doc, left - int(at[doc]), right + q - left, q))
        if not (rank >= 0).any():
            break
        low, high = high + 1, 2 * high
    found.sort(key=lambda r: (r[0], r[1], r[3]))
    return found


def periodic_runs(docs: DataFrame, min_length: int = 6, min_periods: int = 4) -> DataFrame:
    """Every row as ``_row`` (its columns but the text), n_words, its runs and the text collapsed.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. ``runs`` holds (start, length, period) by
    start, then period. ``collapsed`` is the words that stay, joined by one space: a word goes if
    any run contains it behind that run's first period. A null or empty text has no words, no
    runs and an empty collapsed text. Texts of any length are taken whole, one row at a time;
    repeated rows are judged each for itself, further columns of any name travel in ``_row``, and
    an empty table gives no row.
    """

    def run(batches):
        for part in slices(batches):
            texts = pc.fill_null(part.column("text"), "")
            split = pc.ascii_split_whitespace(texts)
            words, own = pc.list_flatten(split), pc.list_parent_indices(split)
            full = pc.greater(pc.binary_length(words), 0)
            words, own = words.filter(full), own.filter(full).to_numpy()
            at = np.searchsorted(own, np.arange(part.num_rows + 1))
            coded = pc.dictionary_encode(words)
            ids = coded.indices.to_numpy().astype(np.int64) if len(words) else np.zeros(0, np.int64)
            found = find_runs(ids, at, min_length, min_periods)
            stays = np.ones(len(words), bool)
            for doc, start, length, period in found:
                stays[at[doc] + start + period:at[doc] + start + length] = False
            table = np.array(found, np.int64).reshape(-1, 4)
            runs = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(table[:, 0], np.arange(part.num_rows + 1)), pa.int32()),
                pa.StructArray.from_arrays([pa.array(table[:, i]) for i in (1, 2, 3)], ["start", "length", "period"]))
            before = np.concatenate(([0], np.cumsum(stays)))
            left = pa.ListArray.from_arrays(pa.array(before[at], pa.int32()), words.filter(pa.array(stays)))
            yield pa.RecordBatch.from_arrays(
                [part.column("_row"), pa.array(np.diff(at)), runs, pc.binary_join(left, " ")], ["_row", "n_words", "runs", "collapsed"])

    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select((F.struct(*others) if others else F.struct(F.lit(None).cast("int").alias("_"))).alias("_row"), "text")
    kind = rows.schema["_row"].dataType.simpleString()
    return rows.mapInArrow(run, f"_row {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def collapse_runs(docs: DataFrame, min_length: int = 6, min_periods: int = 4) -> DataFrame:
    """The rows of ``docs`` with every run in their texts cut to its first period (and white space made single spaces)."""
    found = periodic_runs(docs, min_length, min_periods)
    return found.select(*(F.col("collapsed").alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns))
