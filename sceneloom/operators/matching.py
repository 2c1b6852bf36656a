"""Least-cost one-to-one matching of gated pairs."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneloom.functions.batches import column
from sceneloom.operators.components import components
from sceneloom.session import written


def cheapest_matching(pairs: list[tuple[int, int, float]], limit: float) -> list[int]:
    """Places of the pairs (a, b, cost) of a one-to-one matching whose sum of (cost - limit) is least."""
    return priced_matching(pairs, limit)[0]


def priced_matching(pairs: list[tuple[int, int, float]], limit: float) -> tuple[list[int], dict, dict]:
    """``cheapest_matching``, with what each a pays and each b takes off: no pair costs less than both.

    A pair (a, b) that was not given can make the matching cheaper only if it costs less than
    ``pays[a] + takes[b]`` (``limit`` and 0 for those in no pair). Each a in turn is let in by the cheapest chain of re-matchings, or stays out at ``limit``;
    potentials keep reduced costs above zero, so each chain is one run of Dijkstra.
    """
    nodes_a = sorted({a for a, _, _ in pairs})
    out: dict[int, list[tuple[object, float, int]]] = {a: [] for a in nodes_a}
    for place, (a, b, cost) in enumerate(pairs):
        if cost <= limit:
            out[a].append((("b", b), cost, place))
    for a in nodes_a:
        out[a].append((("own", a), limit, -1))  # a place of its own: staying out
    owner: dict = {}
    chosen: dict[int, tuple] = {}
    price: dict = {}
    profit: dict[int, float] = {}
    for start in nodes_a:
        profit[start] = min(c - price.get(t, 0.0) for t, c, _ in out[start])
        best, via, done, heap, n = {}, {}, {}, [(0.0, 0, start)], 1
        end = None
        while heap:
            d, _, a = heapq.heappop(heap)
            if isinstance(a, tuple):
                if a in done:
                    continue
                done[a] = d
                if a not in owner:
                    end = a
                    break
                heapq.heappush(heap, (d, n, owner[a]))
                n += 1
                continue
            for target, cost, place in out[a]:
                step = d + max(cost - profit[a] - price.get(target, 0.0), 0.0)
                if target not in done and step < best.get(target, float("inf")):
                    best[target], via[target] = step, (a, place)
                    heapq.heappush(heap, (step, n, target))
                    n += 1
        total = done[end]
        for target, d in done.items():
            if target in owner:
                profit[owner[target]] += total - d
            price[target] = price.get(target, 0.0) - (total - d)
        profit[start] += total
        target = end
        while True:
            a, place = via[target]
            before = chosen.get(a)
            owner[target], chosen[a] = a, (target, place)
            if a == start:
                break
            target = before[0]
    takes = {t[1]: p for t, p in price.items() if t[0] == "b"}
    return sorted(place for _, place in chosen.values() if place >= 0), profit, takes


def repaired_matching(pairs: list[tuple[int, int, float]], limit: float, chosen: list[int], pays: dict, takes: dict) -> tuple[list[int], dict, dict]:
    """``priced_matching`` from the matching and prices found for some of the pairs: only what further pairs make cheaper is matched again.

    An a that some pair suits better than it pays leaves its place, and the cheapest chain of re-matchings leads back to that
    place: over others that move on, objects that go out or come in. Such a chain may pass ``None``, which stands for all that is out.
    """
    out: dict = {}
    for place, (a, b, cost) in enumerate(pairs):
        out.setdefault(a, [])
        if cost <= limit:
            out[a].append((b, cost, place))
    profit = {a: pays.get(a, limit) for a in out}
    price = {b: takes.get(b, 0.0) for _, b, _ in pairs}
    mate = {pairs[p][0]: (pairs[p][1], p) for p in chosen}
    owner = {b: a for a, (b, _) in mate.items()}
    for start in sorted(out):
        least = min((c - price[b] for b, c, _ in out[start]), default=limit)
        if least >= profit[start] - 1e-12:
            continue
        profit[start] = least
        goal = mate.pop(start, (None, -1))[0]
        if goal is not None:
            del owner[goal]
        best, via, done, idle, heap, n = {}, {}, {}, [], [], 0
        moving = [(0.0, start)]
        while True:
            for d, a in moving:
                for target, cost, place in [*out[a], (None, limit, -1)]:
                    step = d + max(cost - profit[a] - (0.0 if target is None else price[target]), 0.0)
                    if target not in done and step < best.get(target, float("inf")):
                        best[target], via[target] = step, (a, place)
                        heapq.heappush(heap, (step, n, target))
                        n += 1
            d, _, at = heapq.heappop(heap)
            moving = []
            if at in done:
                continue
            done[at] = d
            if at == goal:
                break
            if at is None:
                idle = [a for a in out if a not in mate and a != start]
                moving = [(d, a) for a in idle]
                for b in [*owner, goal]:  # a matched b may be left alone
                    step = d + max(-price[b], 0.0)
                    if b not in done and step < best.get(b, float("inf")):
                        best[b], via[b] = step, None
                        heapq.heappush(heap, (step, n, b))
                        n += 1
            elif at in owner:
                moving = [(d, owner[at])]
            elif None not in done and d < best.get(None, float("inf")):  # a b that was alone
                best[None], via[None] = d, (None, at)
                heapq.heappush(heap, (d, n, None))
                n += 1
        total = done[goal]
        for b, d in done.items():
            if b is not None:
                price[b] -= total - d
                if b in owner:
                    profit[owner[b]] += total - d
        profit[start] += total
        shift = total - done.get(None, total)
        for a in idle:
            profit[a] += shift
        at = goal
        while True:
            by = via[at]
            if by is None:  # left alone
                owner.pop(at, None)
                at = None
                continue
            a, place = by
            if a is None:
                at = place
                continue
            before = mate.pop(a, (None, -1))[0]
            if at is not None:
                mate[a], owner[at] = (at, place), a
            if a == start:
                break
            at = before
        if shift > 0:
            profit = {a: p - shift for a, p in profit.items()}
            price = {b: p + shift for b, p in price.items()}
        for b in price if shift > 0 else done:
            if b is not None and (b not in owner or price[b] > 0):
                price[b] = 0.0
    return sorted(p for _, p in mate.values()), profit, price


#: Pairs of a key that one task takes as a whole; more are cut into connected components first.
_WHOLE = 1 << 17
#: Pairs for each new one from which a matching is carried on: a chain that has to end in one place is sought further than one that may end anywhere.
_MANY = 20


def least_cost(pairs: DataFrame, keys: list[str], a: str, b: str, cost: str, limit: float, priced: bool = False, whole: int = _WHOLE) -> DataFrame:
    """The pairs of a one-to-one matching of least cost, where a match must be worth less than ``limit``.

    The sum of (cost - limit) over the chosen pairs is the least possible: leaving two objects
    apart costs as much as a match at the limit. Keys pass in a stream sorted by key. Pairs that share no object
    do not touch each other, so a key of more than ``whole`` pairs falls into connected components that are
    solved by themselves. Pairs at the limit or above, with a null cost or a null id, take no part; of repeated pairs the cheapest counts.
    ``priced`` gives all pairs that take part, with ``chosen`` and the ``pays`` and ``takes`` of priced_matching,
    and takes each key as a whole, for few pairs of crowded keys, which hang together anyway. Pairs that bring these columns
    from an earlier call (null: new ones) carry its matching on.
    """
    node = lambda side, c: F.xxhash64(F.lit(side), F.col(c))
    good = pairs.filter((F.col(cost) < limit) & F.col(a).isNotNull() & F.col(b).isNotNull())
    state = {"chosen": "boolean", "pays": "double", "takes": "double"} if priced else {}
    good = good.select(*keys, a, b, F.col(cost).alias("_cost"), *[(F.col(c) if c in pairs.columns else F.lit(None)).cast(t).alias(c) for c, t in state.items()])
    if not priced:
        good = written(good)  # counted, and then matched
    good = good.withColumn("_group", F.xxhash64(*keys)).withColumn("_a", node("a", a)).withColumn("_b", node("b", b))
    held = good.withColumn("_label", F.lit(0).cast("bigint"))
    if not priced:
        crowded = written(good.groupBy("_group").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > whole).select("_group"))
        if not crowded.isEmpty():
            many = good.join(crowded, "_group", "left_semi")
            labels = components(many.select(F.col("_group").alias("group"), F.col("_a").alias("a"), F.col("_b").alias("b")))
            labels = labels.select(F.col("group").alias("_group"), F.col("node").alias("_a"), F.col("label").alias("_label"))
            held = good.join(crowded, "_group", "left_anti").withColumn("_label", F.lit(0).cast("bigint")).unionByName(many.join(labels, ["_group", "_a"]))
    fields = held.schema
    # dealt by a value of its own: a join by other columns may have dealt the rows already
    held = held.withColumn("_deal", F.xxhash64("_group", "_label")).repartition("_deal").drop("_deal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []  # the key that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*open_, batch])
            starts = _starts(table, ["_group", "_label"])
            if len(starts) > 1:
                yield from _matched(table.slice(0, int(starts[-1])), limit, priced)
                table = table.slice(int(starts[-1]))
            open_ = table.to_batches()
        if open_:
            yield from _matched(pa.Table.from_batches(open_), limit, priced)

    out = held.sortWithinPartitions("_group", "_label", "_a", "_b", "_cost").mapInArrow(run, fields)
    return out.select(*keys, a, b, F.col("_cost").alias(cost), *state)


def _starts(table: pa.Table, names: list[str]) -> np.ndarray:
    """Where rows of other values begin in a sorted table."""
    values = np.stack([column(table, c).to_numpy() for c in names])
    return np.concatenate([[0], np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1])


def _matched(table: pa.Table, limit: float, priced: bool) -> Iterator[pa.RecordBatch]:
    """The matching of whole keys; a pair that meets no other needs none."""
    table = table.take(pa.array(_starts(table, ["_group", "_label", "_a", "_b"])))
    begin = _starts(table, ["_group", "_label"])
    a, b, cost = (column(table, c).to_numpy() for c in ("_a", "_b", "_cost"))
    n = len(a)
    key = np.repeat(np.arange(len(begin)), np.diff([*begin, n]))
    alone = np.ones(n, dtype=bool)
    for side in (a, b):
        order = np.lexsort((side, key))
        same = (side[order][1:] == side[order][:-1]) & (key[order][1:] == key[order][:-1])
        alone[order[1:][same]] = alone[order[:-1][same]] = False
    chosen, pays, takes = alone.copy(), cost.copy(), np.zeros(n)
    rest = np.flatnonzero(~alone)
    if priced:
        had, old_pays, old_takes = (column(table, c).to_numpy(zero_copy_only=False)[rest] for c in ("chosen", "pays", "takes"))
        old = ~np.isnan(old_pays)
    a, b, cost = a[rest].tolist(), b[rest].tolist(), cost[rest].tolist()
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(key[rest])) + 1, [len(rest)]]).tolist() if len(rest) else []
    for s, e in zip(cuts[:-1], cuts[1:]):
        here = list(zip(a[s:e], b[s:e], cost[s:e]))
        if priced and _MANY * (e - s - np.count_nonzero(old[s:e])) < e - s:
            known = np.flatnonzero(old[s:e])
            first = [int(i) for i in known if had[s + i]]
            places, pay, take = repaired_matching(here, limit, first, {here[i][0]: float(old_pays[s + i]) for i in known},
                                                  {here[i][1]: float(old_takes[s + i]) for i in known})
        else:
            places, pay, take = priced_matching(here, limit)
        at = rest[s:e]
        chosen[at[places]] = True
        if priced:
            pays[at], takes[at] = [pay[x] for x in a[s:e]], [take.get(y, 0.0) for y in b[s:e]]
    if priced:
        for name, values in (("chosen", chosen), ("pays", pays), ("takes", takes)):
            table = table.set_column(table.schema.get_field_index(name), table.schema.field(name), pa.array(values))
        yield from table.to_batches()
    else:
        yield from table.take(pa.array(np.flatnonzero(chosen))).combine_chunks().to_batches()
