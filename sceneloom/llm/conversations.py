"""Faults of conversations, and the cheapest edits that give them a legal order of roles.

The legal orders are ``(s?(ua)+)?`` over the initials of the roles. The edits make a
lattice of (rows read, state of that pattern): Keep, Rerole and Delete read a row, Insert
reads none. Dijkstra runs from both ends; once the heaps' least costs together exceed the
best crossing, every crossing of equal cost has been finished, and the least audit (the
edits' initials joined) of these is taken. Two equally cheap ways to one node are never a
prefix of each other, as the rest would be a cycle of inserts, so the least audit of a
whole path is made of least audits of its halves.

That also holds at any cut of a conversation. Rows are dealt in their order over ranges, a
long conversation over many; each stretch yields its best ways between any two states, and
a conversation joins the ways of its stretches. What is shuffled for that is one short
record per message without its text.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneloom.llm.common import kept

#: White space of a text, as characters.
SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: State after an initial: 0 nothing yet, 1 a system turn, 2 a user's, 3 an assistant's.
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_LEGAL = {"su", "ua", "au"}
_GOALS = (0, 3)
#: Rows that one search spans; longer stretches are joined from halves.
_SPAN = 64


def _moves(code: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of the edits that read a row: code b or d must go, a capital is a cut text."""
    out = [("D", DELETE, state)]
    if code not in "bd":
        extra = CUT if code.isupper() else 0
        if code.lower() in _NEXT[state]:
            out.append(("K", KEEP + extra, _NEXT[state][code.lower()]))
        out += [("R", REROLE + extra, to) for kind, to in _NEXT[state].items() if kind in "ua"]
    return out


_INSERTS = [[("I", INSERT, to) for kind, to in _NEXT[s].items() if kind in "ua"] for s in range(4)]
_FORTH = {c: [_moves(c, s) for s in range(4)] for c in "suaxSUAXbd"}
_BACK = {c: [[(e, cost, s) for s in range(4) for e, cost, to in _FORTH[c][s] if to == t] for t in range(4)] for c in _FORTH}
_INSERTS_BACK = [[(e, cost, s) for s in range(4) for e, cost, to in _INSERTS[s] if to == t] for t in range(4)]


def shortest(codes: str, entry: int, goals: tuple[int, ...]) -> tuple[int, str] | None:
    """The least (cost, audit) that reads all ``codes`` from state ``entry`` into one of ``goals``; None if there is no way."""
    n = len(codes)
    best = (0, "") if not n and entry in goals else None
    labels: tuple[dict, dict] = ({(0, entry): (0, "")}, {(n, g): (0, "") for g in goals})
    # of equal costs the nodes nearer to the start of their search come first, since only a Keep is free and it reads a row
    heaps = ([(0, 0, entry)], [(0, 0, g) for g in goals])
    done: tuple[set, set] = (set(), set())
    while heaps[0] or heaps[1]:
        tops = [h[0][0] if h else 0 for h in heaps]
        if best is not None and sum(tops) > best[0]:
            break
        side = 0 if heaps[0] and (not heaps[1] or tops[0] <= tops[1]) else 1
        cost, depth, state = heapq.heappop(heaps[side])
        row = depth if side == 0 else n - depth
        node = (row, state)
        if node in done[side]:
            continue
        done[side].add(node)
        audit = labels[side][node][1]
        if side == 0:
            edges = [(e, c, (row, t)) for e, c, t in _INSERTS[state]]
            if row < n:
                edges += [(e, c, (row + 1, t)) for e, c, t in _FORTH[codes[row]][state]]
        else:
            edges = [(e, c, (row, s)) for e, c, s in _INSERTS_BACK[state]]
            if row:
                edges += [(e, c, (row - 1, s)) for e, c, s in _BACK[codes[row - 1]][state]]
        for edit, c, other in edges:
            label = (cost + c, audit + edit if side == 0 else edit + audit)
            if other in done[1 - side]:
                rest = labels[1 - side][other]
                whole = (label[0] + rest[0], label[1] + rest[1] if side == 0 else rest[1] + label[1])
                if best is None or whole < best:
                    best = whole
            if other not in done[side] and label < labels[side].get(other, (label[0] + 1, "")):
                labels[side][other] = label
                heapq.heappush(heaps[side], (label[0], other[0] if side == 0 else n - other[0], other[1]))
    return best


Ways = dict[tuple[int, int], tuple[int, str]]


def joined(left: Ways, right: Ways) -> Ways:
    """The best ways through two stretches in a row."""
    out: Ways = {}
    for (entry, middle), (c1, a1) in left.items():
        for (start, leave), (c2, a2) in right.items():
            if start == middle and ((entry, leave) not in out or (c1 + c2, a1 + a2) < out[entry, leave]):
                out[entry, leave] = (c1 + c2, a1 + a2)
    return out


def through_all(parts: list[Ways]) -> Ways:
    """The best ways through many stretches, joined in pairs."""
    while len(parts) > 1:
        parts = [joined(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


@lru_cache(maxsize=4096)
def _span_ways(codes: str) -> Ways:
    found = {(e, x): shortest(codes, e, (x,)) for e in range(4) for x in range(4)}
    return {k: v for k, v in found.items() if v is not None}


def ways(codes: str) -> Ways:
    """The best (cost, audit) from each state to each state over a stretch of any length."""
    return through_all([_span_ways(codes[i:i + _SPAN]) for i in range(0, len(codes), _SPAN)] or [_span_ways("")])


@lru_cache(maxsize=65_536)
def _short(codes: str) -> tuple[int, str]:
    return shortest(codes, 0, _GOALS)


def cheapest(codes: str) -> tuple[int, str]:
    """The least (cost, audit) for a whole conversation."""
    if len(codes) <= _SPAN:
        return _short(codes)
    return _from_ways(ways(codes))


def _from_ways(w: Ways) -> tuple[int, str]:
    return min(w[0, g] for g in _GOALS if (0, g) in w)


def _illegal(kinds: str) -> int:
    return sum(a + b not in _LEGAL for a, b in zip(kinds, kinds[1:]))


def _text_key(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(F.length(role), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))))


def _messages(rows: DataFrame) -> DataFrame:
    """One short record for each set of equal rows: conv, turn, role, key, kind, code, n; the code is that of the first."""
    role, text = F.col("role"), F.coalesce(F.col("text"), F.lit(""))
    end = F.rtrim(text, F.lit(SPACE))
    initial = F.coalesce(F.substring(role, 1, 1), F.lit(""))
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    fault = F.when(end == "", "b").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), F.upper(kind)).otherwise(kind)
    some = rows.select(F.col("conv_id").alias("conv"), "turn", "role", _text_key(role, text).alias("key"), kind.alias("kind"), fault.alias("code"))
    some = some.groupBy("conv", "turn", "role", "key", "kind", "code").agg(F.count(F.lit(1)).alias("n"))
    first = some.groupBy("conv", "key").agg(F.min("turn").alias("_least"), F.max(F.col("turn").isNull()).alias("_unset"))
    first = first.select(F.col("conv").alias("_conv"), F.col("key").alias("_key"), "_least", "_unset")
    both = some.join(first, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("key") == F.col("_key")))
    is_first = F.col("turn").isNull() | (~F.col("_unset") & (F.col("turn") == F.col("_least")))
    return both.select("conv", "turn", "role", "key", "kind", F.when((F.col("code") == "b") | is_first, F.col("code")).otherwise("d").alias("code"), "n")


_STRETCH = ("part int, n long, blank long, duplicate long, truncated long, illegal long, turns long, lo long, hi long, first_turn long, last_turn long,"
            " first_kind string, last_kind string, cost long, audit string, ways array<struct<entry:int,leave:int,cost:long,audit:string>>")
_STRETCH_FIELDS = [f.strip().split(" ")[0] for f in _STRETCH.split(",") if ":" not in f] + ["ways"]


def _stretches(messages: DataFrame) -> DataFrame:
    """Records of the stretches that conversations have in each range of the ordered messages."""
    conv_type = messages.schema["conv"].dataType.simpleString()

    def stretch(codes: list[str], kinds: list[str], turns: list[np.ndarray], edge: bool, part: int) -> dict:
        code, kind = "".join(codes), "".join(kinds)
        known = [t for t in turns if t is not None]
        distinct = 1 + sum(a != b for a, b in zip(known, known[1:])) if known else 0
        cost, audit = (None, None) if edge else cheapest(code)
        return {"part": part, "n": len(code), "blank": code.count("b"), "duplicate": code.count("d"),
                "truncated": sum(code.count(c) for c in "SUAX"), "illegal": _illegal(kind), "turns": distinct,
                "lo": known[0] if known else None, "hi": known[-1] if known else None, "first_turn": turns[0], "last_turn": turns[-1],
                "first_kind": kind[0], "last_kind": kind[-1], "cost": cost, "audit": audit,
                "ways": [{"entry": e, "leave": x, "cost": c, "audit": a} for (e, x), (c, a) in ways(code).items()] if edge else None}

    def run(batches):
        part = TaskContext.get().partitionId()
        held = None
        first = True
        schema = None
        for b in batches:
            if not b.num_rows:
                continue
            schema = schema or b.schema
            convs, out = b.column("conv").to_pylist(), []
            for conv, turn, kind, code, n in zip(convs, *(b.column(c).to_pylist() for c in ("turn", "kind", "code", "n"))):
                if held is None or conv != held[0]:
                    if held is not None:
                        out.append((held[0], stretch(*held[1:], first, part)))
                        first = False
                    held = (conv, [], [], [])
                held[1].append(code * n if code in "bd" else code + "d" * (n - 1))
                held[2].append(kind * n)
                held[3].append(turn)
            if out:
                yield batch(out, schema)
        if held is not None:
            yield batch([(held[0], stretch(*held[1:], True, part))], schema)

    def batch(out, schema):
        columns = [pa.array([c for c, _ in out], schema.field("conv").type)]
        for name in _STRETCH_FIELDS:
            kind = (pa.string() if name in ("first_kind", "last_kind", "audit") else pa.int32() if name == "part"
                    else pa.list_(pa.struct([("entry", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])) if name == "ways" else pa.int64())
            columns.append(pa.array([s[name] for _, s in out], kind))
        return pa.RecordBatch.from_arrays(columns, ["conv", *_STRETCH_FIELDS])

    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("key")]
    dealt = messages.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("conv", F.col("turn").cast("long").alias("turn"), "kind", "code", "n").mapInArrow(run, f"conv {conv_type}, {_STRETCH}")


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, n, gaps, blank, duplicate, truncated, illegal, cost, audit) for every conv_id of ``rows``.

    ``rows`` has conv_id, turn, role and text; further columns are left out. A conversation's
    rows go by turn (nulls first), rows of one turn by role, then by a hash of role and text,
    so equal rows are neighbours. A null text is empty, a null or other role has no legal
    initial, a null conv_id is one more conversation. Texts count whole, an empty table gives no row.
    """
    found = _stretches(_messages(rows))
    whole = found.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(*_STRETCH_FIELDS))).alias("parts"))

    def fold(batches):
        for b in batches:
            out = []
            for parts in b.column("parts").to_pylist():
                one = parts[0]
                if len(parts) == 1 and one["audit"] is not None:
                    cost, audit = one["cost"], one["audit"]
                else:
                    cost, audit = _from_ways(through_all([{(w["entry"], w["leave"]): (w["cost"], w["audit"]) for w in p["ways"]} for p in parts]))
                lo = [p["lo"] for p in parts if p["lo"] is not None]
                hi = [p["hi"] for p in parts if p["hi"] is not None]
                pairs = list(zip(parts, parts[1:]))
                turns = sum(p["turns"] for p in parts) - sum(x["last_turn"] is not None and x["last_turn"] == y["first_turn"] for x, y in pairs)
                total = {c: sum(p[c] for p in parts) for c in ("n", "blank", "duplicate", "truncated", "illegal")}
                total["illegal"] += sum(x["last_kind"] + y["first_kind"] not in _LEGAL for x, y in pairs)
                out.append((total["n"], max(hi) - min(lo) + 1 - turns if lo else 0, total["blank"], total["duplicate"], total["truncated"], total["illegal"], cost, audit))
            columns = list(zip(*out)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([b.column("conv"), *(pa.array(c, pa.int64()) for c in columns[:7]), pa.array(columns[7], pa.string())], names)

    names = ["conv_id", "n", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    kind = whole.schema["conv"].dataType.simpleString()
    return whole.mapInArrow(fold, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in names[1:8]) + ", audit string")


def repaired(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """(conv_id, pos, edit, role, text): the rows of each conversation after the edits of its audit, in order.

    ``pos`` counts from 0; ``edit`` is K, R or I, deleted rows are gone. Rows stream through
    their task in order, so a long conversation takes time but no room; they come out by
    conversation and pos within a partition.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    head = audited.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"),
                          F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), F.lit(None).cast("string").alias("key"))
    body = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", _text_key(F.col("role"), F.col("text")).alias("key"))
    # dealt by a value of its own, so that the shuffle stays even if both sides already are dealt by conv_id in ways that differ
    both = head.unionByName(body).withColumn("_deal", F.xxhash64("conv_id"))
    dealt = both.repartition("_deal").sortWithinPartitions(
        "conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "key").select("conv_id", "kind", "role", "text")

    def run(batches):
        conv = audit = None
        at = pos = state = 0
        out: list[tuple] = []

        def inserts():
            nonlocal at, pos, state
            while at < len(audit) and audit[at] == "I":
                role = "assistant" if state == 2 else "user"
                out.append((conv, pos, "I", role, ""))
                at, pos, state = at + 1, pos + 1, _NEXT[state][role[0]]

        for b in batches:
            for c, is_row, role, text in zip(*(b.column(x).to_pylist() for x in ("conv_id", "kind", "role", "text"))):
                if not is_row:
                    if audit is not None:
                        inserts()
                    conv, audit, at, pos, state = c, text, 0, 0, 0
                    continue
                inserts()
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                if edit == "R":
                    role = "assistant" if state == 2 else "user"
                out.append((conv, pos, edit, role, text))
                pos, state = pos + 1, _NEXT[state][role[0]]
            if b.num_rows:
                yield batch(out, b.schema.field("conv_id").type)
                last = b.schema.field("conv_id").type
                out.clear()
        if audit is not None:
            inserts()
            if out:
                yield batch(out, last)

    def batch(out, conv_type):
        c = list(zip(*out)) or [[]] * 5
        kinds = (conv_type, pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], ["conv_id", "pos", "edit", "role", "text"])

    return dealt.mapInArrow(run, f"conv_id {kind}, pos long, edit string, role string, text string")


def digests(mended: DataFrame) -> DataFrame:
    """(conv_id, sha256 of its ``role:text`` lines) of rows as ``repaired`` gives them, hashed as they stream by."""

    def run(batches):
        held, conv_type = None, None

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], conv_type), pa.array([h.hexdigest() for _, h in out])], ["conv_id", "sha256"])

        for b in batches:
            conv_type, out = b.schema.field("conv_id").type, []
            for conv, pos, role, text in zip(*(b.column(x).to_pylist() for x in ("conv_id", "pos", "role", "text"))):
                line = f"{role}:{text or ''}".encode()
                if pos == 0:
                    if held is not None:
                        out.append(held)
                    held = (conv, hashlib.sha256(line))
                else:
                    held[1].update(b"\n" + line)
            if out:
                yield batch(out)
        if held is not None:
            yield batch([held])

    kind = mended.schema["conv_id"].dataType.simpleString()
    return mended.select("conv_id", "pos", "role", "text").mapInArrow(run, f"conv_id {kind}, sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The audits of ``rows`` (computed once), and the repaired rows."""
    audited = kept(audits(rows))
    return audited, repaired(rows, audited)
