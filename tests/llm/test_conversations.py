"""Repair of conversations against a search of all edits."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sceneloom.llm import conversations, queries


def all_edits(codes):
    """The least (cost, audit) over every row of the lattice, without heaps: (state -> best) after each row."""
    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    def insert(at):
        for _ in range(4):
            for s, (c, a) in list(at.items()):
                for k, t in step[s].items():
                    if k != "s" and (t not in at or (c + 5, a + "I") < at[t]):
                        at[t] = (c + 5, a + "I")
        return at

    at = insert({0: (0, "")})
    for code in codes:
        new = {}
        for s, (c, a) in at.items():
            options = [(c + 2, a + "D", s)]
            if code not in "bd":
                more = 5 if code.isupper() else 0
                options += [(c + more, a + "K", t) for k, t in step[s].items() if k == code.lower()]
                options += [(c + more + 1, a + "R", t) for k, t in step[s].items() if k != "s"]
            for cost, audit, t in options:
                if t not in new or (cost, audit) < new[t]:
                    new[t] = (cost, audit)
        at = insert(new)
    return min(at[g] for g in (0, 3) if g in at)


def every_audit(codes, limit):
    """All (cost, audit) with up to ``limit`` inserts, by enumeration."""
    out = []

    def go(i, text, cost, audit, left):
        if i == len(codes) and re.fullmatch("(s?(ua)+)?", text):
            out.append((cost, audit))
        if left:
            for k in "ua":
                go(i, text + k, cost + 5, audit + "I", left - 1)
        if i < len(codes):
            c = codes[i]
            go(i + 1, text, cost + 2, audit + "D", left)
            if c not in "bd":
                more = 5 if c.isupper() else 0
                go(i + 1, text + c.lower(), cost + more, audit + "K", left)
                for k in "ua":
                    go(i + 1, text + k, cost + more + 1, audit + "R", left)

    go(0, "", 0, "", limit)
    return min(out)


@settings(max_examples=120, deadline=None)
@given(st.text("suaxSUAXbd", max_size=5))
def test_cheapest_of_all_audits(codes):
    assert conversations.cheapest(codes) == every_audit(codes, 3)


@settings(max_examples=200, deadline=None)
@given(st.text("suaxSUAbd", max_size=40), st.integers(0, 40))
def test_cuts_change_nothing(codes, cut):
    want = all_edits(codes)
    assert conversations.cheapest(codes) == want
    two = conversations.joined(conversations.ways(codes[:cut]), conversations.ways(codes[cut:]))
    assert conversations._from_ways(two) == want


def test_long_conversation():
    rng = random.Random(1)
    codes = "".join(rng.choice("suaxUAbd" + "ua" * 4) for _ in range(3000))
    assert conversations.cheapest(codes) == all_edits(codes)


def plain(rows):
    """The contract, one conversation at a time."""
    ids = {r[0] for r in rows}
    after = {c: [] for c in ids}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        after[conv] += [] if h == 0 else [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    out = []
    for conv, got in after.items():
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, codes = set(), ""
        for _, role, text in got:
            kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
            body = text.strip(" \t\n\x0b\x0c\r")
            codes += "b" if not body else "d" if (role, text) in seen else kind if body[-1] in ".!?" else kind.upper()
            seen.add((role, text))
        kinds = [r[1][:1] for r in got]
        turns = {r[0] for r in got if r[0] is not None}
        cost, audit = all_edits(codes)
        lines, state, rest = [], 0, list(got)
        for e in audit:
            row = rest.pop(0) if e != "I" else (None, "", "")
            if e == "D":
                continue
            role = row[1] if e == "K" else "assistant" if state == 2 else "user"
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
            lines.append(f"{role}:{row[2]}")
        assert not rest
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, codes.count("b"), codes.count("d"), sum(c.isupper() for c in codes),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for conv in [*range(80), None]:
        for turn in range(rng.randint(1, 9)):
            out.append((conv, turn if rng.random() < 0.9 else rng.choice([None, turn + 3]), rng.choice(["system", "user", "assistant", "user", "assistant", None, "", "tool"]),
                        rng.choice(["Yes.", "No!", "Why?\n", "cut", "", None, " \t", "so. "]) if rng.random() < 0.5 else f"text {rng.random()}."))
    out += [(500, t, "user" if t % 2 == 0 else "assistant", f"line {t % 700}.") for t in range(1500)]
    return out + out[:20] + [(501, None, "user", "x" * 100000)]


def test_query_equals_the_plain_form(spark, tmp_path, rows):
    spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n int").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted((tuple(r) for r in queries.op12(spark, str(tmp_path)).collect()), key=str)
    assert got == plain(rows)


def test_repaired_rows(spark, rows):
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    _, mended = conversations.repair(docs)
    roles = {}
    for r in mended.collect():
        roles.setdefault(r.conv_id, []).append((r.pos, r.role))
    for got in roles.values():
        assert [p for p, _ in sorted(got)] == list(range(len(got)))
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for _, x in sorted(got)))


def test_nothing(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert queries.op12(spark, str(tmp_path)).count() == 0
