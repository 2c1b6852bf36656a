"""Near duplicates, boilerplate lines and benchmark leaks against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sceneloom.llm import decontaminate, line_dedup, minhash
from sceneloom.llm.wordhash import distinct, shingles, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def word(rng):
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7)))


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = word(rng)
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    rows, texts = [], []
    for g in range(12):
        base = " ".join(word(rng) for _ in range(rng.choice([5, 30, 120, 400])))
        texts += [base] + [edited(rng, base, rng.choice([0, 1, 1, 2, 3, 6])) for _ in range(rng.choice([0, 1, 3, 25]))]
    texts += ["", None, "One.", "one", "a b c d", "A, b c d!", "x " * 3000, "x " * 2500, None]
    rng.shuffle(texts)
    rows = [(i * 3, t, "en", f"s{i % 7}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[5], "en", None, 1), (None, None, None, None, None), (7001, texts[8], None, "s1", None)]
    return rows


def shingle_set(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(rows):
    sets = [shingle_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b):
                root[find(i)] = find(j)
            elif not a and not b and rows[i][:2] == rows[j][:2]:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((r[0], least[find(i)]) for i, r in enumerate(rows)), key=str)


def test_near_duplicates_equal_brute_force(spark, corpus):
    got = minhash.near_duplicates(spark.createDataFrame(corpus, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == classes(corpus)


def test_one_shared_band_is_enough(spark):
    """Two near copies in one common bucket, whose leaders are other texts."""
    rng = random.Random(4)
    twin = [word(rng) for _ in range(100)]
    texts = [(1, " ".join(twin)), (2, " ".join(twin[:-1]))] + [(i, " ".join(word(rng) for _ in range(100))) for i in range(3, 12)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    own = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.when(i == 1, 0).otherwise(F.when(F.col("id") < 3, F.col("id") * 1000).otherwise(0) + i).cast("long"))
    sketches = minhash.sketch(docs).withColumn("bands", own)
    _, labels = minhash.links(docs, sketches)
    assert labels.join(sketches, "node").select("id").distinct().count() == 2 and labels.select("label").distinct().count() == 1


def test_bitmaps_never_differ_more_than_the_sets(spark):
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.choice(1 << 20, n)).astype(np.uint64) for n in (0, 1, 3, 15, 16, 17, 40, 60, 66, 130, 250, 257, 1000, 1030)]
    sets += [np.unique(np.concatenate((x[: int(0.9 * len(x))], rng.choice(1 << 20, len(x) // 8).astype(np.uint64)))) for x in sets]
    at = np.cumsum([0] + [len(x) for x in sets])
    bits = minhash._bitmaps(np.concatenate(sets), at).to_pylist()
    table = spark.createDataFrame([(i, b) for i, b in enumerate(bits)], "i int, b array<long>")
    got = table.selectExpr("i", "b").crossJoin(table.selectExpr("i as j", "b as c")).selectExpr("i", "j", minhash._differing("b", "c") + " as d").collect()
    tight = 0
    for r in got:
        a, b = set(sets[r.i].tolist()), set(sets[r.j].tolist())
        if 2 * min(len(a), len(b)) < max(len(a), len(b)):
            continue
        assert r.d <= len(a ^ b)
        tight += len(a ^ b) > 20 and r.d > 0.6 * len(a ^ b)
    assert tight > 30


def test_a_group_of_many_classes(spark):
    """Copies of one text with many edits: most share buckets and few are alike enough."""
    rng = random.Random(6)
    base = [word(rng) for _ in range(120)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(rng.randint(0, 9)):
            text[rng.randrange(120)] = word(rng)
        rows.append((i, " ".join(text), "en", "s", 1)[:len(SCHEMA.split(","))])
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want = classes(rows)
    assert 10 < len({c for _, c in want}) < 150
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == want
    assert all((r.n_links > 0) == (sum(c == r.class_id for _, c in want) > 1) for r in got)


def test_rows_equal_in_id_and_text_stay_once_and_alike(spark):
    rows = [(1, "some words of a text that is long", x) for x in range(20)]
    one = minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, x int")).collect()
    two = minhash.drop_near_duplicates(spark.createDataFrame(rows[::-1], "doc_id long, text string, x int").repartition(5)).collect()
    assert len(one) == 1 and one == two
    odd = spark.createDataFrame([("a", "some words"), ("7", "other")], "doc_id string, text string")
    assert {(r.doc_id, r.class_id) for r in minhash.near_duplicates(odd).collect()} == {(None, None), (7, 7)}


def test_one_of_each_class_stays(spark, corpus):
    docs = spark.createDataFrame([(*r, "mine", 1) for r in corpus], SCHEMA + ", key string, node int")
    left = minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    rows = left.collect()
    ids = [r.doc_id for r in rows]
    assert {c for _, c in classes(corpus)} - {None} == set(ids) - {None}
    assert len(rows) == len({(r.doc_id, r.text) for r in rows})
    assert all(r.key == "mine" for r in rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([], "item_id long, text string")
    assert minhash.near_duplicates(none).count() == 0
    assert minhash.drop_near_duplicates(none).count() == 0
    assert line_dedup.drop_spread_lines(none).count() == 0
    assert decontaminate.matches(none, items).count() == 0
    assert decontaminate.drop_contaminated(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items).count() == 1


@pytest.mark.parametrize("weights", [False, True])
def test_darts_agree_as_often_as_the_sets_are_alike(weights):
    rng = np.random.default_rng(3)
    k, sets = 4096, 6
    elements, at, weight, tables = [], [0], [], []
    for s in range(sets):
        members = np.sort(rng.choice(60, 40, replace=False))
        w = rng.integers(1, 9, 40).astype(float) * (0.5 if s % 2 else 1.0) if weights else np.ones(40)
        tables.append(dict(zip(members.tolist(), w.tolist())))
        elements += members.tolist()
        weight += w.tolist()
        at.append(len(elements))
    signature = minhash.dart_minhash(np.array(elements, np.uint64), np.array(at), np.array(weight), k)
    assert (signature != 0).all()
    for i in range(sets):
        for j in range(i):
            a, b = tables[i], tables[j]
            keys = a.keys() | b.keys()
            true = sum(min(a.get(x, 0), b.get(x, 0)) for x in keys) / sum(max(a.get(x, 0), b.get(x, 0)) for x in keys)
            assert abs((signature[i] == signature[j]).mean() - true) < 0.04


def test_words_and_shingles_of_many_texts():
    import pyarrow as pa
    texts = ["Ab, cd ef-gh ij", "", None, "ab", "x—y “z” ab", "ÉÉ éé"]
    h, at = words(pa.array(texts))
    assert np.diff(at).tolist() == [5, 0, 0, 1, 4, 2]
    assert h[0] == h[5] == h[9] and h[10] == h[11]
    s, begin = shingles(h, at)
    assert np.diff(begin).tolist() == [1, 0, 0, 1, 1, 1]
    values, first, times = distinct(s, begin)
    assert len(values) == 4 and times.tolist() == [1] * 4 and first.tolist() == [0, 1, 1, 1, 2, 3, 4]


def test_spread_lines(spark):
    rows = [(i, f"own {i}\nshared by all\n\nshared by all\n{'few' if i < 4 else 'x' + str(i)}", "en", f"s{i}", 1) for i in range(12)]
    rows += [(50, None, "en", "s1", None), (51, "", "en", "s2", 0), (52, "shared by all", "en", None, 1), (53, "few\n \n", "en", "s1", 1), (None, "shared by all\nq", "en", "s3", 1)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], SCHEMA + ", line int")
    for sites, band in ((10, 0.25), (10, 0.0), (12, 0.5)):
        got = {r.doc_id: r for r in line_dedup.drop_spread_lines(docs, sites, band).collect()}
        assert len(got) == len(rows) and all(r.line == 5 for r in got.values())
        assert got[0].text == "own 0\nshared by all\n\nfew" and got[0].n_removed == 1
        assert got[5].text == "own 5\n\nx5" and got[5].n_removed == 2 and got[5].n_chars == 9
        assert got[50].text is None and got[51].text == "" and got[52].text == "" and got[53].text == "few\n \n"
        assert got[None].text == "q"


def test_matches_equal_a_plain_search(spark):
    rng = random.Random(9)
    items = [(i, " ".join(word(rng) for _ in range(rng.randint(3, 60)))) for i in range(70)] + [(100, None), (101, ""), (None, "lost item of words")]
    docs, want = [], set()
    for d in range(150):
        text = [word(rng) for _ in range(rng.randint(0, 400))]
        for i in rng.sample(range(70), rng.choice([0, 0, 1, 2])):
            at = rng.randint(0, len(text))
            text[at:at] = items[i][1].upper().split(" ")
            want.add((d, i))
        docs.append((d, " ".join(text), "en", "s", 0))
    docs += [(500, None, None, None, None), (501, "", "en", "s", 0), (502, items[3][1] + "!", "en", "s", 0)]
    want.add((502, 3))
    # an item planted inside another one cuts that one in two
    whole = {(d, i) for d, i in want if f" {items[i][1]} " in f" {(dict((r[0], r[1]) for r in docs)[d] or '').lower().rstrip('!')} "}
    frame = spark.createDataFrame(docs, SCHEMA)
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert whole <= got <= want
    kept = decontaminate.drop_contaminated(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in docs} - {d for d, _ in got}


def test_items_of_any_id(spark):
    rng = random.Random(2)
    texts = [" ".join(word(rng) for _ in range(30)) for _ in range(3)]
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in enumerate(texts)] + [(9, "none of them")], "doc_id long, text string")
    items = spark.createDataFrame([(None, texts[0]), ("q-1", texts[1]), ("q-1", texts[2]), (None, texts[0])], "item_id string, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect()) == [(0, None), (1, "q-1"), (2, "q-1")]
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()] == [9]


def test_copies_stay_whole_for_near_dedup(spark):
    """One page on twelve sources beside pages with a common footer: only the footer goes."""
    page = "\n".join(f"line {i} of a page that was copied" for i in range(20))
    rows = [(i, page, "en", f"s{i}", 1) for i in range(12)] + [(100 + i, f"own text {i}\nthat stays here {i}\nfooter", "en", f"s{i}", 1) for i in range(12)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.drop_spread_lines(docs, 10, most=0.5).collect()}
    assert all(got[i] == (page, 0) for i in range(12))
    assert got[100][1] == 0 and all(got[100 + i] == (f"own text {i}\nthat stays here {i}", 1) for i in range(1, 12))
    assert {r.doc_id for r in minhash.drop_near_duplicates(line_dedup.drop_spread_lines(docs, 10, most=0.5)).collect()} == {0, *range(100, 112)}


def test_items_with_an_edited_tail(spark):
    """One changed or missing word among the last eight, or an excerpt that stops early, hides no item; a real answer must be there."""
    rng = random.Random(12)
    items = [(i, [word(rng) + str(i) for _ in range(n)]) for i, n in enumerate((16, 20, 30, 60))]
    docs, want = [], set()
    for i, x in items:
        cuts = [x[:at] + new + x[at + 1:] for at in range(len(x) - 8, len(x)) for new in ([], ["other"])] + ([x[:-4]] if i > 1 else [])
        for c in cuts:
            want.add((len(docs), i))
            docs.append((len(docs), " ".join(["before"] * 30 + c + ["after"] * 30), "en", "s", 0))
    frame = spark.createDataFrame(docs, SCHEMA)
    table = spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(frame, table).collect()} == want
    assert decontaminate.drop_contaminated(frame, table).count() == 0
    asked = spark.createDataFrame([(i, " ".join(x[:-8]), " ".join(x[-8:])) for i, x in items], "item_id long, question string, answer string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(frame, asked).collect()} < want


def test_block_max_search_misses_nothing(spark):
    """Against scores of all items for all passages, with several blocks and indexes."""
    import pyarrow as pa
    rng = random.Random(2)
    vocabulary = [word(rng) for _ in range(60)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 20))) for _ in range(50)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    index, = decontaminate.indexes(items, 0.5)
    docs = pa.array([" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 200))) for _ in range(40)])
    h, at = words(docs)
    got = {tuple(x) for x in zip(*(x.tolist() for x in decontaminate.search(index, h, at, 0.5)))}
    want, half = set(), max(index.longest, 16)
    for d in range(40):
        for first in range(at[d], max(at[d + 1], at[d] + 1), half):
            seen = set(h[first:min(first + 2 * half, at[d + 1])].tolist())
            for i in range(50):
                terms = index.terms[np.repeat(np.arange(len(index.terms)), np.diff(index.at))]
                score = sum(w for t, it, w in zip(terms.tolist(), index.item.tolist(), index.impact.tolist()) if it == i and t in seen)
                if score >= 0.5 - 1e-9:
                    want.add((d, first, i))
    assert got == want and want
    small = decontaminate.INDEX_BYTES
    try:
        decontaminate.INDEX_BYTES = 1000
        assert len(decontaminate.indexes(items, 0.5)) > 3
    finally:
        decontaminate.INDEX_BYTES = small
