"""Sharding, quality rules, languages, token ids, pages, URLs and licences."""

import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sceneloom.llm import html_extract, langid, licenses, quality_rules, sentencepieces, sharding, urls
from sceneloom.llm.queries import BAD_WORDS, MODEL_PATH, URL_RULES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_docs():
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "of", "word", "and", "tree", "#$%"]) for _ in range(rng.randint(0, 60))), "en", "s", 1) for i in range(90)]
    return rows + [(200, None, None, None, None), (201, "", "en", "s", 0), (None, "no id", "en", None, 1), (None, None, None, None, None),
                   (202, "long " * 60000, "en", "s", 1), rows[3], rows[3]]


@pytest.mark.parametrize("bucket_rows", [20_000, 10, 1])
def test_shards(spark, bucket_rows):
    rows = odd_docs() + [(1, "same", "en", "s", 1)] * 60
    docs = spark.createDataFrame([(*r, 9) for r in rows], DOCS + ", shard int")
    got = sharding.shards(docs, 7, bucket_rows=bucket_rows).collect()
    assert sorted(map(str, (tuple(r.record)[:5] for r in got))) == sorted(map(str, rows))
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.record.shard == 9
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shards(docs.repartition(5), 7, bucket_rows=bucket_rows).collect()
    assert sorted((r.shard, r.slot, str(r.record)) for r in got) == sorted((r.shard, r.slot, str(r.record)) for r in again)
    if bucket_rows == 20_000:
        other = sharding.shards(docs, 7, seed=8).collect()
        assert sorted((r.shard, r.slot, str(r.record)) for r in got) != sorted((r.shard, r.slot, str(r.record)) for r in other)


def test_many_copies_are_dealt_alike_and_evenly(spark):
    rows = [(1, "same", "en", "s", 1)] * 600 + [(i, f"other {i}", "en", "s", 1) for i in range(50)]
    docs = spark.createDataFrame(rows, DOCS)
    runs = [sorted((r.shard, r.slot, r.record.doc_id) for r in sharding.shards(docs.repartition(p), 7, bucket_rows=10).collect()) for p in (1, 6, 13)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 650
    # the copies are scattered: no long stretch without one of the others
    order = sorted((slot, shard, doc) for shard, slot, doc in runs[0])
    at = [i for i, r in enumerate(order) if r[2] != 1]
    assert max(b - a for a, b in zip(at, at[1:])) < 120


def test_shards_of_nothing_and_files(spark, tmp_path):
    assert sharding.shards(spark.createDataFrame([], DOCS)).count() == 0
    sharding.write_shards(spark.createDataFrame(odd_docs(), DOCS), str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(odd_docs()) and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2}


def plain_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, flagged = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i:i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            flagged |= {i + k for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(flagged)


def test_quality_measures(spark):
    rng = random.Random(5)
    rows = odd_docs() + [(300 + i, rng.choice([" ", "\n"]).join(rng.choice("a b c the of # é日".split()) for _ in range(rng.randint(0, 300))), "en", "s", 1) for i in range(40)]
    rows += [(400, "a\tb\x0bc\x0cd\re f g h " * 3, "en", "s", 1), (401, "x " * 8, "en", "s", 1), (402, "x " * 9, "en", "s", 1)]
    docs = spark.createDataFrame([(*r, "mine") for r in rows], DOCS + ", n_words string")
    for r in quality_rules.judge(docs).collect():
        want = plain_measures(r._row.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r._row.text
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.kept and r.base_failed) and r._row.n_words == "mine"
    assert quality_rules.judge(spark.createDataFrame([], DOCS)).count() == 0


def test_quality_plan_has_no_user_function(spark):
    plan = quality_rules.judge(spark.createDataFrame(odd_docs(), DOCS))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    third = lambda i: zlib.crc32(str(i).encode()) % 3
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    taught = spark.createDataFrame([r for r in rows if third(r[0]) != 1], "doc_id long, text string, lang string")
    models = langid.learn(taught)
    assert sorted(models) == ["de", "en", "es", "fr"] and all(len(m) <= 64 * 2000 * 4 for m in models.values())
    held = spark.createDataFrame([(*r, 1) for r in rows if third(r[0]) == 1], "doc_id long, text string, lang string, score int")
    got = langid.predict(held, models).collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)
    # the plain form: one dictionary after the other, the whole text block by block
    for r in got:
        data = langid._plain(pa.array([r.text])).to_pylist()[0].encode()
        sizes = {x: sum(len(langid._encoder(models[x])(data[i:i + langid.BLOCK_BYTES])) for i in range(0, len(data), langid.BLOCK_BYTES)) for x in models}
        least, other = sorted(sizes.values())[:2]
        assert r.lang_pred == min(x for x in sizes if sizes[x] == least) and abs(r.score - (other - least) / other) < 1e-12
    odd = spark.createDataFrame(odd_docs() + [(900, "123 !!", None, None, None)], DOCS)
    out = {r.doc_id: r for r in langid.predict(odd, models).collect()}
    assert out[200].lang_pred == out[201].lang_pred == out[900].lang_pred == "und" and not out[900].lang_accepted
    left = langid.drop_undecided(odd, models)
    assert left.columns == odd.columns and not {200, 201, 900} & {r.doc_id for r in left.collect()}
    nobody = langid.learn(spark.createDataFrame([], DOCS))
    assert nobody == {} and {r.lang_pred for r in langid.predict(odd, nobody).collect()} == {"und"}
    assert {r.score for r in langid.predict(odd.filter("doc_id = 5"), {"en": b"the of word"}).collect()} <= {1.0, 0.0}


def test_copies_hide_no_language(spark):
    """A language whose rows are copies of a few texts is learnt, and so is a labeller from copies of few pages."""
    rows = [("ein Satz auf Deutsch mit Wörtern", "de")] * 10000 + [(f"an English sentence {i}", "en") for i in range(3000)]
    assert sorted(langid.learn(spark.createDataFrame(rows, "text string, lang string"))) == ["de", "en"]
    pages = [("<html><body><nav>Menu</nav><article><p>Some text of it.</p></article></body></html>",)] * 3000
    model = html_extract.fit(spark.createDataFrame(pages, "html string"))
    start = html_extract.train([])
    assert any((model.p[k] != start.p[k]).any() for k in model.p)


def test_token_ids_equal_the_library(spark):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
    rng = random.Random(3)
    alphabet = "abcdefghij  \n\n\tétheöß中文字1234-***===.,'▁😀\x00aaaa"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    texts += [c * n for c in ("a", "-", "ab", "the", " ", "\n", "*") for n in (1, 15, 16, 17, 100, 3000)] + ["\nA\n\nb \n c", "word " * 20000, "", None]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "a b", 1)], "doc_id long, text string, ids int")
    coded = sentencepieces.encode(docs, MODEL_PATH)
    for r in coded.collect():
        t = "a b" if r.doc_id is None else texts[r.doc_id]
        assert r.ids == (None if t is None else sp.encode(t)), repr(t)
        assert r.n_ids == len(r.ids or []) and r.round_trip == (None if t is None else True)
    for r in sentencepieces.decode(coded.filter("doc_id is not null"), MODEL_PATH).collect():
        t = texts[r.doc_id]
        assert r.text == (None if t is None else t.replace("▁", " "))
    assert sentencepieces.encode(spark.createDataFrame([], DOCS), MODEL_PATH).count() == 0


def test_stream_commits_where_paths_meet():
    model = sentencepieces.Model(MODEL_PATH)
    stream = sentencepieces.Stream(model)
    rng = random.Random(6)
    text = "".join(rng.choice("abcdeth") for _ in range(3000))
    widest = 0
    for i in range(0, len(text), 100):
        stream.feed(text[i:i + 100])
        widest = max(widest, len(stream.back))
    early = len(stream.ids)
    assert stream.close() == model.merged(text) and early > 0.9 * len(stream.ids)
    assert widest < 1500


def test_unigram_search_takes_the_best_sum():
    model = sentencepieces.Model(MODEL_PATH, kind="unigram")
    pieces = {"a": -3.0, "b": -3.0, "ab": -5.0, "ba": -4.0, "aba": -9.0, "▁": -1.0}
    model.pieces = {p: i for i, p in enumerate(pieces)}
    model.scores, model.longest = list(pieces.values()), 3
    names = list(pieces)
    rng = random.Random(8)
    for _ in range(60):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(1, 90)))
        best = [(0.0, [])]
        for end in range(1, len(text) + 1):
            best.append(max(((best[end - n][0] + pieces[text[end - n:end]], best[end - n][1] + [text[end - n:end]]) for n in (1, 2, 3)
                             if n <= end and text[end - n:end] in pieces), key=lambda x: x[0]))
        stream = sentencepieces.Stream(model)
        stream.feed(text)
        got = [names[i] for i in stream.close()]
        assert "".join(got) == text and abs(sum(pieces[g] for g in got) - best[-1][0]) < 1e-9


PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/x">x</a></li></ul></nav><!-- c --><div class="ad">Buy
 now.</div><article><h1>Head &amp; line</h1><p>First <b>bold</b>
 text.<br>More<p>Second &eacute; &lt;tag&gt;</p><ul><li>one<li>two</ul><div class="comments"><p>I disagree.</p></div></article><footer>&copy; site</footer></body></html>"""


def test_blocks():
    got = [(b.path[-1], b.text) for b in html_extract.blocks(PAGE)]
    assert got == [("li", "x"), (".ad", "Buy now."), ("h1", "Head & line"), ("p", "First bold text. More"), ("p", "Second é <tag>"),
                   ("li", "one"), ("li", "two"), ("p", "I disagree."), ("footer", "© site")]
    for broken in ("", "<", "<p", "a<b", "<!-- x", "<script>x", "</p></div>", "<p>a<p>b", "plain &amp; text", "<a href='>'>q</a>"):
        html_extract.blocks(broken)


def test_blocks_after_raw_text():
    """What stands in a script, and looks like a tag or a comment, ends neither before nor after the script's own end tag."""
    for script in ("<script>for(var i=0;i<n;i++){f(i)}</script>", "<SCRIPT>if(a<b){s='</p>\"'}</Script >", "<style><!-- a{}</style>", "<script>'</scripted>'; x<y</script>",
                   "<title>a<b</title>", "<svg><script>i<n</script><text>t</text></svg>", "<template><style>a<b{}</style>x</template>", "<noscript><p>x</p></noscript>"):
        got = [b.text for b in html_extract.blocks(f"<p>one</p>{script}<article><p>two</p>{script}<p>three</p></article>four")]
        assert got == ["one", "two", "three", "four"], script
    assert [b.text for b in html_extract.blocks("<p>one</p><script>i<n <p>two</p>")] == ["one"]


def test_extract_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = html_extract.fit(pages)
    odd = spark.createDataFrame([(-1, "u", PAGE), (-2, None, None), (-3, "u", ""), (None, "u", "plain"), (-4, "u", "<article>" + "<p>word</p>" * 3000 + "</article>")],
                                "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extract.extract(pages.unionByName(odd).withColumn("text", F.lit(1)), model).collect()}
    assert got[-1].text == "Head & line\n\nFirst bold text. More\n\nSecond é <tag>\n\none\n\ntwo" and got[-1].n_chars == len(got[-1].text)
    assert got[-2].text == got[-3].text == "" and got[-4].n_kept == 3000
    wrong = 0
    for p in pages.collect():
        body = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        want = [b.text for b in html_extract.blocks(body)]
        wrong += got[p.page_id].text != "\n\n".join(want)
    assert wrong == 0
    assert html_extract.extract(pages.limit(0), html_extract.fit(pages.limit(0))).count() == 0


def test_labeller_gradients():
    import numpy as np
    rng = np.random.default_rng(0)
    net = html_extract.Labeller(5, 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = rng.standard_normal((2, 4, 5)), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool)
    y, told = rng.integers(0, 2, (2, 4)).astype(float), mask.astype(float)
    _, grads = net.gradients(x, mask, y, told)
    for name in net.p:
        flat, at = net.p[name].reshape(-1), int(rng.integers(net.p[name].size))
        old = flat[at]
        losses = []
        for d in (1e-3, -1e-3):
            flat[at] = old + d
            losses.append(net.gradients(x, mask, y, told)[0])
        flat[at] = old
        assert abs((losses[0] - losses[1]) / 2e-3 - grads[name].reshape(-1)[at]) < 2e-3


def test_urls(spark):
    rows = [("http://A.Example.NET/en/1?x=/y", "a.example.net", "/en/1", "example.net/en/"), ("https://b.net", "b.net", "", None), ("https://b.net/", "b.net", "/", "net/"),
            ("HTTP://x.example.com/de/1#a", "x.example.com", "/de/1", "example.com/de/"), ("http://myexample.com/de/1", "myexample.com", "/de/1", None),
            ("http://w.org/fr/", "w.org", "/fr/", "org/fr/"), ("no scheme/net/", "", "", None), (None, "", "", None), ("http://É.net/é", "É.net", "/é", "net/"),
            ("http://a?u=http://b.net/x", "a", "", None), ("", "", "", None)]
    labelled = spark.createDataFrame([(f"http://h{i}.example.org/en/{i}", 0) for i in range(200)] + [(f"http://buy-pills-{i}.example.org/en/{i}", 1) for i in range(60)]
                                     + [(None, 1), ("http://q/", None)], "url string, label int")
    model = urls.train(labelled, trees=5, depth=3)
    frame = spark.createDataFrame([(r[0], "mine", 3) for r in rows] + [("http://get-pills-9.example.org/en/1", "x", 1), ("http://h999.example.org/en/5", "x", 1)], "url string, rule string, depth int")
    got = urls.judge(frame, model, URL_RULES).collect()
    at = {r.url: r for r in got}
    assert len(got) == len(rows) + 2
    for url, host, path, rule in rows:
        assert (at[url].host, at[url].path, at[url].rule) == (host, path, rule), url
        if rule:
            assert at[url].verdict == dict(URL_RULES)[rule]
    assert at["http://get-pills-9.example.org/en/1"].verdict == "block" and at["http://h999.example.org/en/5"].verdict == "allow"
    assert urls.judge(frame.limit(0), model, URL_RULES).count() == 0
    for only in ([], [("http://a/", 0)]):
        assert {r.verdict for r in urls.judge(frame, urls.train(spark.createDataFrame(only, "url string, label int")), []).collect()} == {"allow"}
    assert "spam" in BAD_WORDS


def test_licences(spark):
    mit = licenses.TEMPLATES["MIT"][1].replace(". ", ".\n")
    rows = [("LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/x.py", "code\ncode"), ("a/b/COPYING.txt", mit), ("a/b/c/y.py", "print(1)"),
            ("a/b/c/z.py", "# This work is licensed under the GNU General Public License, version 3.\nx = 1"), ("a/b2/q.py", None), ("w/LICENSE", "nothing here"),
            ("w/v.py", ""), (None, "Released under the MIT License."), ("top.py", "All is well"), ("a/x.py", "code\ncode"), ("m/long.py", "prose " * 50000 + "\nReleased under the MIT License.")]
    got = licenses.scan(spark.createDataFrame([(*r, "mine") for r in rows], "path string, text string, licence string")).collect()
    at = {r.path: r for r in got}
    assert len(got) == len(rows)
    assert (at["a/x.py"].licence, at["a/x.py"].from_dir, at["a/x.py"].own_licence) == ("Apache-2.0", "", None)
    assert (at["a/b/c/y.py"].licence, at["a/b/c/y.py"].from_dir) == ("MIT", "a/b")
    assert (at["a/b/c/z.py"].own_licence, at["a/b/c/z.py"].licence, at["a/b/c/z.py"].from_dir) == ("GPL-3.0", "GPL-3.0", None)
    assert at["a/b2/q.py"].licence == at["w/v.py"].licence == at["top.py"].licence == "Apache-2.0"
    assert at[None].licence is None and at["m/long.py"].own_licence == "MIT" and at["a/b/COPYING.txt"].own_licence == "MIT"
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_wrapped_licence_headers(spark):
    """Every template, wrapped as a plain text, as a comment before code and amid prose, is found whole."""
    import textwrap
    want, rows = {}, []
    for name, group in licenses.TEMPLATES.items():
        for variant, text in enumerate(group):
            for width in (40, 72):
                wrapped = textwrap.wrap(text, width)
                for kind, body in (("plain", "\n".join(wrapped)), ("hash", "\n".join("# " + x for x in wrapped) + "\nimport os\nprint(os.name)"),
                                   ("star", "/*\n *\n" + "\n".join(" * " + x for x in wrapped) + "\n */\nint main;"),
                                   ("prose", "Shanre anin ndenon thenat.\n" + "\n".join(wrapped) + "\nErtion erre therth inorea enly.")):
                    rows.append((f"src/{name}/{variant}/{width}/{kind}.txt", body))
                    want[rows[-1][0]] = name
    half = licenses.TEMPLATES["MIT"][1]
    rows.append(("src/uncued.txt", "\n".join(textwrap.wrap(half[half.index("to deal in"):half.index("and to permit")], 72))))
    got = {r.path: r for r in licenses.own_licences(spark.createDataFrame(rows, "path string, text string"), 0.5).collect()}
    assert {p: got[p].licence for p in want if p in got} == want
    assert all(got[p].score > 0.9 for p in want), [(p, got[p].score) for p in want if got[p].score <= 0.9]
    assert got["src/uncued.txt"].licence == "MIT"
