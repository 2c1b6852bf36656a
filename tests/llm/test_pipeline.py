"""Each stage of the pipeline on what the one before it kept, against a plain version."""

import re

import corpus_pipeline
import sentencepiece
from corpus_pipeline import MOST_LOST
from test_matching import classes

from sceneloom.llm.queries import MODEL_PATH, SITES

SF = "/root/testdata/sf0.001"
BLANK = " \t\x0b\x0c\r"


def without_spread_lines(rows):
    sites, first = {}, {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        for p, line in enumerate(r.text.split("\n")):
            if line.strip(BLANK):
                sites.setdefault(line, set()).add(r.source)
                first.setdefault(line, (r.doc_id, p))
    gone = {x for x, s in sites.items() if len(s) >= SITES}
    out = {}
    for r in rows:
        lines = r.text.split("\n")
        stay = [x for p, x in enumerate(lines) if x not in gone or first[x] == (r.doc_id, p)]
        lost = sum(map(len, lines)) - sum(map(len, stay))
        out[r.doc_id] = "\n".join(stay) if lost <= MOST_LOST * len(r.text) else r.text
    return out


def held_items(text, items):
    words = f" {' '.join(re.findall(r'[^\W_]+', text.lower()))} "
    return [i for i, t in items.items() if f" {' '.join(re.findall(r'[^\W_]+', t.lower()))} " in words]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        assert name == "token_ids" or docs.columns == names
    all_docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    spoken = {r.doc_id for r in kept["language"]}
    assert len(spoken) >= 0.98 * len(all_docs)
    assert {r.doc_id: r.text for r in kept["lines"]} == without_spread_lines(kept["language"])
    assert all(r.n_chars == len(r.text) for r in kept["lines"])
    rows = [(r.doc_id, r.text) for r in kept["lines"]]
    assert {r.doc_id for r in kept["near_duplicates"]} == {c for _, c in classes(rows)}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    clean = {r.doc_id for r in kept["near_duplicates"] if not held_items(r.text, items)}
    assert {r.doc_id for r in kept["benchmark"]} == clean and len(clean) < len(kept["near_duplicates"])
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
    texts = {r.doc_id: r.text for r in kept["benchmark"]}
    assert {r.doc_id: r.ids for r in kept["token_ids"]} == {d: library.encode(t) for d, t in texts.items()}
    assert all(r.round_trip for r in kept["token_ids"])


def test_a_page_on_twelve_sources_stays_once(spark, tmp_path):
    """Copied pages, nulls, empty and repeated rows through the first three stages."""
    source = spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en' and length(text) > 800").orderBy("doc_id").limit(3).collect()
    page = source[0].text
    rows = [(1000 + i, page, "en", f"copy{i}", len(page)) for i in range(12)]
    rows += [(2000, source[1].text, "en", "a", 1), (2000, source[1].text, "en", "a", 1), (2001, None, None, None, None), (2002, "", "en", "a", 0), (None, source[2].text, "en", "a", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF if name == "language" else str(tmp_path))
    got = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    assert got == sorted([(1000, page), (2000, source[1].text), (None, source[2].text)], key=str)


def test_stages_of_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0
