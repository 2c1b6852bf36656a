"""Texts that hold benchmark items: BM25 retrieval over passages, then an overlap check.

The items are the inverted index, every passage of every text is a query. Term impacts are
divided by the item's score for itself, so a passage that holds the whole item scores 1.
Items are kept in blocks; each term has its largest impact in each block. The terms of
large impact (the essential ones) open blocks: a block is scored only where the essential
terms' block maxima, plus all that the other terms could add there, reach the threshold.
No item above the threshold is missed, whatever its terms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sceneloom.llm.common import packed, slices, text_key, unpacked
from sceneloom.llm.wordhash import owners, shingles, words

K1, B = 1.2, 0.75
#: Items of a block, and bytes of item text that one index holds; larger sets take several passes.
BLOCK_ITEMS, INDEX_BYTES = 16, 16_000_000


class Index:
    """Postings, block maxima and word lists of some benchmark items."""

    def __init__(self, ids: list, questions: list[str], answers: list[str], idf: dict[int, float], mean_words: float, threshold: float,
                 stand_in: bool = False):
        self.stand_in = stand_in  # the answers are only the items' last words
        self.ids = list(ids)
        asked, asked_at = words(pa.array(questions, pa.string()))
        told, told_at = words(pa.array(answers, pa.string()))
        self.question = [asked[a:b] for a, b in zip(asked_at[:-1], asked_at[1:])]
        self.answer = [told[a:b] for a, b in zip(told_at[:-1], told_at[1:])]
        whole = [np.concatenate(x) for x in zip(self.question, self.answer)]
        self.longest = max((len(x) for x in whole), default=0)
        term, item, impact = [], [], []
        for i, x in enumerate(whole):
            t, tf = np.unique(x, return_counts=True)
            weight = np.array([idf.get(int(v), 0.0) for v in t.view(np.int64)])
            score = weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(x) / mean_words))
            term.append(t)
            item.append(np.full(len(t), i))
            impact.append(score / score.sum() if score.sum() > 0 else score)
        term, item, impact = np.concatenate(term), np.concatenate(item), np.concatenate(impact)
        order = np.lexsort((item, term))
        term, self.item, self.impact = term[order], item[order], impact[order]
        self.terms, first = np.unique(term, return_index=True)
        self.at = np.append(first, len(term))
        block = self.item // BLOCK_ITEMS
        owner = owners(self.at)
        # one entry for each term and block
        pair, self.block_of_posting = np.unique(owner * (len(ids) + 1) + block, return_inverse=True)
        top = np.zeros(len(pair))
        np.maximum.at(top, self.block_of_posting, self.impact)
        self.block, self.top = pair % (len(ids) + 1), top
        self.block_at = np.searchsorted(pair // (len(ids) + 1), np.arange(len(self.terms) + 1))
        # the commonest terms are left out of the search as long as what they add to any item stays under half the threshold
        spread = np.diff(self.at)
        added = np.zeros(len(ids))
        self.essential = np.ones(len(self.terms), bool)
        for t in np.argsort(-spread, kind="stable"):
            mine = slice(self.at[t], self.at[t + 1])
            more = added[self.item[mine]] + self.impact[mine]
            if more.max(initial=0) > threshold / 2:
                break
            added[self.item[mine]] = more
            self.essential[t] = False
        self.rest = np.zeros(len(ids) // BLOCK_ITEMS + 1)
        np.maximum.at(self.rest, np.arange(len(ids)) // BLOCK_ITEMS, added)
        # a table by 16 bits of the hash tells most words that no item has
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.terms >> np.uint64(44)] = True

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words that some item has, and their terms."""
        where = np.flatnonzero(self.seen[hashes >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.terms, hashes[where]), len(self.terms) - 1)
        good = self.terms[at] == hashes[where]
        return where[good], at[good]


def _expand(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of the lists ``rows``: for each entry the place in ``rows``, and its index."""
    n = at[rows + 1] - at[rows]
    which = np.repeat(np.arange(len(rows)), n)
    return which, at[rows][which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


def search(index: Index, hashes: np.ndarray, at: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word of the passage, item) with a BM25 score of ``threshold`` or more of the item's own.

    Passages are windows twice as long as the longest item and overlap by half, so an item
    that stands in a text lies whole within one.
    """
    none = np.zeros(0, np.int64)
    if not len(index.ids) or not len(hashes):
        return none, none, none
    half = max(index.longest, 16)
    where, term = index.lookup(hashes)
    text = owners(at)[where]
    # halves are numbered through all texts; passage p holds halves p and p + 1 of its text
    halves = np.maximum(-(-np.diff(at) // half), 1)
    start = np.concatenate(([0], np.cumsum(halves)))
    piece = start[text] + (where - at[text]) // half
    key = np.unique(piece * len(index.terms) + term)  # a term counts once in a half, which a passage's sum can only overrate
    piece, term = key // len(index.terms), key % len(index.terms)
    n_blocks = len(index.rest)
    open_piece, entry = _expand(index.block_at, term[index.essential[term]])
    cell = piece[index.essential[term]][open_piece] * n_blocks + index.block[entry]
    cells, back = np.unique(cell, return_inverse=True)
    upper = np.bincount(back, index.top[entry], len(cells))
    # the two halves of a passage: its own and the next one of the same text
    last = np.zeros(start[-1] + 1, bool)
    last[start[1:] - 1] = True
    passages = np.unique(np.concatenate((cells, cells[cells // n_blocks > 0] - n_blocks)))
    if not len(cells):
        return none, none, none

    def at_cell(x):
        i = np.minimum(np.searchsorted(cells, x), len(cells) - 1)
        return np.where(cells[i] == x, upper[i], 0.0)

    p = passages // n_blocks
    bound = at_cell(passages) + np.where(last[p], 0.0, at_cell(passages + n_blocks)) + index.rest[passages % n_blocks]
    passages = passages[bound >= threshold]
    if not len(passages):
        return none, none, none
    # exact scores within the open blocks
    p, block = passages // n_blocks, passages % n_blocks
    lo, hi = np.searchsorted(piece, p), np.searchsorted(piece, p + np.where(last[p], 1, 2))
    which, spot = _expand(np.stack((lo, hi), axis=1).reshape(-1), np.arange(len(p)) * 2)
    pair = np.unique(which * len(index.terms) + term[spot])
    which, t = pair // len(index.terms), pair % len(index.terms)
    back, posting = _expand(index.at, t)
    which = which[back]
    good = index.item[posting] // BLOCK_ITEMS == block[which]
    which, posting = which[good], posting[good]
    found, back = np.unique(which * len(index.ids) + index.item[posting], return_inverse=True)
    score = np.bincount(back, index.impact[posting], len(found))
    found = found[score >= threshold - 1e-9]
    which, item = found // len(index.ids), found % len(index.ids)
    text = np.searchsorted(start, p[which], side="right") - 1
    return text, at[text] + (p[which] - start[text]) * half, item


def _held(part: np.ndarray, passage: np.ndarray, size: int) -> float:
    """The share of a word list's runs of ``size`` words that the passage holds; 1 for an empty list."""
    if not len(part):
        return 1.0
    n = min(size, len(part))
    runs, _ = shingles(part, np.array([0, len(part)]), n)
    there, _ = shingles(passage, np.array([0, len(passage)]), n)
    return float(np.isin(runs, there).mean()) if len(passage) >= n else 0.0


def _verified(index: Index, texts: pa.Array, threshold: float, overlap: float, words_each: int) -> dict[tuple[int, int], tuple[float, float]]:
    """By (text, item): the question's and the answer's overlap with the best passage, where the item is held."""
    h, at = words(texts)
    best: dict[tuple[int, int], tuple[float, float]] = {}
    for t, first, i in zip(*(x.tolist() for x in search(index, h, at, threshold))):
        passage = h[first:min(first + 2 * max(index.longest, 16), at[t + 1])]
        q = _held(index.question[i], passage, words_each)
        a = _held(index.answer[i], passage, words_each)
        good = q >= overlap and a >= overlap
        if index.stand_in and not good:
            # one edit spoils most runs of so few words: their share counts too, or the runs of the whole item
            good = (q >= overlap and _held(index.answer[i], passage, 1) >= overlap
                    or _held(np.concatenate((index.question[i], index.answer[i])), passage, words_each) >= overlap)
        if good:
            best[t, i] = max(best.get((t, i), (0.0, 0.0)), (q, a))
    return best


def _answered(items: DataFrame) -> bool:
    return {"question", "answer"} <= set(items.columns)


def _sides(items: DataFrame) -> tuple[Column, Column]:
    """Question and answer; a table with only ``text`` asks with all but its last eight words."""
    if _answered(items):
        return F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit(""))
    w = F.filter(F.split(F.coalesce("text", F.lit("")), "\\s+"), lambda x: x != "")
    cut = F.greatest(F.size(w) - 8, F.lit(1))
    return F.array_join(F.slice(w, F.lit(1), cut), " "), F.array_join(F.filter(w, lambda x, i: i >= cut), " ")


def indexes(items: DataFrame, threshold: float) -> list[Index]:
    """Indexes that together hold all items, each over INDEX_BYTES of text at most (a longer item stands alone).

    Spark counts words and items; idf and mean length are those of all items, so scores
    don't depend on the number of indexes. Items without a word take no part; an id may be
    null or of any type, and rows equal in id and text are one item.
    """
    q, a = _sides(items)
    rows = items.select(F.col("item_id").alias("id"), q.alias("q"), a.alias("a")).distinct()

    def count(batches):
        for part in slices(batches, "t"):
            h, at = words(part.column("t"))
            owner = owners(at)
            key = np.unique(np.stack((owner, h.view(np.int64)), axis=1), axis=0) if len(h) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key[:, 1]), pa.array(np.ones(len(key), np.int64))], ["term", "n"])

    def lengths(batches):
        for part in slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(words(part.column("t"))[1]))], ["n"])

    texts = rows.select(F.concat_ws(" ", "q", "a").alias("t"))
    sizes = texts.mapInArrow(lengths, "n long").filter("n > 0").agg(F.count(F.lit(1)).alias("n"), F.avg("n").alias("mean")).first()
    if not sizes.n:
        return []
    frequency = texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))
    idf = frequency.select("term", F.log(1 + (sizes.n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    total = rows.agg(F.sum(F.octet_length("q") + F.octet_length("a"))).first()[0] or 0
    shards = int(total // INDEX_BYTES) + 1
    out = []
    for s in range(shards):
        part = rows if shards == 1 else rows.filter(F.pmod(F.xxhash64("id", "q"), F.lit(shards)) == s)

        def own_terms(batches):
            for b in slices(batches, "t"):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(words(b.column("t"))[0]).view(np.int64))], ["term"])

        mine = part.select(F.concat_ws(" ", "q", "a").alias("t")).mapInArrow(own_terms, "term long").distinct()
        weights = {r.term: r.idf for r in idf.join(mine, "term").collect()}
        got = sorted(part.collect(), key=lambda r: (r.id is not None, r.id if r.id is not None else 0, r.q, r.a))
        if got:
            out.append(Index([r.id for r in got], [r.q for r in got], [r.a for r in got], weights, sizes.mean, threshold, not _answered(items)))
    return out


def matches(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.6, words_each: int = 5) -> DataFrame:
    """(doc_id, key, item_id, question_overlap, answer_overlap) of texts that hold benchmark items.

    A passage that BM25 retrieves (``threshold`` of the item's score for itself) is
    checked: ``overlap`` of the five-word runs of the question, and of the answer's, must
    stand in it. Items with only ``text`` have no real answer: ``overlap`` of the last eight
    words, or of the whole item's runs, is enough there. Of several passages the best counts. Null and empty texts match nothing;
    rows equal in doc_id and text give equal rows, an empty table gives none, further columns are left out.
    A doc_id that is no number counts as null; item ids stay as they are, null and texts too.
    """
    read = docs.select(F.expr("try_cast(doc_id as long)").alias("doc_id"), text_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id long, key long, item_id {kind}, question_overlap double, answer_overlap double"
    out = spark.createDataFrame([], schema)
    id_type = to_arrow_type(items.schema["item_id"].dataType)
    for index in indexes(items, threshold):
        held = spark.sparkContext.broadcast(index)  # INDEX_BYTES of text bound its size

        def run(batches, held=held):
            for part in slices(batches):
                best = _verified(held.value, part.column("text"), threshold, overlap, words_each)
                found = sorted(best)
                rows = pa.array([t for t, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(rows), part.column("key").take(rows), pa.array([held.value.ids[i] for _, i in found], id_type),
                     pa.array([best[x][0] for x in found], pa.float64()), pa.array([best[x][1] for x in found], pa.float64())],
                    ["doc_id", "key", "item_id", "question_overlap", "answer_overlap"])

        out = out.unionByName(read.mapInArrow(run, schema))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.6, words_each: int = 5) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item (as ``matches`` finds them); each row is judged alone, so none moves."""
    rows = packed(docs, _text=F.col("text"))
    schema = f"_row {rows.schema['_row'].dataType.simpleString()}, _text string"
    for index in indexes(items, threshold):
        held = docs.sparkSession.sparkContext.broadcast(index)  # INDEX_BYTES of text bound its size

        def run(batches, held=held):
            for part in slices(batches, "_text"):
                clean = np.ones(part.num_rows, bool)
                clean[[t for t, _ in _verified(held.value, part.column("_text"), threshold, overlap, words_each)]] = False
                yield part.filter(pa.array(clean))

        rows = rows.mapInArrow(run, schema)
    return unpacked(rows)
