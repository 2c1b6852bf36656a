"""Main text of HTML pages: a recurrent labeller over each page's blocks.

A page becomes the sequence of its leaf blocks. A block's vector holds its tag path (tags,
classes and ids of the open elements, hashed), its words (hashed) and a few ratios. A
bidirectional LSTM in numpy reads the whole sequence both ways, so every block is judged
by all that stands before and after it. It is trained on a bounded sample of pages whose
blocks are labelled by what their elements say (article against nav, aside, footer, form,
advert and comment containers), in several disguises of the same roles, so that it does
not hang on one template.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneloom.llm.common import about, slices
from sceneloom.llm.wordhash import owners, words

# Fixed values of HTML: elements without an end, with raw text, inline, and those that end an open p.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea select iframe svg math object title".split())
# Of the elements with raw text those whose content has no tags: only their own end tag ends them, whatever stands before it.
RAW_TEXT = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in "script style textarea iframe title".split()}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
             "time tt u var br img wbr".split())
ENDS_P = set("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p "
             "pre section table ul".split())
CLOSES_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

# Names that say what a container is for.
MAIN_NAMES = "article main content post entry story body-text post-content entry-content article-body".split()
SIDE_NAMES = ("nav menu navbar breadcrumb header masthead banner footer colophon sidebar aside widget related share social ad ads advert advertisement sponsored "
              "promo cookie consent notice alert popup modal newsletter subscribe form login search comments comment respond replies pagination tags").split()
SIDE_TAGS = set("nav aside footer header form button menu dialog".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PATH_SLOTS, WORD_SLOTS, NUMBERS = 192, 32, 6
SAMPLE_PAGES, SAMPLE_BYTES, HIDDEN, EPOCHS = 160, 20_000, 16, 24


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[str, ...], text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: runs of text between block-level tags, with white space made one space."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []  # open block-level elements and their names
    said: list[str] = []
    linked, in_link, at, pos, raw = 0, 0, 0, 0, ""

    def flush():
        nonlocal linked
        if said:
            text = " ".join("".join(said).split())
            if text:
                out.append(Block(tuple(x for _, names in stack for x in names), text, linked))
            said.clear()
        linked = 0

    def say(piece: str):
        nonlocal linked
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            said.append(piece)
            if in_link:
                linked += len(piece.strip())

    def close(i: int):
        flush()
        del stack[i:]

    while m := TOKEN.search(page, pos):
        pos = m.end()
        if m[2] and not m[1] and m[2].lower() in RAW_TEXT and not m[3].rstrip().endswith("/"):
            end = RAW_TEXT[m[2].lower()].search(page, pos)
            pos = end.end() if end else len(page)
            if not raw:
                say(page[at:m.start()])
                at = pos
            continue
        if raw:
            # the text of these elements is no text of the page; only their own end tag counts
            if m[1] and m[2].lower() == raw:
                raw, at = "", pos
            continue
        say(page[at:m.start()])
        at = pos
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                said.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                in_link = 0
            elif tag == "br":
                said.append(" ")
            elif tag not in INLINE:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        close(i)
                        break
                else:
                    flush()
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                raw = tag
            continue
        if tag == "br":
            said.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 1
            continue
        flush()
        in_link = 0
        if tag in ENDS_P or tag in CLOSES_ITSELF:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" and tag in ENDS_P or stack[i][0] in CLOSES_ITSELF.get(tag, ()):
                    close(i)
                    break
                if stack[i][0] in ENDS_P or stack[i][0] in ("td", "th", "table", "ul", "ol", "dl"):
                    break
        if tag in VOID:
            continue
        names = [tag]
        if "=" in m[3]:
            for got in NAMES.findall(m[3]):
                names += ["." + x for x in re.split(r"[\s_]+", (got[0] or got[1] or got[2]).lower()) if x]
        stack.append((tag, tuple(names)))
    if not raw:
        say(page[at:])
    flush()
    return out


def _slot(name: str, slots: int) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % slots


def _role(names: tuple[str, ...]) -> float | None:
    """1 for a block of the article, 0 for one beside it; None if its elements say neither."""
    found = None
    for name in names:
        bare = name.lstrip(".")
        if bare in SIDE_TAGS or name.startswith(".") and (bare in SIDE_NAMES or bare.split("-")[0] in SIDE_NAMES):
            return 0.0
        if bare in MAIN_NAMES:
            found = 1.0
    return found


def vectors(pages: list[list[Block]], known: dict[tuple[str, ...], list[int]]) -> list[np.ndarray]:
    """For each page a row for each block: hashed tag path, hashed words, ratios. ``known`` keeps the slots of paths."""
    flat = [b for page in pages for b in page]
    x = np.zeros((len(flat), PATH_SLOTS + WORD_SLOTS + NUMBERS), np.float32)
    if not flat:
        return [x for _ in pages]
    rows, slots = [], []
    for i, b in enumerate(flat):
        at = known.get(b.path)
        if at is None:
            at = known[b.path] = sorted({_slot(n, PATH_SLOTS) for name in b.path for n in {name, *name.lstrip(".").split("-")}})
        rows += [i] * len(at)
        slots += at
    x[rows, slots] = 1
    hashes, begin = words(pa.array([b.text for b in flat], pa.string()))
    count = np.bincount(owners(begin) * WORD_SLOTS + (hashes % np.uint64(WORD_SLOTS)).astype(np.int64), minlength=len(flat) * WORD_SLOTS).reshape(len(flat), WORD_SLOTS)
    x[:, PATH_SLOTS:PATH_SLOTS + WORD_SLOTS] = count / np.maximum(1, np.linalg.norm(count, axis=1))[:, None]
    chars = np.array([len(b.text) for b in flat])
    sizes = np.array([len(p) for p in pages])
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    x[:, -NUMBERS:] = np.stack((
        np.minimum(np.log1p(chars) / 8, 2), np.minimum(np.log1p(np.diff(begin)) / 6, 2), np.minimum(np.array([b.linked for b in flat]) / chars, 1),
        np.array([b.text[-1] in ".!?" for b in flat]), place / np.repeat(sizes, sizes), np.array([len(b.path) for b in flat]) / 16), axis=1)
    return np.split(x, np.cumsum(sizes)[:-1])


class Labeller:
    """A bidirectional LSTM with a logistic output for each block."""

    def __init__(self, inputs: int = PATH_SLOTS + WORD_SLOTS + NUMBERS, hidden: int = HIDDEN, seed: int = 5):
        r = np.random.default_rng(seed)
        self.h = hidden
        self.p = {}
        for d in "fb":
            self.p[f"W{d}"] = (r.standard_normal((inputs + hidden, 4 * hidden)) / np.sqrt(inputs + hidden)).astype(np.float32)
            self.p[f"c{d}"] = np.zeros(4 * hidden, np.float32)
            self.p[f"c{d}"][hidden:2 * hidden] = 1  # remember by default
        self.p["V"] = (r.standard_normal((2 * hidden, 1)) / np.sqrt(2 * hidden)).astype(np.float32)
        self.p["v"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (batch, steps, h) of one direction; padded steps leave the state as it is."""
        n, steps, width = x.shape
        h, c = np.zeros((n, self.h), np.float32), np.zeros((n, self.h), np.float32)
        out = np.zeros((n, steps, self.h), np.float32)
        w, k = self.p[f"W{d}"], self.h
        into = x @ w[:width] + self.p[f"c{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = into[:, t] + h @ w[width:]
            gates = 1 / (1 + np.exp(-np.clip(z[:, :3 * k], -30, 30)))
            g = np.tanh(z[:, 3 * k:])
            i, f, o = gates[:, :k], gates[:, k:2 * k], gates[:, 2 * k:]
            m = mask[:, t, None]
            new = f * c + i * g
            tc = np.tanh(new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tc))
            h, c = np.where(m, o * tc, h), np.where(m, new, c)
            out[:, t] = h
        return out

    def score(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate((self._run(x, mask, "f"), self._run(x, mask, "b")), axis=2)
        return (both @ self.p["V"] + self.p["v"])[:, :, 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, told: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        kept = {d: [] for d in "fb"}
        states = {d: self._run(x, mask, d, kept[d]) for d in "fb"}
        both = np.concatenate((states["f"], states["b"]), axis=2)
        p = 1 / (1 + np.exp(-np.clip((both @ self.p["V"] + self.p["v"])[:, :, 0], -30, 30)))
        err = (p - y) * told / max(1, told.sum())
        loss = -float((told * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / max(1, told.sum()))
        grads = {"V": np.einsum("bth,bt->h", both, err)[:, None], "v": np.array([err.sum()], np.float32)}
        down = err[:, :, None] * self.p["V"][:, 0]
        k = self.h
        for d, part in (("f", down[:, :, :k]), ("b", down[:, :, k:])):
            w = self.p[f"W{d}"]
            width = w.shape[0] - k
            gw, gc = np.zeros_like(w), np.zeros(4 * k, np.float32)
            dh, dc = np.zeros((len(x), k), np.float32), np.zeros((len(x), k), np.float32)
            for t, h, c, i, f, o, g, tc in reversed(kept[d]):
                m = mask[:, t, None]
                full = dh + part[:, t]
                dnew = np.where(m, full * o * (1 - tc * tc) + dc, 0)
                dz = np.concatenate((dnew * g * i * (1 - i), dnew * c * f * (1 - f), np.where(m, full * tc * o * (1 - o), 0), dnew * i * (1 - g * g)), axis=1)
                gw[:width] += x[:, t].T @ dz
                gw[width:] += h.T @ dz
                gc += dz.sum(0)
                dh = np.where(m, dz @ w[width:].T, full)
                dc = np.where(m, dnew * f, dc)
            grads[f"W{d}"], grads[f"c{d}"] = gw, gc
        return loss, grads


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((len(pages), steps, pages[0].shape[1]), np.float32)
    mask = np.zeros((len(pages), steps), bool)
    for i, p in enumerate(pages):
        x[i, :len(p)], mask[i, :len(p)] = p, True
    return x, mask


def disguises(page: str, rng: np.random.Generator) -> str:
    """The page with its roles under other names and some more side blocks around the article."""
    def pick(names):
        return names[int(rng.integers(len(names)))]

    def box(role, text):
        tag = pick(["div", "section", "div"])
        return f'<{tag} class="{role}"><p>{text}</p></{tag}>'

    told = re.sub(r"<[^>]+>", " ", page)[:20000].split() or ["text"]
    some = lambda: " ".join(told[int(rng.integers(len(told)))] for _ in range(int(rng.integers(3, 40))))
    if rng.random() < 0.5:
        page = re.sub(r"<article\b", f'<div class="{pick(MAIN_NAMES)}"', page)
        page = page.replace("</article>", "</div>")
    if rng.random() < 0.4:
        page = re.sub(r"<nav\b", f'<div class="{pick(["menu", "navbar", "nav"])}"', page).replace("</nav>", "</div>")
    if rng.random() < 0.4:
        page = re.sub(r"<footer\b", f'<div id="{pick(["footer", "colophon"])}"', page).replace("</footer>", "</div>")
    def inner(m):
        kind = rng.random()
        if kind < 0.08:
            return "<ul>" + "".join(f"<li>{pick(told) if rng.random() < 0.5 else some()}" for _ in range(int(rng.integers(1, 6)))) + "</ul>"
        if kind < 0.12:
            return f"<blockquote><p>{m[1]}</p></blockquote>"
        if kind < 0.16:
            return f"<table><tr><td>{m[1]}</td><td>{some()}</td></tr></table>"
        return f"<h2>{m[1]}</h2>" if kind < 0.2 else f"<ol><li>{m[1]}</ol>" if kind < 0.24 else f"<pre>{m[1]}</pre>" if kind < 0.28 else m[0]

    page = re.sub(r"<p>([^<]*)</p>", inner, page)
    extra = [box(pick(SIDE_NAMES), some()) for _ in range(int(rng.integers(0, 5)))]
    extra += [f"<aside><p>{some()}</p></aside>", f"<header><p>{some()}</p></header>", f"<form><p>{some()}</p></form>"][:int(rng.integers(0, 4))]
    for e in extra:
        spots = [m.start() for m in re.finditer(r"<article\b|<footer\b|</body>|<div\b|</article>|<p>", page)] or [len(page)]
        s = pick(spots)
        page = page[:s] + e + page[s:]
    return page


def train(pages: list[str], epochs: int = EPOCHS, seed: int = 11) -> Labeller:
    """A labeller taught by what the elements of the pages, and of their disguises, say."""
    rng = np.random.default_rng(seed)
    data = []
    all_pages = [b for b in map(blocks, [*pages, *(disguises(p, rng) for p in pages for _ in range(2))]) if b]
    for found, x in zip(all_pages, vectors(all_pages, {})):
        told = [_role(b.path) for b in found]
        data.append((x, np.array([t or 0.0 for t in told], np.float32), np.array([t is not None for t in told], np.float32)))
    model = Labeller(seed=seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    step = 0
    for epoch in range(epochs if data else 0):
        order = sorted(rng.permutation(len(data)), key=lambda i: len(data[i][0]))
        groups = [order[i:i + 16] for i in range(0, len(order), 16)]
        for g in rng.permutation(len(groups)):
            part = [data[i] for i in groups[g]]
            x, mask = padded([p[0] for p in part])
            # words and ratios are hidden at random, since they differ from site to site more than paths do
            x[..., PATH_SLOTS:] *= rng.random((*mask.shape, 1)) < 0.3
            y, told = (np.zeros(mask.shape, np.float32) for _ in range(2))
            for i, p in enumerate(part):
                y[i, :len(p[1])], told[i, :len(p[2])] = p[1], p[2]
            _, grads = model.gradients(x, mask, y, told)
            step += 1
            size = np.sqrt(sum(float((v * v).sum()) for v in grads.values()))
            for k, v in grads.items():
                v = v * min(1.0, 2.0 / (size + 1e-9))
                a, b = moments[k]
                a[:] = 0.9 * a + 0.1 * v
                b[:] = 0.99 * b + 0.01 * v * v
                model.p[k] -= 0.02 * (1 - epoch / epochs) * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-8)
    return model


def fit(pages: DataFrame, sample: int = SAMPLE_PAGES, sample_bytes: int = SAMPLE_BYTES) -> Labeller:
    """A labeller from ``sample`` pages taken by their hash; of a page larger than ``sample_bytes`` its first part teaches.

    Some four times the sample reach the last choice, whatever the number of different pages;
    copies of one page count once.
    """
    full = pages.filter("html is not null").select(F.substring("html", 1, sample_bytes).alias("html"))
    different = full.agg(F.approx_count_distinct(F.xxhash64("html"))).first()[0]
    some = (full.filter(about(4 * sample, different, F.col("html"))).distinct().orderBy(F.xxhash64("html"), "html").limit(sample).collect())
    return train([r.html for r in some])


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_kept) for every row of ``pages``.

    ``text`` joins the blocks that the labeller takes for the article by an empty line, in
    page order; none gives an empty text. A null or empty page has no blocks. Pages of
    any length are read whole; other columns are not looked at.
    """
    held = pages.sparkSession.sparkContext.broadcast(model)  # some ten thousand numbers

    def run(batches):
        net, known = held.value, {}
        for part in slices(batches, "html"):
            found = [blocks(p or "") for p in part.column("html").to_pylist()]
            texts, kept = [""] * len(found), [0] * len(found)
            rows = vectors(found, known)
            order = sorted((i for i, b in enumerate(found) if b), key=lambda i: len(found[i]))
            start = 0
            while start < len(order):
                # pages of like length together, some 4,000 steps at a time
                end = start + 1
                while end < len(order) and (end - start + 1) * len(found[order[end]]) <= 4000:
                    end += 1
                group = order[start:end]
                x, mask = padded([rows[i] for i in group])
                score = net.score(x, mask)
                for row, i in enumerate(group):
                    good = [b.text for b, s in zip(found[i], score[row]) if s > 0]
                    texts[i], kept[i] = "\n\n".join(good), len(good)
                start = end
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([len(b) for b in found], pa.int64()), pa.array(kept, pa.int64())],
                ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    return pages.select(F.expr("try_cast(page_id as long)").alias("page_id"), "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")
