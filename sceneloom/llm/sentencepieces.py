"""SentencePiece ids by a streaming Viterbi search over a public model's pieces.

The search goes through a text once. For each position it keeps how the best segmentation
so far ends there; only the last max-piece-length positions can be continued, so once the
paths of all of them run through one boundary, the ids up to it are final and leave the
window. For a unigram model "best" is the largest sum of piece scores. For a BPE model it
is the segmentation that the merges produce: exactly one last piece fits each position,
the one that stands unmerged beside the last piece before it.

No piece spans a boundary whose two characters stand in no piece together, so every path
meets there. In the models at hand each space that follows another character is such a
boundary; words between them are looked up in a bounded cache.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneloom.llm.common import slices

SPACE = "▁"
#: Words that a task remembers, and the longest of them.
CACHE_WORDS, CACHE_CHARS = 120_000, 48


class Model:
    """Pieces, scores and bytes of a SentencePiece model file with an identity normaliser."""

    def __init__(self, path: str, kind: str = "bpe"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.kind = kind
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.pieces = {sp.id_to_piece(i): i for i in plain}
        self.names = [sp.id_to_piece(i) for i in range(n)]
        self.scores = [sp.get_score(i) for i in range(n)]
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.longest = max(map(len, self.pieces))
        self.surface = [b""] * n
        for i in plain:
            self.surface[i] = self.names[i].replace(SPACE, " ").encode()
        for value, i in self.bytes.items():
            self.surface[i] = bytes([value])
        self.surface[self.unknown] = " ⁇ ".encode()
        # no piece goes on with a space after another character: paths meet before each such space
        self.line_apart = not any("\n" in p for p in self.pieces)
        self.words_apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.pieces)
        self.pairs: dict[int, bool] = {}
        # pieces by their characters from the last to the first: node = (next nodes, id of the piece that ends here or -1)
        self.ends: dict = {}
        for name, i in self.pieces.items():
            nodes = self.ends
            for c in name[:0:-1]:
                nodes = nodes.setdefault(c, [{}, -1])[0]
            nodes.setdefault(name[0], [{}, -1])[1] = i

    def merged(self, text: str) -> list[int]:
        """Ids by the merges themselves: the best-scored adjacent pair first, the leftmost of equals."""
        parts = list(text)
        pieces, scores = self.pieces, self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                t = pieces.get(parts[i] + parts[i + 1])
                if t is not None and (best is None or scores[t] > best):
                    best, at = scores[t], i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [pieces.get(p, -1) for p in parts]

    def stand_apart(self, a: int, b: int) -> bool:
        """Whether the merges leave the pieces a and b side by side."""
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(self.names[a] + self.names[b]) == [a, b]
        return known

    def single(self, a: int) -> bool:
        key = (a + 1) << 40
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs[key] = self.merged(self.names[a]) == [a]
        return known


    def window(self, text: str) -> list[int] | None:
        """Ids of a short text between two boundaries, by one search; None if a character is in no piece."""
        if self.kind != "bpe":
            return None
        ends, pair = self.ends, self.pairs.get
        last: list[int] = [-1]
        start = [0]
        for end in range(len(text)):
            nodes, fits, j = ends, [], end
            while j >= 0 and (node := nodes.get(text[j])) is not None:
                nodes, piece = node
                if piece >= 0:
                    fits.append((j, piece))
                j -= 1
            while fits:
                j, piece = fits.pop()
                if j:
                    before = last[j]
                    ok = pair(before << 20 | piece)
                    if ok is None:
                        ok = self.stand_apart(before, piece)
                else:
                    ok = self.single(piece)
                if ok:
                    last.append(piece)
                    start.append(j)
                    break
            else:
                return None
        ids, p = [], len(text)
        while p:
            ids.append(last[p])
            p = start[p]
        return ids[::-1]


class Stream:
    """The search over one text, fed in parts of any size; ``ids`` grows as paths converge."""

    def __init__(self, model: Model):
        self.m = model
        self.ids: list[int] = []
        self.tail = ""  # characters that the next piece may begin with
        self.at = 0  # position after the last character read
        self.base = 0  # committed up to here
        self.back: dict[int, tuple[int, int, float]] = {0: (0, -1, 0.0)}

    def feed(self, text: str) -> None:
        m, back = self.m, self.back
        pieces, longest = m.pieces, m.longest
        for c in text:
            self.tail = (self.tail + c)[-longest:]
            self.at = end = self.at + 1
            if c not in pieces:  # no piece has it: its bytes, with a boundary on either side
                self._commit(end - 1)
                self.ids += [m.bytes[b] for b in c.encode("utf-8", "surrogatepass")] if m.bytes else [m.unknown]
                back.clear()
                back[end] = (end, -1, 0.0)
                self.base, self.tail = end, ""
                continue
            tail, best = self.tail, None
            for size in range(min(len(tail), longest), 0, -1):
                before = back.get(end - size)
                if before is None:
                    continue
                piece = pieces.get(tail[-size:])
                if piece is None:
                    continue
                if m.kind == "bpe":
                    if m.stand_apart(before[1], piece) if before[1] >= 0 else m.single(piece):
                        best = (end - size, piece, 0.0)
                        break
                else:
                    score = before[2] + m.scores[piece]
                    if best is None or score > best[2]:
                        best = (end - size, piece, score)
            if best is not None:
                back[end] = best
            if end - self.base >= 4 * longest and end % longest == 0:
                self._converge()

    def _converge(self) -> None:
        alive = {p for p in range(self.at - self.m.longest + 1, self.at + 1) if p in self.back}
        while len(alive) > 1:
            p = max(alive)
            alive.discard(p)
            alive.add(max(self.back[p][0], self.base))
        meet = alive.pop() if alive else self.base
        if meet > self.base:
            last = self.back[meet]
            self._commit(meet)
            for p in [p for p in self.back if p < meet]:
                del self.back[p]
            # the boundary starts a new window, but the next piece still has to fit the last one
            self.back[meet] = (meet, last[1], last[2])
            self.base = meet

    def _commit(self, end: int) -> None:
        ids, p = [], end
        while p > self.base:
            start, piece, _ = self.back[p]
            ids.append(piece)
            p = start
        self.ids += ids[::-1]

    def close(self) -> list[int]:
        self._commit(self.at)
        self.base = self.at
        return self.ids


class _Words(dict):
    """Encoded words, by the word without the space before it."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.old: dict[str, bytes] = {}
        self.line_end = np.frombuffer(self.run("\n"), np.int32).tolist()

    def run(self, text: str) -> bytes:
        stream = Stream(self.model)
        stream.feed(text)
        return np.array(stream.close(), np.int32).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(word) > CACHE_CHARS:
            return self.run(word if word[:1] == "\n" else SPACE + word)
        got = self.old.get(word)
        if got is None:
            # a line end is in no piece: what follows it begins without a space
            text = word[1:] if word[:1] == "\n" else SPACE + word
            ids = self.model.window(text)
            if ids is None:
                got = self.run(word if word[:1] == "\n" else text)
            else:
                got = array("i", self.line_end + ids if word[:1] == "\n" else ids).tobytes()
        if len(self) >= CACHE_WORDS:  # words not met since the last time are forgotten
            self.old = dict(self)
            self.clear()
        self[word] = got
        return got


def _opened(path: str, kind: str) -> _Words:
    """The model and the words met so far, which a Python worker keeps from task to task."""
    import sentencepiece

    held = sentencepiece.__dict__.setdefault("_opened_models", {})
    if (path, kind) not in held:
        held[path, kind] = _Words(Model(path, kind))
    return held[path, kind]


def encode_text(text: str, known: _Words) -> bytes:
    """Ids of a whole text as 32-bit numbers."""
    if not text:
        return b""
    if not known.model.words_apart:
        return known.run(SPACE + text.replace(" ", SPACE))
    text = text.replace(SPACE, " ")
    if "  " in text or " \n" in text or text[0] in " \n" or text[-1] == " " or not known.model.line_apart:  # runs of spaces may form pieces of their own
        # one piece may hold several spaces, so a run of them stays with the word after it
        whole = SPACE + text.replace(" ", SPACE)
        return b"".join(known[w[1:]] if w[1:2] not in (SPACE, "\n") else known.run(w) for w in re.findall(f"{SPACE}+[^{SPACE}]*", whole))
    return b"".join(map(known.__getitem__, text.replace("\n", " \n").split(" ")))


def decode_ids(ids: pa.Array, surface: pa.Array) -> list[str | None]:
    """Texts of lists of ids; bytes that form no character become U+FFFD."""
    flat = surface.take(ids.values.slice(0) if ids.offset == 0 else ids.flatten())
    offsets = ids.offsets if ids.offset == 0 else pc.subtract(ids.offsets, ids.offsets[0])
    joined = pc.binary_join(pa.ListArray.from_arrays(offsets.cast(pa.int32()), flat), b"").to_pylist()
    texts = [None if x is None else x.decode("utf-8", "replace") for x in joined]
    return [x[1:] if x and x[0] == " " else x for x in texts]


def encode(docs: DataFrame, model_path: str, kind: str = "bpe") -> DataFrame:
    """(doc_id, ids, n_ids, round_trip) for every row of ``docs``.

    ``ids`` are those of the whole text; an empty text has none, a null text has null ids
    and n_ids 0. ``round_trip`` tells whether the ids decode to the text again (a literal
    U+2581 counts as the space it stands for in the model); it is null for a null text.
    ``model_path`` is a file that every executor has; the ids fit the vocabulary in it.
    """

    def run(batches):
        known = _opened(model_path, kind)
        model = known.model
        surface = pa.array(model.surface, pa.binary())
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            coded = [b"" if t is None else encode_text(t, known) for t in texts]
            n = np.array([len(c) // 4 for c in coded], np.int64)
            at = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
            flat = pa.array(np.frombuffer(b"".join(coded), np.int32))
            back = decode_ids(pa.ListArray.from_arrays(at, flat), surface)
            same = [None if t is None else t.replace(SPACE, " ") == b for t, b in zip(texts, back)]
            ids = pa.ListArray.from_arrays(at, flat, mask=pa.array([t is None for t in texts]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array(n), pa.array(same, pa.bool_())],
                                             ["doc_id", "ids", "n_ids", "round_trip"])

    return docs.select(F.expr("try_cast(doc_id as long)").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, ids array<int>, n_ids long, round_trip boolean")


def decode(coded: DataFrame, model_path: str, kind: str = "bpe") -> DataFrame:
    """(doc_id, text) of rows with ids; null ids give a null text. Ids must be of the model."""

    def run(batches):
        surface = pa.array(_opened(model_path, kind).model.surface, pa.binary())
        for part in batches:
            ids = part.column("ids")
            texts = decode_ids(pc.fill_null(ids, []), surface)
            gone = ids.is_null().to_pylist()
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([None if g else t for g, t in zip(gone, texts)], pa.string())], ["doc_id", "text"])

    return coded.select(F.expr("try_cast(doc_id as long)").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(
        run, "doc_id long, text string")
