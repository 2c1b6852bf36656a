"""Words and word shingles of many texts as 64-bit hashes, by whole-array operations.

A word is a run of ASCII letters, digits and non-ASCII characters of the lower-cased text;
signs of the Latin, general and CJK punctuation blocks count as spaces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sceneloom.llm.common import text_bytes

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SIGNS = "[\\x{0080}-\\x{00BF}\\x{2000}-\\x{206F}\\x{3000}-\\x{303F}]"
_WORD = np.zeros(256, bool)
_WORD[0x80:] = True
for _a, _b in (("0", "9"), ("a", "z"), ("A", "Z")):
    _WORD[ord(_a):ord(_b) + 1] = True
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = 1 << int(n - 1).bit_length()
        for name, base in (("up", _BASE), ("down", _UNBASE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits look independent."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin (one entry more than texts)."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    if pc.any(pc.match_substring_regex(low, _SIGNS)).as_py():
        low = pc.replace_substring_regex(low, _SIGNS, " ")
    raw, at = text_bytes(low)
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = _WORD[raw]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[at[:-1][at[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    cut = at[1:-1]
    after[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after)
    up, down = _powers(n)
    total = np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)
    sums = total[ends]
    sums[starts > 0] -= total[starts[starts > 0] - 1]
    hashes = mix(sums * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, at)


def owners(at: np.ndarray) -> np.ndarray:
    """For each element of lists that begin at ``at``, the number of its list."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def shingles(hashes: np.ndarray, at: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words; a text of fewer words (but one at least) has one shingle."""
    n_words = np.diff(at)
    counts = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    new_at = np.concatenate(([0], np.cumsum(counts)))
    if not len(hashes):
        return np.zeros(0, np.uint64), new_at
    # where a text ends early, its one shingle is hashed from what there is
    padded = np.concatenate((hashes, np.zeros(size, np.uint64)))
    owner = owners(new_at)
    first = at[:-1][owner] + (np.arange(new_at[-1]) - new_at[:-1][owner])
    end = at[1:][owner]
    out = np.zeros(len(first), np.uint64)
    for k in range(size):
        word = padded[first + k]
        out = out * _BASE + np.where(first + k < end, word, np.uint64(k + 1))
    return mix(out), new_at


def distinct(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of each list as 44-bit numbers in order, where each list begins, and how often each occurs."""
    lists = len(at) - 1
    if lists >= 1 << 20:
        raise ValueError("at most 2**20 - 1 lists at a time")
    key = np.sort((owners(at).astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    if not len(key):
        return key, np.zeros(lists + 1, np.int64), np.zeros(0, np.int64)
    new = np.empty(len(key), bool)
    new[0] = True
    np.not_equal(key[1:], key[:-1], out=new[1:])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(key)))
    key = key[first]
    begin = np.searchsorted(key, np.arange(lists + 1, dtype=np.uint64) << np.uint64(44))
    return key & np.uint64((1 << 44) - 1), begin, times
