"""Texts as arrays: code points, words and hashes of words for a whole batch at once.

Python objects per word are what makes text slow; here a batch of texts is one
array of code points, and words are spans of it with 64-bit hashes.
"""

from __future__ import annotations

from functools import cache

import numpy as np

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Characters with the property White_Space.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
ASCII_SPACE = (*range(0x09, 0x0E), 0x20)
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@cache
def classes() -> np.ndarray:
    """Class of each code point."""
    import unicodedata

    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[list(WHITE_SPACE)] = SPACE
    return table


@cache
def lower_table() -> np.ndarray:
    """Lower case of each code point that has one of a single code point."""
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        s = chr(c).lower()
        if len(s) == 1:
            table[c] = ord(s)
    return table


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(have)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Batch:
    """Texts laid end to end: ``cp`` holds the code points, text i is ``cp[off[i]:off[i + 1]]``."""

    def __init__(self, texts: list[str]) -> None:
        self.text = "".join(texts)
        self.cp = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.off = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=self.off[1:])

    def starts_of_texts(self) -> np.ndarray:
        """A flag for each code point that begins a text."""
        flag = np.zeros(len(self.cp) + 1, bool)
        flag[self.off] = True
        return flag[:-1]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs that are free of ASCII white space, never across texts."""
        white = np.zeros(0x110000, bool)
        white[list(ASCII_SPACE)] = True
        ink = ~white[self.cp]
        if not ink.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begins = self.starts_of_texts()
        prev = np.concatenate([[False], ink[:-1]])
        start = np.flatnonzero(ink & (~prev | begins))
        nxt = np.concatenate([ink[1:], [False]])
        last = np.concatenate([begins[1:], [True]])
        return start, np.flatnonzero(ink & (~nxt | last)) + 1

    def counts(self, starts: np.ndarray) -> np.ndarray:
        """How many of the sorted positions lie in each text."""
        return np.diff(np.searchsorted(starts, self.off))

    def hashes(self, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
        """64-bit hashes of spans; with ``fold`` of their lower case."""
        points = lower_table()[self.cp] if fold else self.cp
        n = len(points)
        run = np.zeros(n + 1, np.uint64)
        term = points.astype(np.uint64)
        term += np.uint64(1)
        term *= powers(BASE, n)
        np.cumsum(term, out=run[1:])
        h = run[ends] - run[starts]
        h *= powers(UNBASE, n + 1)[starts]
        h += (ends - starts).astype(np.uint64)
        return mixed(h)


def word_spans(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters and digits, never across texts."""
    kind = classes()[batch.cp]
    ink = (kind == LETTER) | (kind == NUMBER)
    if not ink.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = batch.starts_of_texts()
    start = np.flatnonzero(ink & (~np.concatenate([[False], ink[:-1]]) | begins))
    end = np.flatnonzero(ink & (~np.concatenate([ink[1:], [False]]) | np.concatenate([begins[1:], [True]]))) + 1
    return start, end


def flat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all given ranges, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return shift + np.arange(total)


def portions(texts: list[str], limit: int = 1 << 18):
    """Cut a list of texts into slices of about ``limit`` code points: pairs of first and last index."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)
