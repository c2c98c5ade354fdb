"""Licence notices in documents: winnowed fingerprints, then banded alignment.

Templates and documents are sequences of words in lower case, without
punctuation. Templates are fingerprinted: of the hashes of their word 3-grams,
the least of every window is kept (winnowing). Hash and place go into an
inverted index. A document is fingerprinted in the same way with the same
windows, so any passage it shares with a template that is as long as a window
leaves a common fingerprint. Hits of a template whose places grow in text and
template alike are chained over gaps of up to a quarter of the template's
words, put in or left out between two hits; each chain picks a stretch of the
document, and a banded alignment of the whole template against the stretch
reports what matched.

A match is reported when at least ``coverage`` of the template's words align.
Of matches that overlap in the text the one with more matched words stays.

Defined results: null and empty texts have no matches; templates of fewer
words than a 3-gram are refused; repeated documents are reported each; a
notice that occurs several times is reported each time, even without a word
between; texts are scanned whole.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import TEMPLATES
from .textvec import Batch, mixed, portions, word_spans

GRAM, WINDOW = 3, 2
COVERAGE = 0.8
BAND = 8
PRIME = np.uint64(0x100000001B3)
SCHEMA = "doc_id long, license string, template int, start long, end long, matched long, template_words long, coverage double, matched_text string"


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(size, np.uint64)
    for k in range(n):
        h = mixed(h * PRIME + words[k : k + size])
    return h


def winnowed(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of each window of consecutive hashes, the last on ties."""
    if len(h) <= window:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))], np.int64) if len(h) else np.zeros(0, np.int64)
    best = np.arange(len(h) - window + 1)
    for k in range(1, window):
        other = np.arange(len(best)) + k
        best = np.where(h[other] <= h[best], other, best)
    return np.unique(best)


class Templates:
    def __init__(self, texts: Mapping[str, Sequence[str]], gram: int, window: int) -> None:
        self.names, self.numbers, self.words = [], [], []
        self.gram, self.window = gram, window
        index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for name, variants in texts.items():
            for k, text in enumerate(variants):
                batch = Batch([text])
                words = batch.hashes(*word_spans(batch), fold=True)
                if len(words) < gram:
                    raise ValueError(f"template {name} has fewer than {gram} words")
                h = gram_hashes(words, gram)
                for p in winnowed(h, window).tolist():
                    index[int(h[p])].append((len(self.names), p))
                self.names.append(name)
                self.numbers.append(k)
                self.words.append(words)
        self.bags = [np.unique(w, return_counts=True) for w in self.words]
        self.hashes = np.array(sorted(index), np.uint64)
        self.postings = [index[int(x)] for x in self.hashes]


def in_common(bag: tuple[np.ndarray, np.ndarray], text: np.ndarray) -> int:
    """Words that a template and a text have in common in any order; no alignment matches more."""
    known, counts = bag
    at = np.searchsorted(known, text)
    at[at == len(known)] = 0
    return int(np.minimum(np.bincount(at[known[at] == text], minlength=len(known)), counts).sum())


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """Longest common subsequence of the template and a stretch near ``shift``: matched words, first and last + 1.

    Only cells within ``band`` of the diagonal through the shift are looked at.
    """
    m = len(template)
    width = 2 * band + 1
    low = shift - band
    # score, first matched place and last matched place for each offset of the band
    score, first, last = np.zeros(width + 1, np.int64), np.full(width + 1, -1), np.full(width + 1, -1)
    for i in range(m):
        places = low + i + np.arange(width)
        ok = (places >= 0) & (places < len(text))
        hit = np.zeros(width, bool)
        hit[ok] = text[places[ok]] == template[i]
        # Along the diagonal the offset stays; skipping a word of the template comes from the next offset.
        up = score[1:] > score[:-1]
        new = np.where(up, score[1:], score[:-1])
        f, z = np.where(up, first[1:], first[:-1]), np.where(up, last[1:], last[:-1])
        gain = hit & (score[:-1] + 1 >= new)
        new = np.where(gain, score[:-1] + 1, new)
        f = np.where(gain, np.where(first[:-1] < 0, places, first[:-1]), f)
        z = np.where(gain, places, z)
        # Skipping a word of the text: the best offset so far.
        best = np.maximum.accumulate(new)
        at = np.maximum.accumulate(np.where(new == best, np.arange(width), 0))
        at = np.where(new[at] == best, at, np.arange(width))
        score[:-1], first[:-1], last[:-1] = new[at], f[at], z[at]
    k = int(np.argmax(score[:-1]))
    return int(score[k]), int(first[k]), int(last[k]) + 1


def chains(hits: list[tuple[int, int]], drift: int, size: int) -> list[list[tuple[int, int]]]:
    """Hits (place in the text, place in the template) as chains in which both places grow, in the order of their first places.

    Each hit follows the hit before it that ends the longest chain, the nearest
    of those as long; their shifts differ by at most ``drift``, so only hits of
    the last ``size + drift`` places are looked at. The longest chain is taken
    first, and others do without its hits. A notice's own words inside it are
    chains of their own, and a notice that stands twice gives two.
    """
    own = np.array(sorted(hits), np.int64).reshape(-1, 2)
    place, p = own[:, 0], own[:, 1]
    shift = place - p
    length, before = np.ones(len(own), np.int64), np.full(len(own), -1)
    since = np.searchsorted(place, place - size - drift)
    upto = np.searchsorted(place, place)
    for k in range(len(own)):
        a, b = since[k], upto[k]
        fits = np.flatnonzero((p[a:b] < p[k]) & (np.abs(shift[a:b] - shift[k]) <= drift))
        if len(fits):
            longest = length[a:b][fits]
            at = a + fits[len(fits) - 1 - int(np.argmax(longest[::-1]))]
            before[k], length[k] = at, length[at] + 1
    used = np.zeros(len(own), bool)
    out: list[list[tuple[int, int]]] = []
    for k in np.lexsort((place, -length)).tolist():
        chain = []
        while k >= 0 and not used[k]:
            used[k] = True
            chain.append((int(place[k]), int(p[k])))
            k = int(before[k])
        if chain:
            out.append(chain[::-1])
    return sorted(out)


def scan_words(words: np.ndarray, known: Templates, coverage: float, band: int) -> list[tuple]:
    """Matches (template, first word, last word + 1, matched words) in a sequence of word hashes."""
    h = gram_hashes(words, known.gram)
    places = winnowed(h, known.window)
    at = np.searchsorted(known.hashes, h[places])
    at[at == len(known.hashes)] = 0
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for k in np.flatnonzero(known.hashes[at] == h[places]):
        for template, p in known.postings[at[k]]:
            hits[template].append((int(places[k]), p))
    found = []
    for template, own in hits.items():
        size = len(known.words[template])
        # Words put in or left out in the middle: up to a quarter of the template.
        drift = max(2, size // 4)
        groups = chains(own, drift, size)
        bounds = [(g[0][0] - g[0][1], g[-1][0] + size - g[-1][1]) for g in groups]
        # Chains over half a template or more may be notices of their own, which others leave to them.
        whole = [k for k, g in enumerate(groups) if 2 * (g[-1][1] + known.gram - g[0][1]) >= size]
        begins = [groups[k][0][0] for k in whole]
        for k, g in enumerate(groups):
            # The stretch that the chain points to, and not what its neighbours point to.
            low, high = max(0, bounds[k][0] - band), min(len(words), bounds[k][1] + band)
            after = bisect_right(begins, g[-1][0])
            if after < len(whole):
                high = min(high, max(bounds[whole[after]][0], g[-1][0] + known.gram))
            ahead = bisect_left(begins, g[0][0]) - 1
            if ahead >= 0 and groups[whole[ahead]][-1][0] < g[0][0]:
                low = max(low, min(bounds[whole[ahead]][1], g[0][0]))
            if in_common(known.bags[template], words[low:high]) < coverage * size:
                continue
            shifts = [place - p - low for place, p in g]
            middle = (min(shifts) + max(shifts)) // 2
            matched, first, last = align(known.words[template], words[low:high], middle, band + max(shifts) - middle)
            if matched >= coverage * size:
                found.append((template, low + first, low + last, matched))
    return apart(found)


def apart(found: list[tuple]) -> list[tuple]:
    """Of overlapping matches the longer one; equal ones by less text, then by template, then by place."""
    kept: list[tuple] = []
    starts: list[int] = []
    for m in sorted(found, key=lambda m: (-m[3], m[2] - m[1], m[0], m[1])):
        i = bisect_left(starts, m[1])
        # Those kept lie apart, so only the neighbours can meet this one.
        if (i == 0 or kept[i - 1][2] <= m[1]) and (i == len(kept) or kept[i][1] >= m[2]):
            starts.insert(i, m[1])
            kept.insert(i, m)
    return kept


def scan(
    docs: DataFrame,
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
    coverage: float = COVERAGE,
    gram: int = GRAM,
    window: int = WINDOW,
    band: int = BAND,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per matched notice; ``start`` and ``end`` are code points of the text."""
    texts_of = {k: tuple(v) for k, v in templates.items()}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(texts_of, gram, window)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            rows: list[tuple] = []
            for lo, hi in portions(texts):
                part = Batch(texts[lo:hi])
                start, end = word_spans(part)
                if not len(start):
                    continue
                words = part.hashes(start, end, fold=True)
                edge = np.searchsorted(start, part.off)
                # One look at all fingerprints tells which texts are worth a scan.
                h = gram_hashes(words, gram)
                near = np.searchsorted(known.hashes, h)
                near[near == len(known.hashes)] = 0
                hit = np.flatnonzero(known.hashes[near] == h)
                for i in np.unique(np.searchsorted(edge, hit, side="right") - 1):
                    a, b = edge[i], edge[i + 1]
                    for t, first, last, matched in scan_words(words[a:b], known, coverage, band):
                        x, y = int(start[a + first] - part.off[i]), int(end[a + last - 1] - part.off[i])
                        size = len(known.words[t])
                        rows.append((ids[lo + i], known.names[t], known.numbers[t], x, y, matched, size, matched / size, texts[lo + i][x:y]))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], SCHEMA_NAMES)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(search, SCHEMA)


SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def op6(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
