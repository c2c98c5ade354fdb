"""Byte-level BPE ids for batches of texts.

Texts are split into the tokenizer's pre-tokens by array operations, each
distinct pre-token is encoded once with the public vocabulary, and the ids are
gathered for the whole batch. The operators take the ids of the tokenizer file
as it is loaded: its added tokens are found in the text first and have their
own ids. Without ``added`` the same strings count as ordinary text.
``tests/llm`` holds both against the tokenizers library.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from functools import cache

import numpy as np
import regex

from .textvec import LETTER, NUMBER, OTHER, SPACE, Batch, classes, flat_ranges

MOST_CACHED = 400_000
SEGMENT = 1 << 20


def vocabulary(name: str = "byte_bpe_50k") -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json")


@cache
def encoder(path: str, added: bool = False) -> BatchEncoder:
    return BatchEncoder(path, added)


def pretoken_starts(batch: Batch, added: list[tuple[int, int]] = ()) -> np.ndarray:
    """Where the pre-tokens of each text begin.

    A pre-token is a contraction, or a run of letters, of digits or of other
    characters with at most one blank before it, or white space, of which the
    last character stands alone where a run of another kind follows. Spans of
    ``added`` tokens are pre-tokens of their own; the text ends before them.
    """
    cp = batch.cp
    if not len(cp):
        return np.zeros(0, np.int64)
    kind = classes()[cp]
    begins = batch.starts_of_texts()
    if len(added):
        edges = np.array(added, np.int64)
        begins[edges[edges < len(cp)]] = True
    start = begins.copy()
    start[1:] |= kind[1:] != kind[:-1]
    ends_text = np.concatenate([begins[1:], [True]])
    tail = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~ends_text[:-1]) if len(cp) > 1 else np.zeros(0, np.int64)
    start[tail] = True
    start[tail[cp[tail] == 0x20] + 1] = False
    quote = np.flatnonzero((cp == 0x27) & start)
    if len(quote):
        padded = np.concatenate([cp, np.zeros(3, np.uint32)])
        closed = np.concatenate([begins, np.ones(3, bool)])
        a, b = padded[quote + 1], padded[quote + 2]
        one = np.isin(a, [ord(c) for c in "stmd"]) & ~closed[quote + 1]
        two = np.zeros(len(quote), bool)
        for pair in ("re", "ve", "ll"):
            two |= (a == ord(pair[0])) & (b == ord(pair[1])) & ~closed[quote + 1] & ~closed[quote + 2]
        for at, size in ((quote[one], 1), (quote[two & ~one], 2)):
            start[at + 1] = False
            nxt = at + 1 + size
            start[nxt[nxt < len(cp)]] = True
    for a, b in added:
        start[a + 1 : b] = False
    return np.flatnonzero(start)


class BatchEncoder:
    def __init__(self, path: str, added: bool = False) -> None:
        import json

        import tiktoken

        # The same vocabulary as ranks stands beside the tokenizer file.
        ranks_file = path.removesuffix(".json") + ".tiktoken"
        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError(f"{path} is not a byte-level BPE")
        self.bpe = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.added: dict[str, int] = {}
        for token in spec.get("added_tokens") or () if added else ():
            if token["normalized"] and spec.get("normalizer") or any(token[k] for k in ("single_word", "lstrip", "rstrip")):
                raise ValueError(f"{path} has an added token that is not matched as it stands")
            self.added[token["content"]] = token["id"]
        # Of tokens that begin at one place the longest is taken.
        self.matcher = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.width = np.zeros(max(*ranks.values(), *self.added.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.width[rank] = len(token)
        for token, i in self.added.items():
            self.width[i] = len(token.encode())
        self.clear()

    def clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.known: list[np.ndarray] = []
        self.first = np.zeros(1, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _grow(self, new: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        self.size = np.concatenate([self.size, sizes])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, np.fromiter((i for ids in new for i in ids), np.int32, int(sizes.sum()))])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin (one more at the end)."""
        ids, off, _ = self._encode(texts)
        return ids, off

    def _added_spans(self, batch: Batch, texts: list[str]) -> list[tuple[int, int]]:
        if not any(t in batch.text for t in self.added):
            return []
        return [(at + m.start(), at + m.end()) for at, t in zip(batch.off.tolist(), texts, strict=False) for m in self.matcher.finditer(t)]

    def segments(self, text: str, limit: int = SEGMENT) -> list[str]:
        """``segments`` of a text, none of which ends inside an added token."""
        return segments(text, limit, self.matcher)

    def _encode(self, texts: list[str]):
        batch = Batch(texts)
        start = pretoken_starts(batch, self._added_spans(batch, texts))
        end = np.concatenate([start[1:], [len(batch.cp)]]).astype(np.int64)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64), (batch, start, end, None)
        if len(self.slot) > MOST_CACHED:
            self.clear()
        seen, at, back = np.unique(batch.hashes(start, end), return_index=True, return_inverse=True)
        keys = seen.tolist()
        slots = [self.slot.get(k, -1) for k in keys]
        missing = [i for i, s in enumerate(slots) if s < 0]
        if missing:
            text, lo, hi = batch.text, start[at].tolist(), end[at].tolist()
            encode = self.bpe._encode_single_piece
            pieces = [text[lo[i] : hi[i]] for i in missing]
            # No pre-token beside the spans of added tokens reads like one.
            self._grow([[self.added[p]] if p in self.added else encode(p.encode("utf-8", "replace")) for p in pieces])
            n = len(self.slot)
            for k, i in enumerate(missing):
                slots[i] = self.slot[keys[i]] = n + k
        word = np.array(slots, np.int64)[back]
        sizes = self.size[word]
        ids = self.ids[flat_ranges(self.first[word], sizes)]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return ids, upto[np.searchsorted(start, batch.off)], (batch, start, end, sizes)

    def encode_spans(self, texts: list[str]):
        """Ids as by ``encode``, with the span of characters that each covers.

        A token that holds part of a character's bytes covers that character.
        Positions count code points from the start of the text.
        """
        ids, off, (batch, start, end, sizes) = self._encode(texts)
        if sizes is None:
            none = np.zeros(0, np.int64)
            return ids, none, none, off
        # Byte position of each code point, and the code point of each byte.
        wide = 1 + (batch.cp > 0x7F).astype(np.int64) + (batch.cp > 0x7FF) + (batch.cp > 0xFFFF)
        owner = np.repeat(np.arange(len(batch.cp)), wide)
        last = np.cumsum(self.width[ids])
        a, b = owner[last - self.width[ids]], owner[last - 1] + 1
        shift = np.repeat(batch.off[:-1], np.diff(off))
        return ids, a - shift, b - shift, off


_BREAK = regex.compile(r"(?<=\S)(?= [^\s])")


def segments(text: str, limit: int = SEGMENT, added: regex.Pattern | None = None) -> list[str]:
    """Cut a very long text where a pre-token surely begins, so that memory stays bounded."""
    if len(text) <= limit:
        return [text]
    out, at = [], 0
    whole = [m.span() for m in added.finditer(text)] if added else []
    while len(text) - at > limit:
        m = _BREAK.search(text, at + limit)
        while m and (k := bisect_left(whole, (m.start(),))) and whole[k - 1][1] > m.start():
            m = _BREAK.search(text, m.start() + 1)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


__all__ = ["BatchEncoder", "LETTER", "NUMBER", "OTHER", "encoder", "pretoken_starts", "segments", "vocabulary"]
