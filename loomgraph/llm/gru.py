"""A bidirectional gated recurrent network with attention pooling, in numpy.

Inputs are words. A word's vector is the sum of a hashed embedding of the word
and of hashed embeddings of the character n-grams in it. Windows of words run
through one GRU in each direction; attention pools their states and gives one
logit per window. The logit of a text is the smooth maximum over its windows,
and the network is trained on texts through it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .textvec import BASE, Batch, flat_ranges, mixed, powers, word_spans

WORD_BITS, CHAR_BITS = 14, 15
GRAMS = (3, 5)
SIZE, HIDDEN, ATTEND = 16, 8, 8
WINDOW, STRIDE = 32, 16
SHARP = 4.0  # of the smooth maximum
NAMES = ("wf", "wb", "bf", "bb", "uf", "ub", "wa", "ba", "va", "wo", "bo")


@dataclass
class Words:
    """The words of a batch of texts by type: hashed inputs of each type and windows of type numbers."""

    word: np.ndarray  # row of the word table for each type
    gram: np.ndarray  # rows of the n-gram table, type after type
    gram_off: np.ndarray
    ids: np.ndarray  # (windows, WINDOW) type numbers, -1 where a window is shorter
    window_off: np.ndarray  # first window of each text, one more at the end


def prepare(texts: list[str]) -> Words:
    batch = Batch(texts)
    start, end = word_spans(batch)
    counts = batch.counts(start)
    n = len(start)
    if n:
        _, at, back = np.unique(batch.hashes(start, end, fold=True), return_index=True, return_inverse=True)
        lo, hi = start[at], end[at]
        word = (batch.hashes(lo, hi, fold=True) & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
        # Each type's lower-case characters between two marks.
        from .textvec import lower_table

        size = hi - lo
        off = np.concatenate([[0], np.cumsum(size + 2)])
        chars = np.full(int(off[-1]), 2, np.uint64)
        chars[off[:-1]] = 1
        chars[flat_ranges(off[:-1] + 1, size)] = lower_table()[batch.cp[flat_ranges(lo, size)]]
        owner = np.repeat(np.arange(len(lo)), size + 2)
        parts, owners = [], []
        weight = powers(BASE, max(GRAMS) + 1)
        for g in GRAMS:
            if len(chars) < g:
                continue
            whole = owner[: len(chars) - g + 1] == owner[g - 1 :]
            h = np.full(len(whole), np.uint64(g))
            for k in range(g):
                h += chars[k : k + len(whole)] * weight[k + 1]
            parts.append((mixed(h[whole]) & np.uint64((1 << CHAR_BITS) - 1)).astype(np.int64))
            owners.append(owner[: len(whole)][whole])
        gram, owners = np.concatenate(parts), np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        gram, gram_off = gram[order], np.searchsorted(owners[order], np.arange(len(lo) + 1))
    else:
        back = word = gram = np.zeros(0, np.int64)
        gram_off = np.zeros(1, np.int64)
    windows = np.where(counts > 0, np.maximum(0, -(-(counts - WINDOW) // STRIDE)) + 1, 0)
    window_off = np.concatenate([[0], np.cumsum(windows)])
    first = np.concatenate([[0], np.cumsum(counts)])
    begin = flat_ranges(np.zeros(len(texts), np.int64), windows) * STRIDE + np.repeat(first[:-1], windows)
    places = begin[:, None] + np.arange(WINDOW)
    inside = places < np.repeat(first[1:], windows)[:, None]
    ids = np.where(inside, back[np.minimum(places, max(0, n - 1))] if n else places, -1)
    return Words(word, gram, gram_off, ids, window_off)


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def segment_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    out = np.zeros((len(off) - 1, values.shape[1]), values.dtype)
    full = np.diff(off) > 0
    if full.any():
        out[full] = np.add.reduceat(values, off[:-1][full], axis=0)
    return out


class Network:
    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        # Zero, so that what training never met says nothing.
        self.words = np.zeros((1 << WORD_BITS, SIZE), np.float32)
        self.grams = np.zeros((1 << CHAR_BITS, SIZE), np.float32)
        self.p = {"wf": draw(SIZE, 3 * HIDDEN), "wb": draw(SIZE, 3 * HIDDEN), "uf": draw(HIDDEN, 3 * HIDDEN), "ub": draw(HIDDEN, 3 * HIDDEN)}
        self.p |= {"bf": np.zeros(3 * HIDDEN, np.float32), "bb": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"wa": draw(2 * HIDDEN, ATTEND), "ba": np.zeros(ATTEND, np.float32), "va": draw(ATTEND, 1)[:, 0], "wo": draw(2 * HIDDEN, 1)[:, 0], "bo": np.full(1, -1, np.float32)}

    def vectors(self, words: Words, keep: np.ndarray | None = None) -> np.ndarray:
        count = np.maximum(1, np.diff(words.gram_off))[:, None]
        own = self.words[words.word]
        if keep is not None:
            own = own * keep
        return own + segment_sums(self.grams[words.gram], words.gram_off) / np.sqrt(count).astype(np.float32)

    def _run(self, table: np.ndarray, u: np.ndarray, ids: np.ndarray, mask: np.ndarray, back: bool, tape: list | None) -> np.ndarray:
        steps, width = ids.shape
        states = np.empty((steps, width, HIDDEN), np.float32)
        h = np.zeros((width, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1) if back else range(steps):
            x, hu = table[ids[t]], h @ u
            gates = sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            if not mask[t].all():
                new = np.where(mask[t][:, None], new, h)
            if tape is not None:
                tape.append((t, z, r, n, hu[:, 2 * HIDDEN :], h))
            h = states[t] = new
        return states

    def logits(self, words: Words, tape: dict | None = None, keep: np.ndarray | None = None) -> np.ndarray:
        """Logit of every window."""
        p = self.p
        x = self.vectors(words, keep)
        if not len(x):
            x = np.zeros((1, SIZE), np.float32)
        mask = (words.ids >= 0).T.copy()
        ids = np.maximum(words.ids, 0).T.copy()
        tapes = ([], []) if tape is not None else (None, None)
        hf = self._run(x @ p["wf"] + p["bf"], p["uf"], ids, mask, False, tapes[0])
        hb = self._run(x @ p["wb"] + p["bb"], p["ub"], ids, mask, True, tapes[1])
        h = np.concatenate([hf, hb], axis=2)
        a = np.tanh(h @ p["wa"] + p["ba"])
        e = np.where(mask, a @ p["va"], -1e9)
        e = np.exp(e - e.max(axis=0))
        e /= e.sum(axis=0)
        c = np.einsum("tb,tbh->bh", e, h)
        if tape is not None:
            tape |= {"x": x, "ids": ids, "mask": mask, "tapes": tapes, "h": h, "a": a, "e": e, "c": c}
        return c @ p["wo"] + p["bo"]

    def pooled(self, logits: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smooth maximum over the windows of each text, and each window's part in it."""
        n = len(off) - 1
        out = np.full(n, self.p["bo"][0], np.float64)
        if not len(logits):
            return out, np.zeros(0)
        full = np.diff(off) > 0
        top = np.maximum.reduceat(logits, off[:-1][full])
        weight = np.exp(SHARP * (logits - np.repeat(top, np.diff(off)[full])).astype(np.float64))
        total = np.add.reduceat(weight, off[:-1][full])
        out[full] = top + np.log(total) / SHARP
        return out, weight / np.repeat(total, np.diff(off)[full])

    def scores(self, texts: list[str], most: int = 8192) -> np.ndarray:
        """Score of each text from all its windows; the windows run some thousands at a time."""
        words = prepare(texts)
        parts = []
        for i in range(0, len(words.ids), most):
            chunk = words.ids[i : i + most]
            types, local = np.unique(chunk, return_inverse=True)
            local = local.reshape(chunk.shape)
            if types[0] < 0:
                types, local = types[1:], local - 1
            sizes = np.diff(words.gram_off)[types]
            some = Words(words.word[types], words.gram[flat_ranges(words.gram_off[types], sizes)], np.concatenate([[0], np.cumsum(sizes)]), local, words.window_off)
            parts.append(self.logits(some))
        z, _ = self.pooled(np.concatenate(parts) if parts else np.zeros(0, np.float32), words.window_off)
        return 1 / (1 + np.exp(-z))

    def gradients(self, words: Words, target: np.ndarray, weight: np.ndarray, keep: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray, float]:
        """Of the logistic loss: dense parameters, word rows and n-gram rows (per type)."""
        p, tape = self.p, {}
        logits = self.logits(words, tape, keep)
        z, part = self.pooled(logits, words.window_off)
        y = 1 / (1 + np.exp(-z))
        loss = float(np.mean(weight * (np.logaddexp(0, z) - target * z)))
        dz = weight * (y - target) / len(target)
        sizes = np.diff(words.window_off)
        d = (np.repeat(dz, sizes) * part).astype(np.float32)
        h, a, e, c, mask, ids = (tape[k] for k in ("h", "a", "e", "c", "mask", "ids"))
        g = {"wo": c.T @ d, "bo": np.array([d.sum() + dz[sizes == 0].sum()], np.float32)}
        dc = d[:, None] * p["wo"]
        de = np.einsum("bh,tbh->tb", dc, h)
        ds = e * (de - (e * de).sum(axis=0))
        ds[~mask] = 0
        dh = e[:, :, None] * dc
        g["va"] = np.einsum("tb,tba->a", ds, a)
        da = ds[:, :, None] * p["va"] * (1 - a * a)
        g["ba"] = da.sum(axis=(0, 1))
        g["wa"] = h.reshape(-1, 2 * HIDDEN).T @ da.reshape(-1, ATTEND)
        dh += da @ p["wa"].T
        x, dx = tape["x"], 0
        order = np.argsort(ids.ravel(), kind="stable")
        flat = ids.ravel()[order]
        edge = np.searchsorted(flat, np.arange(len(x) + 1))
        for side, tp, sl in (("f", tape["tapes"][0], slice(0, HIDDEN)), ("b", tape["tapes"][1], slice(HIDDEN, 2 * HIDDEN))):
            u, du = p["u" + side], np.zeros_like(p["u" + side])
            dp = np.zeros((*ids.shape, 3 * HIDDEN), np.float32)
            carry = np.zeros((ids.shape[1], HIDDEN), np.float32)
            for t, gz, gr, n, hun, before in reversed(tp):
                now = carry + dh[t][:, sl]
                m = mask[t][:, None]
                passed, now = np.where(m, 0, now), np.where(m, now, 0)
                dn = now * (1 - gz) * (1 - n * n)
                dzp = now * (before - n) * gz * (1 - gz)
                drp = dn * hun * gr * (1 - gr)
                dp[t] = np.concatenate([dzp, drp, dn], axis=1)
                dhu = np.concatenate([dzp, drp, dn * gr], axis=1)
                du += before.T @ dhu
                carry = now * gz + dhu @ u.T + passed
            dtype = segment_sums(dp.reshape(-1, 3 * HIDDEN)[order], edge)
            g["u" + side], g["w" + side], g["b" + side] = du, x.T @ dtype, dtype.sum(axis=0)
            dx = dx + dtype @ p["w" + side].T
        return g, dx * keep, dx / np.sqrt(np.maximum(1, np.diff(words.gram_off)))[:, None].astype(np.float32), loss


def rows_sum(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(index, kind="stable")
    index = index[order]
    first = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    return index[first], np.add.reduceat(values[order], first, axis=0)


def common_rows(texts: list[str], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of the word and of the n-gram table occur in at least ``least`` texts."""
    word, gram = np.zeros(1 << WORD_BITS, np.int64), np.zeros(1 << CHAR_BITS, np.int64)
    for t in texts:
        w = prepare([t])
        word[np.unique(w.word)] += 1
        gram[np.unique(w.gram)] += 1
    return word >= least, gram >= least


def train(
    texts: list[str],
    labels: np.ndarray,
    steps: int = 300,
    batch: int = 24,
    seed: int = 3,
    rate: float = 0.01,
    table_rate: float = 0.1,
    forget: float = 0.3,
    least: int = 3,
) -> Network:
    """Fit on labelled texts, both labels in equal number in each step; whole texts, all windows.

    Words and n-grams of fewer than ``least`` texts are not learned, and the
    word's own embedding is forgotten at random, so that the network does not
    know texts by their rare words.
    """
    net, rng = Network(seed), np.random.default_rng(seed)
    sides = [np.flatnonzero(labels == k) for k in (0, 1)]
    if not len(sides[0]) or not len(sides[1]):
        net.p["bo"][0] = 8 if len(sides[1]) else -8
        net.p["wo"][:] = 0
        return net
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(w) for k, w in net.p.items()}
    seen_w, seen_g = np.full(len(net.words), 1e-8, np.float32), np.full(len(net.grams), 1e-8, np.float32)
    word_ok, gram_ok = common_rows(texts, least)
    queues: list[list[int]] = [[], []]
    for step in range(1, steps + 1):
        chosen = []
        for side, queue in zip(sides, queues, strict=True):
            while len(queue) < batch // 2:
                queue.extend(rng.permutation(side).tolist())
            chosen += [queue.pop(0) for _ in range(batch // 2)]
        words = prepare([texts[i] for i in chosen])
        if not len(words.ids):
            continue
        keep = (rng.random((len(words.word), 1)) >= forget).astype(np.float32) / (1 - forget)
        g, dw, dg, _ = net.gradients(words, labels[chosen].astype(np.float64), np.ones(len(chosen)), keep)
        pace = rate * min(1, 2 * (1 - step / (steps + 1)))
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        for k, x in g.items():
            x = x * min(1, 5 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x * x
            net.p[k] -= (pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        tempo = table_rate * pace / rate
        known_w, known_g = word_ok[words.word], gram_ok[words.gram]
        owner = np.repeat(np.arange(len(dg)), np.diff(words.gram_off))[known_g]
        for table, seen, index, change in (
            (net.words, seen_w, words.word[known_w], dw[known_w]),
            (net.grams, seen_g, words.gram[known_g], dg[owner]),
        ):
            if not len(index):
                continue
            rows, d = rows_sum(index, change)
            seen[rows] += (d * d).mean(axis=1)
            table[rows] -= (tempo * d / np.sqrt(seen[rows])[:, None]).astype(np.float32)
    return net
