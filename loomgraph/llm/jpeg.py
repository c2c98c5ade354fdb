"""Progressive JPEG in numpy: coefficients to files and back, many images at once.

Both directions work on all images of a batch together. Entropy-coded data is
a set of segments, one per restart interval; the reader advances all segments
in step, one symbol each, so that the work per symbol is that of an array
operation. Scans select a band of the spectrum (Ss to Se) and approximate it
successively (Ah to Al); the reader accumulates them into one coefficient
array, which a product with the two-dimensional cosine basis turns into
samples.

The reader takes 8-bit progressive files with Huffman coding and one or three
components, chroma at full or half resolution. The basis is scaled to whole
numbers and all sums are exact, so the samples of a file do not depend on the
batch or on the machine.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache, lru_cache

import numpy as np

from .textvec import flat_ranges

#: Place of each coefficient of the zigzag order in an 8 x 8 block.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
SOI, EOI, SOS, DQT, DHT, SOF2, DRI, COM = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xC2, 0xDD, 0xFE
#: Components of a scan, first and last coefficient, bits of the approximation before and after.
SCRIPT = (
    ((0, 1, 2), 0, 0, 0, 1),
    ((0,), 1, 5, 0, 1),
    ((1,), 1, 63, 0, 1),
    ((2,), 1, 63, 0, 1),
    ((0,), 6, 63, 0, 1),
    ((0, 1, 2), 0, 0, 1, 0),
    ((0,), 1, 63, 1, 0),
    ((1,), 1, 63, 1, 0),
    ((2,), 1, 63, 1, 0),
)
RESTART_BLOCKS, RESTART_MCUS = 4, 4  # short, since segments are read side by side
SCALE = 12


def dc_lengths() -> dict[int, int]:
    return dict.fromkeys(range(12), 4)


def ac_lengths() -> dict[int, int]:
    """Code lengths by rule: short for coefficients without a run before them, longer with the run."""
    out = {}
    for run in range(16):
        for size in range(11):
            if size == 0:
                out[run << 4] = 5 if run == 0 else 10 if run == 15 else 9
            elif run == 0:
                out[size] = 3 if 2 <= size <= 4 else 4 if size <= 7 else 8
            else:
                out[run << 4 | size] = 7 if run == 1 and size <= 7 else 12
    return out


def huffman_segment(lengths: dict[int, int]) -> tuple[bytes, bytes]:
    """Counts of codes by length and symbols in order of their codes."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    return bytes(sum(v == n for v in lengths.values()) for n in range(1, 17)), bytes(order)


def canonical(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a table."""
    out, code, k = [], 0, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            out.append((symbols[k], code, n))
            code += 1
            k += 1
        code <<= 1
    return out


@cache
def lookup(counts: bytes, symbols: bytes, dc: bool) -> np.ndarray:
    """For each 16 bits ahead: code length, size, run and number of further bits, packed; 0 where there is no code."""
    table = np.zeros(1 << 16, np.int64)
    for symbol, code, n in canonical(counts, symbols):
        run, size = (0, symbol) if dc else (symbol >> 4, symbol & 15)
        extra = size if size or dc else run if run < 15 else 0
        table[code << 16 - n : (code + 1) << 16 - n] = n | size << 5 | run << 9 | extra << 13
    return table


@cache
def codes(dc: bool) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each symbol of the writer's tables."""
    code, size = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for symbol, c, n in canonical(*huffman_segment(dc_lengths() if dc else ac_lengths())):
        code[symbol], size[symbol] = c, n
    return code, size


@dataclass
class Frame:
    """Geometry of an image: components are (horizontal, vertical) sampling, and where its blocks are in the batch."""

    width: int
    height: int
    sampling: tuple[tuple[int, int], ...]
    quant: list[np.ndarray] = field(default_factory=list)
    which: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.hmax, self.vmax = max(h for h, _ in self.sampling), max(v for _, v in self.sampling)
        self.cols, self.rows = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))

    def place(self, at: int) -> int:
        """Give the components their blocks from ``at`` on; the end."""
        self.first = []
        for h, v in self.sampling:
            self.first.append(at)
            at += self.cols * h * self.rows * v
        return at

    def order(self, parts: tuple[int, ...]) -> np.ndarray:
        """Blocks in the order of a scan of the given components."""
        return scan_order(self.width, self.height, self.sampling, parts) + self.first[0]

    def unit(self, parts: tuple[int, ...]) -> int:
        """Blocks per MCU of a scan."""
        return sum(self.sampling[c][0] * self.sampling[c][1] for c in parts) if len(parts) > 1 else 1


@lru_cache(4096)
def scan_order(width: int, height: int, sampling: tuple[tuple[int, int], ...], parts: tuple[int, ...]) -> np.ndarray:
    """Order of the blocks of a scan in an image whose blocks begin at 0."""
    f = Frame(width, height, sampling)
    f.place(0)
    if len(parts) > 1:
        mcu = np.arange(f.cols * f.rows)
        y, x = mcu // f.cols, mcu % f.cols
        one = []
        for c in parts:
            h, v = sampling[c]
            one += [f.first[c] + (y * v + j) * f.cols * h + x * h + i for j in range(v) for i in range(h)]
        return np.stack(one, axis=1).ravel()
    c = parts[0]
    h, v = sampling[c]
    wide = -(-(-(-width * h // f.hmax)) // 8)
    high = -(-(-(-height * v // f.vmax)) // 8)
    return (f.first[c] + np.arange(high)[:, None] * f.cols * h + np.arange(wide)).ravel()


# ---- writing


def pack_bits(value: np.ndarray, size: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of items, segment by segment, each filled with ones to whole bytes; ``first`` has each segment's first item and the end."""
    upto = np.concatenate([[0], np.cumsum(size)])
    bits = np.diff(upto[first])
    width = -(-bits // 8)
    at = np.concatenate([[0], np.cumsum(width)])
    out = np.zeros((int(at[-1]) >> 2) + 3, np.int64)
    place = upto[:-1] + np.repeat(at[:-1] * 8 - upto[first[:-1]], np.diff(first))
    fill = width * 8 - bits
    for p, v, n in ((place, value, size), (at[:-1] * 8 + bits, (1 << fill) - 1, fill)):
        if not len(p):
            continue
        lane = p >> 5
        wide = v.astype(np.uint64) << (64 - (p & 31) - n).clip(0, 63).astype(np.uint64)
        new = np.flatnonzero(np.concatenate([[True], lane[1:] != lane[:-1]]))
        out[lane[new]] += np.add.reduceat((wide >> np.uint64(32)).astype(np.int64), new)
        out[lane[new] + 1] += np.add.reduceat((wide & np.uint64(0xFFFFFFFF)).astype(np.int64), new)
    return np.frombuffer(out.astype(">u4").tobytes(), np.uint8)[: int(at[-1])], at


def stuffed(data: np.ndarray, at: np.ndarray, number: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Data with zeros after bytes of all ones and a restart marker after each segment but the last of its image."""
    full = data == 0xFF
    extra = np.zeros(len(data), np.int64)
    extra[full] = 1
    mark = np.where(last, 0, 2)
    upto = np.concatenate([[0], np.cumsum(extra)])
    segment = np.repeat(np.arange(len(at) - 1), np.diff(at))
    marks = np.concatenate([[0], np.cumsum(mark)])
    spot = np.arange(len(data)) + upto[:-1] + marks[segment]
    ends = at[1:] + upto[at[1:]] + marks[:-1]
    out = np.zeros(len(data) + int(upto[-1] + marks[-1]), np.uint8)
    out[spot] = data
    put = ends[~last]
    out[put], out[put + 1] = 0xFF, 0xD0 + number[~last] % 8
    return out, ends + mark


def dc_items(dc: np.ndarray, part: np.ndarray, first: np.ndarray, low: int, refine: bool) -> tuple[np.ndarray, np.ndarray]:
    value = dc.astype(np.int64) >> low
    if refine:
        return value & 1, np.ones(len(value), np.int64)
    begins = np.zeros(len(value), np.int64)
    begins[first[:-1]] = 1
    segment = np.cumsum(begins)
    diff = value.copy()
    for c in np.unique(part):
        own = np.flatnonzero(part == c)
        same = np.concatenate([[False], segment[own][1:] == segment[own][:-1]])
        diff[own[same]] -= value[own[np.flatnonzero(same) - 1]]
    size = bit_length(np.abs(diff))
    code, length = codes(True)
    bits = np.where(diff < 0, diff + (1 << size) - 1, diff)
    return code[size] << size | bits, length[size] + size


def bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def ac_items(band: np.ndarray, first: np.ndarray, low: int, refine: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items of an AC scan, and the first item of each segment; ``first`` counts blocks."""
    blocks, width = band.shape
    code, length = codes(False)
    mag = np.abs(band.astype(np.int64)) >> low
    known = mag > 1 if refine else np.zeros_like(band, bool)
    new = mag == 1 if refine else mag > 0
    flat = np.flatnonzero(new)
    block, pos = flat // width, flat % width
    count = np.bincount(block, minlength=blocks)
    # zeros without history before each coefficient of its block
    zeros = np.cumsum(~(known | new), axis=1)
    before = zeros.ravel()[flat]
    head = np.concatenate([[True], block[1:] != block[:-1]]) if len(flat) else np.zeros(0, bool)
    run = np.where(head, before, before - np.concatenate([[0], before[:-1]])) if len(flat) else before
    skips = run >> 4
    values = mag.ravel()[flat]
    positive = band.ravel()[flat] > 0
    if refine:
        size, bits = np.ones(len(flat), np.int64), positive.astype(np.int64)
        symbol = (run & 15) << 4 | 1
    else:
        size = bit_length(values)
        bits = np.where(positive, values, (1 << size) - 1 - values)
        symbol = (run & 15) << 4 | size
    # A block that does not end with a new coefficient ends in a run of such ends.
    final = np.full(blocks, -1)
    final[block] = pos
    ends = final < width - 1
    fresh = np.zeros(blocks, bool)
    fresh[first[:-1]] = True
    fresh[1:] |= ~ends[:-1]
    fresh |= count > 0
    start = ends & fresh
    own = np.bincount(block, weights=1 + skips, minlength=blocks).astype(np.int64)
    tails = np.concatenate([[0], np.cumsum(start)])
    upto = np.concatenate([[0], np.cumsum(own)])
    total = int(upto[-1] + tails[-1])
    value, bitsize = np.full(total, code[0xF0]), np.full(total, length[0xF0])
    at = np.cumsum(1 + skips) - 1 + tails[block]
    value[at], bitsize[at] = code[symbol] << size | bits, length[symbol] + size
    begin = np.flatnonzero(start)
    if len(begin):
        # A run reaches to the block before the next start, or to the first block that has no such end.
        stop = np.concatenate([begin[1:], [blocks]])
        broken = np.concatenate([[0], np.cumsum(~ends)])
        clear = np.searchsorted(broken, broken[begin] + 1, side="left") - 1
        long = np.minimum(stop, clear) - begin
        power = bit_length(long) - 1
        spot = upto[begin + 1] + tails[begin]
        value[spot], bitsize[spot] = code[power << 4] << power | long - (1 << power), length[power << 4] + power
    seg = upto[first] + tails[first]
    if not refine:
        return value, bitsize, seg
    # Correction bits follow the code that passes their coefficient.
    old = np.flatnonzero(known)
    oblock, opos = old // width, old % width
    upto_new = np.concatenate([[0], np.cumsum(count)])
    rank = np.concatenate([[0], np.cumsum(new.ravel())])[old]  # new coefficients before, in all blocks
    inside = rank < upto_new[oblock + 1]
    owner = np.empty(len(old), np.int64)
    j = rank[inside]
    passed = zeros.ravel()[old[inside]] - np.where(j > upto_new[oblock[inside]], before[np.maximum(j - 1, 0)], 0)
    owner[inside] = at[j] - skips[j] + np.minimum(passed >> 4, skips[j])
    if len(begin):
        tail = np.searchsorted(begin, oblock[~inside], side="right") - 1
        owner[~inside] = spot[tail]
    shift = np.searchsorted(owner, np.arange(total))
    out_value, out_size = np.empty(total + len(old), np.int64), np.ones(total + len(old), np.int64)
    out_value[np.arange(total) + shift], out_size[np.arange(total) + shift] = value, bitsize
    out_value[owner + 1 + np.arange(len(old))] = mag.ravel()[old] & 1
    seg_old = np.searchsorted(oblock, first)
    return out_value, out_size, seg + seg_old


def segments_of(counts: list[int], step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First block of each segment and the end, number of each segment in its image, and whether it is its last."""
    firsts, numbers, lasts, at = [], [], [], 0
    for n in counts:
        f = np.arange(0, n, step)
        firsts.append(at + f)
        numbers.append(np.arange(len(f)))
        lasts.append(np.arange(len(f)) == len(f) - 1)
        at += n
    return np.concatenate([*firsts, [at]]), np.concatenate(numbers), np.concatenate(lasts)


def marker(kind: int, body: bytes) -> bytes:
    return bytes((0xFF, kind)) + (len(body) + 2).to_bytes(2, "big") + body


def encode(frames: list[Frame], coefs: np.ndarray, comments: list[bytes]) -> list[bytes]:
    """Files of images whose blocks are rows of ``coefs``, in zigzag order; all frames of one sampling."""
    tables = b"".join(bytes((kind,)) + b"".join(huffman_segment(t)) for kind, t in ((0x00, dc_lengths()), (0x10, ac_lengths())))
    heads = []
    for f, comment in zip(frames, comments, strict=True):
        body = b"\x08" + f.height.to_bytes(2, "big") + f.width.to_bytes(2, "big") + bytes((len(f.sampling),))
        body += b"".join(bytes((c + 1, h << 4 | v, 0)) for c, (h, v) in enumerate(f.sampling))
        heads.append(b"\xff\xd8" + marker(DQT, b"\0" + b"\x01" * 64) + marker(COM, comment) + marker(SOF2, body) + marker(DHT, tables))
    files = [[h] for h in heads]
    for parts, low_k, high_k, before, after in SCRIPT:
        orders = [f.order(parts) for f in frames]
        unit = frames[0].unit(parts)
        step = RESTART_MCUS * unit if len(parts) > 1 else RESTART_BLOCKS
        first, number, last = segments_of([len(o) for o in orders], step)
        order = np.concatenate(orders)
        if high_k == 0:
            each = np.concatenate([np.full(h * v, c) for c, (h, v) in enumerate(frames[0].sampling) if c in parts])
            part = np.tile(each, len(order) // len(each))
            value, size = dc_items(coefs[order, 0], part, first, after, before > 0)
            seg = first
        else:
            value, size, seg = ac_items(coefs[order, low_k : high_k + 1], first, after, before > 0)
        data, at = pack_bits(value, size, seg)
        data, ends = stuffed(data, at, number, last)
        raw, lo = data.tobytes(), 0
        body = bytes((len(parts),)) + b"".join(bytes((c + 1, 0)) for c in parts) + bytes((low_k, high_k, before << 4 | after))
        head = marker(DRI, (step // unit).to_bytes(2, "big")) + marker(SOS, body)
        for file, hi in zip(files, ends[last].tolist(), strict=True):
            file += (head, raw[lo:hi])
            lo = hi
    return [b"".join([*f, b"\xff\xd9"]) for f in files]


# ---- reading


@dataclass
class Scan:
    parts: tuple[int, ...]
    low: int
    high: int
    before: int
    after: int
    tables: tuple[np.ndarray, ...]
    restart: int
    start: int
    end: int


def parse(data: bytes, at: int = 0) -> tuple[Frame, list[Scan], bytes, int]:
    """Geometry, scans and comment of the file that begins at ``at``, and its end."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, frame, scans, comment, restart = at + 2, None, [], b"", 0
    quant: dict[int, np.ndarray] = {}
    tables: dict[int, np.ndarray] = {}
    names: list[int] = []
    while True:
        if at + 2 > len(data) or data[at] != 0xFF:
            raise ValueError("a marker is missing")
        kind = data[at + 1]
        if kind == EOI:
            break
        if kind == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == DQT:
            while body:
                wide = 2 if body[0] >> 4 else 1
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int64)
                body = body[1 + 64 * wide :]
        elif kind == DHT:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = lookup(body[1:17], body[17 : 17 + n], body[0] < 16)
                body = body[17 + n :]
        elif kind == COM:
            comment = body
        elif kind == DRI:
            restart = int.from_bytes(body, "big")
        elif kind == SOF2:
            if body[0] != 8 or body[5] not in (1, 3):
                raise ValueError("only 8-bit files of one or three components are read")
            given = [body[6 + 3 * i : 9 + 3 * i] for i in range(body[5])]
            names = [g[0] for g in given]
            frame = Frame(int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), tuple((g[1] >> 4, g[1] & 15) for g in given))
            if any(frame.hmax % h or frame.vmax % v for h, v in frame.sampling):
                raise ValueError("components must divide the sampling of the largest")
            frame.which = [g[2] for g in given]
        elif kind in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("only progressive files with Huffman codes are read")
        elif kind == SOS:
            n = body[0]
            parts = tuple(names.index(body[1 + 2 * i]) for i in range(n))
            low, high, bits = body[1 + 2 * n : 4 + 2 * n]
            own = [body[2 + 2 * i] for i in range(n)]
            ids = [o >> 4 for o in own] if high == 0 else [16 | o & 15 for o in own]
            end = at
            while True:
                end = data.index(b"\xff", end)
                if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                    end += 2
                    continue
                break
            need = bits >> 4 == 0 or high > 0
            scans.append(Scan(parts, low, high, bits >> 4, bits & 15, tuple(tables[i] for i in ids) if need else (), restart, at, end))
            at = end
    if frame is None:
        raise ValueError("the file has no frame")
    frame.quant = [quant[q] for q in frame.which]
    return frame, scans, comment, at + 2


class Bits:
    """Unstuffed data of a scan of several files: where each segment begins, and 64 bits from any byte on."""

    def __init__(self, regions: list[bytes]) -> None:
        raw = np.frombuffer(b"".join(regions), np.uint8)
        keep = np.ones(len(raw), bool)
        full = np.flatnonzero(raw[:-1] == 0xFF) if len(raw) > 1 else np.zeros(0, np.int64)
        follows = raw[full + 1]
        keep[full[follows == 0] + 1] = False
        restart = full[(follows >= 0xD0) & (follows <= 0xD7)]
        keep[restart] = keep[restart + 1] = False
        region = np.concatenate([[0], np.cumsum([len(r) for r in regions])])
        begin = np.sort(np.concatenate([region[:-1], restart + 2]))
        self.counts = np.diff(np.searchsorted(begin, region))  # segments of each region
        index = np.concatenate([[0], np.cumsum(keep)])
        self.pos = index[begin] * 8
        data = np.concatenate([raw[keep], np.zeros(16, np.uint8)])
        n = len(data) - 8
        window = np.zeros(n, np.uint64)
        for j in range(8):
            window |= data[j : j + n].astype(np.uint64) << np.uint64(56 - 8 * j)
        self.data, self.window = data, window

    def ahead(self, pos: np.ndarray) -> np.ndarray:
        return self.window[np.minimum(pos >> 3, len(self.window) - 1)] << (pos & 7).astype(np.uint64)

    def single(self, pos: np.ndarray) -> np.ndarray:
        return (self.data[np.minimum(pos >> 3, len(self.data) - 1)] >> (7 - (pos & 7)).astype(np.uint8)) & 1


def signed(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << size >> 1), bits - (1 << size) + 1, bits)


def take_symbol(bits: Bits, pos: np.ndarray, tables: np.ndarray, table: np.ndarray):
    ahead = bits.ahead(pos)
    packed = tables[table + (ahead >> np.uint64(48)).astype(np.int64)]
    length = packed & 31
    if not length.all():
        raise ValueError("the data has no such code")
    extra = packed >> 13
    more = ((ahead << length.astype(np.uint64)) >> np.uint64(1) >> (63 - extra).astype(np.uint64)).astype(np.int64)
    return packed >> 5 & 15, packed >> 9 & 15, more, length + extra


def read_dc(bits, coefs, order, first, tables, table, part, after):
    """``table`` holds the offset of the code table for each block."""
    seg = np.arange(len(first) - 1)
    b, pos = first[:-1].copy(), bits.pos.copy()
    diff = np.zeros(len(order), np.int64)
    while len(seg):
        size, _, more, used = take_symbol(bits, pos, tables, table[b])
        diff[b] = signed(more, size)
        pos, b = pos + used, b + 1
        go = b < first[seg + 1]
        if not go.all():
            seg, b, pos = seg[go], b[go], pos[go]
    segment = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for c in np.unique(part):
        own = np.flatnonzero(part == c)
        total = np.cumsum(diff[own])
        head = np.flatnonzero(np.concatenate([[True], segment[own][1:] != segment[own][:-1]]))
        base = (total - diff[own])[head]
        coefs[order[own], 0] = (total - np.repeat(base, np.diff(np.concatenate([head, [len(own)]])))) << after


def refine_dc(bits, coefs, order, first, after):
    place = np.repeat(bits.pos - first[:-1], np.diff(first)) + np.arange(len(order))
    coefs[order, 0] |= (bits.single(place).astype(coefs.dtype)) << after


def read_ac(bits, coefs, order, first, tables, table, low, high, after):
    flat = coefs.reshape(-1)
    seg = np.arange(len(first) - 1)
    b, pos, stop = first[:-1].copy(), bits.pos.copy(), first[1:].copy()
    k = np.full(len(seg), low)
    while len(seg):
        size, run, more, used = take_symbol(bits, pos, tables, table)
        pos = pos + used
        at = k + run
        put = size > 0
        if put.all():
            if at.max() > 63:
                raise ValueError("a run leaves its block")
            flat[order[b] * 64 + at] = signed(more, size) << after
            k = at + 1
        else:
            w = np.flatnonzero(put)
            if len(w) and at[w].max() > 63:
                raise ValueError("a run leaves its block")
            flat[order[b[w]] * 64 + at[w]] = signed(more[w], size[w]) << after
            end = ~put & (run < 15)
            k = np.where(end, low, at + 1)
            b = b + np.where(end, (1 << run) + more, 0)
        over = k > high
        if over.any():
            b, k = b + over, np.where(over, low, k)
        go = b < stop
        if not go.all():
            seg, b, pos, k, stop, table = seg[go], b[go], pos[go], k[go], stop[go], table[go]


def refine_ac(bits, coefs, order, first, tables, table, low, high, after):
    band = coefs[order, low : high + 1]
    n, width = band.shape
    old = band != 0
    zero = ~old
    passed = np.zeros((n, width + 1), np.int64)
    np.cumsum(zero, axis=1, out=passed[:, 1:])
    # Place of the j-th zero of each block; past the band where there are fewer.
    place = np.full((n, width + 17), width)
    where = np.flatnonzero(zero)
    place[where // width, passed[where // width, where % width]] = where % width
    known = np.flatnonzero(old)
    known_first = np.concatenate([[0], np.cumsum(old.sum(axis=1))])
    events: list[tuple] = []
    puts: list[tuple] = []
    seg = np.arange(len(first) - 1)
    b, pos, stop = first[:-1].copy(), bits.pos.copy(), first[1:].copy()
    k, ends = np.zeros(len(seg), np.int64), np.zeros(len(seg), np.int64)
    while len(seg):
        rest = ends > 0
        size, run = np.zeros(len(seg), np.int64), np.zeros(len(seg), np.int64)
        new = np.zeros(len(seg), np.int64)
        w = np.flatnonzero(~rest)
        if len(w):
            s, r, more, used = take_symbol(bits, pos[w], tables, table[w])
            # A size of one has a sign bit, which the table counted as a further bit.
            pos[w] += used
            size[w], run[w], new[w] = s, r, more
            end = (s == 0) & (r < 15)
            ends[w[end]] = (1 << r[end]) + more[end]
            rest = ends > 0
        ranked = np.minimum(passed[b, k] + run, width + 16)
        target = np.where(rest, width, place[b, ranked])
        fixes = (target - k) - (passed[b, target] - passed[b, k])
        events.append((known_first[b] + k - passed[b, k], fixes, pos.copy()))
        pos = pos + fixes
        put = size > 0
        if put.any():
            if (target[put] >= width).any():
                raise ValueError("a run leaves its block")
            puts.append((order[b[put]] * 64 + low + target[put], np.where(new[put] > 0, 1, -1) << after))
        k = target + 1
        ends = ends - rest
        over = rest | (k >= width)
        b, k = b + over, np.where(over, 0, k)
        go = b < stop
        if not go.all():
            seg, b, pos, k, ends, stop, table = seg[go], b[go], pos[go], k[go], ends[go], stop[go], table[go]
    flat = coefs.reshape(-1)
    if events:
        start, count, at = (np.concatenate([e[i] for e in events]) for i in range(3))
        some = count > 0
        which = known[flat_ranges(start[some], count[some])]
        bit = bits.single(flat_ranges(at[some], count[some]))
        spot = order[which // width] * 64 + low + which % width
        value = flat[spot]
        flat[spot] = value + np.where(bit == 1, np.where(value > 0, 1, -1) << after, 0).astype(flat.dtype)
    for spot, value in puts:
        flat[spot] = value


def decode(files: list[bytes]) -> tuple[list[Frame], np.ndarray, list[bytes], list[int]]:
    """Frames, coefficients (rows of blocks in zigzag order, not yet multiplied) and comments of files.

    Several files may stand one after the other in one value; the last list
    tells which value each frame comes from.
    """
    parsed, data, owner = [], [], []
    for i, value in enumerate(files):
        at = 0
        while at < len(value) or at == 0:
            parsed.append(parse(value, at))
            data.append(value)
            owner.append(i)
            at = parsed[-1][3]
    files = data
    total = 0
    for frame, *_ in parsed:
        total = frame.place(total)
    coefs = np.zeros((total, 64), np.int32)
    groups: dict[tuple, list[int]] = {}
    for i, (frame, scans, *_) in enumerate(parsed):
        groups.setdefault((frame.sampling, tuple((s.parts, s.low, s.high, s.before, s.after) for s in scans)), []).append(i)
    for (_, script), members in groups.items():
        for n, (parts, low, high, before, after) in enumerate(script):
            scans = [parsed[i][1][n] for i in members]
            frames = [parsed[i][0] for i in members]
            bits = Bits([files[i][s.start : s.end] for i, s in zip(members, scans, strict=True)])
            orders = [f.order(parts) for f in frames]
            unit = frames[0].unit(parts)
            firsts, at = [], 0
            for o, s, own in zip(orders, scans, bits.counts, strict=True):
                f = np.arange(0, len(o), s.restart * unit) if s.restart else np.zeros(1, np.int64)
                if len(f) != own:
                    raise ValueError("restart markers are missing")
                firsts.append(at + f)
                at += len(o)
            first, order = np.concatenate([*firsts, [at]]), np.concatenate(orders)
            # One stack of the distinct tables of these scans.
            stack: dict[int, int] = {}
            for s in scans:
                for t in s.tables:
                    stack.setdefault(id(t), len(stack))
            distinct = {id(t): t for s in scans for t in s.tables}
            tables = np.concatenate([distinct[i] for i in stack]) if stack else np.zeros(0, np.int64)
            if high == 0:
                each = np.concatenate([np.full(frames[0].sampling[c][0] * frames[0].sampling[c][1] if len(parts) > 1 else 1, j) for j, c in enumerate(parts)])
                part = np.tile(each, len(order) // len(each))
                if before:
                    refine_dc(bits, coefs, order, first, after)
                else:
                    table = np.concatenate([np.array([stack[id(t)] << 16 for t in s.tables])[np.tile(each, len(o) // len(each))] for s, o in zip(scans, orders, strict=True)])
                    read_dc(bits, coefs, order, first, tables, table, part, after)
            else:
                table = np.repeat([stack[id(s.tables[0])] << 16 for s in scans], bits.counts)
                (refine_ac if before else read_ac)(bits, coefs, order, first, tables, table, low, high, after)
    return [p[0] for p in parsed], coefs, [p[2] for p in parsed], owner


@cache
def basis() -> np.ndarray:
    """Samples of a block from its zigzag coefficients, scaled to whole numbers."""
    x, u = np.arange(8)[None, :], np.arange(8)[:, None]
    one = np.where(u == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)
    whole = np.rint(one * (1 << SCALE))
    return np.kron(whole, whole)[ZIGZAG].astype(np.float64)


def samples(frame: Frame, coefs: np.ndarray) -> list[np.ndarray]:
    """Planes of the components, cut to their size."""
    planes = []
    for c, (h, v) in enumerate(frame.sampling):
        wide, high = frame.cols * h, frame.rows * v
        own = coefs[frame.first[c] : frame.first[c] + wide * high] * frame.quant[c]
        half = float(1 << 2 * SCALE - 1)
        value = np.floor((own.astype(np.float64) @ basis() + half) / (2 * half)) + 128
        plane = np.clip(value, 0, 255).astype(np.uint8).reshape(high, wide, 8, 8).swapaxes(1, 2).reshape(high * 8, wide * 8)
        planes.append(plane[: -(-frame.height * v // frame.vmax), : -(-frame.width * h // frame.hmax)])
    return planes


def rgb(frame: Frame, coefs: np.ndarray) -> np.ndarray:
    """Tensor of height x width x 3: chroma repeated to full resolution, then converted with 16-bit fixed-point factors."""
    full = []
    for plane, (h, v) in zip(samples(frame, coefs), frame.sampling, strict=True):
        full.append(plane.repeat(frame.vmax // v, axis=0).repeat(frame.hmax // h, axis=1)[: frame.height, : frame.width])
    if len(full) == 1:
        return np.repeat(full[0][:, :, None], 3, axis=2)
    y, cb, cr = full[0].astype(np.int32), full[1].astype(np.int32) - 128, full[2].astype(np.int32) - 128
    half = 1 << 15
    out = np.empty((*y.shape, 3), np.uint8)
    out[..., 0] = np.clip(y + (91881 * cr + half >> 16), 0, 255)
    out[..., 1] = np.clip(y - (22554 * cb + 46802 * cr + half >> 16), 0, 255)
    out[..., 2] = np.clip(y + (116130 * cb + half >> 16), 0, 255)
    return out
