"""Self-join of documents on the Jaccard similarity of their word n-grams.

1. Each document becomes the set of its hashed five-word n-grams, of words in
   lower case between ASCII white space. Documents with equal sets are one
   text from here on. MinHash values of the sets are banded; with 25 bands of
   4 rows a pair of similarity 0.8 misses every band with probability 2e-6.
2. Rows are shuffled on band hashes. Inside a bucket, pairs whose 128-bit
   sketches say that they are far below the threshold are passed over; of the
   rest only a spanning forest leaves the task. A bucket too large to look at
   pair by pair keeps all its members together instead, so nothing is lost;
   such buckets are counted first and never meet in one task.
3. The connected components of these edges hold every candidate pair. The full
   n-gram sets of their texts, and only theirs, are made again and gathered by
   component; all pairs inside are verified on the full sets by blocks, and
   counts and classes come out. A large component is cut into blocks by set
   size, so that it is spread over hundreds of units of work and no unit holds
   more than ``UNIT_BYTES`` of sets, or two; blocks whose sizes differ too much
   for the threshold never meet.

Defined results: texts of fewer than five words have their whole word
sequence as one n-gram; texts without words are copies of each other and link
to no other text; a null text counts as empty; repeated rows count as copies;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import bounded, cut, rank_within, row_key
from .textvec import Batch, flat_ranges, mixed, portions

N = 5
THRESHOLD = 0.8
BANDS, ROWS, SKETCH = 25, 4, 128
NEAR = 0.5  # estimated similarity from which a pair stays a candidate; 0.8 lies over 5 deviations above
BLOCK = 1024  # most texts of a block
LEAST_BLOCK, PARTS = 128, 32  # a component of up to twice LEAST_BLOCK texts stays whole; larger ones have PARTS blocks or more
UNIT_BYTES = 32 << 20
PRIME = np.uint64(0x100000001B3)
#: Bits of the broadcast filter of documents to read again: at most 16 MB, for at most ``FILTER_MOST`` texts.
FILTER_BITS, FILTER_MOST = 27, 1 << 23


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20240607).integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def ngram_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of all texts, sorted within each, and where each text's begin."""
    batch = Batch(texts)
    start, end = batch.words()
    counts = batch.counts(start)
    word = batch.hashes(start, end, fold=True) if len(start) else np.zeros(0, np.uint64)
    first = np.concatenate([[0], np.cumsum(counts)])
    grams = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    at = flat_ranges(first[:-1], grams)
    owner = np.repeat(np.arange(len(texts)), grams)
    size = np.minimum(counts[owner], n)
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        there = size > k
        # Texts of one length take the same path, so a short text cannot equal a long one's n-gram.
        h = np.where(there, (h ^ word[np.minimum(at + k, len(word) - 1)]) * PRIME + (h >> np.uint64(29)) if len(word) else h, h)
    h = mixed(h + size.astype(np.uint64))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(texts) + 1))


def set_key(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def signatures(grams: np.ndarray, off: np.ndarray, bands: int, rows: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes and bit sketches of non-empty sets laid end to end."""
    low = (grams >> np.uint64(32)).astype(np.uint32)
    starts = off[:-1]
    total = max(bands * rows, bits)
    least = np.empty((total, len(starts)), np.uint32)
    work = np.empty_like(low)
    for k, a in enumerate(multipliers(total)):
        np.multiply(low, a, out=work)
        work ^= work >> np.uint32(15)
        least[k] = np.minimum.reduceat(work, starts)
    band = np.empty((bands, len(starts)), np.uint64)
    for j in range(bands):
        h = np.full(len(starts), j + 1, np.uint64)
        for k in range(rows):
            h = mixed(h * PRIME + least[j * rows + k])
        band[j] = h
    sketch = np.packbits((least[:bits] >> np.uint32(3) & np.uint32(1)).astype(np.uint8), axis=0)
    return band.T.copy(), sketch.T.copy()


def forest(adjacent: np.ndarray) -> np.ndarray:
    """Least index of the component of each index, for a symmetric matrix of flags."""
    m = len(adjacent)
    label = np.full(m, -1)
    for i in range(m):
        if label[i] >= 0:
            continue
        front = np.zeros(m, bool)
        front[i] = True
        seen = front.copy()
        while front.any():
            front = adjacent[front].any(axis=0) & ~seen
            seen |= front
        label[seen] = i
    return label


def near_edges(keys: list[bytes], sketches: list[bytes], bits: int, near: float) -> list[tuple[bytes, bytes]]:
    m = len(keys)
    bitmap = np.unpackbits(np.frombuffer(b"".join(sketches), np.uint8).reshape(m, -1), axis=1).astype(np.float32) * 2 - 1
    adjacent = bitmap @ bitmap.T >= near * bits
    label = forest(adjacent)
    return [(keys[i], keys[k]) for i, k in enumerate(label) if i != k]


def bucket_edges(bits: int, near: float, most: int):
    """Streams rows sorted by band; holds at most ``most`` rows of a bucket at once, whatever comes."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, bytes]] = []
        band, keys, sketches, hub = None, [], [], None

        def close() -> None:
            if hub is not None:
                out.extend((k, hub) for k in keys)
            elif len(keys) > 1:
                out.extend(near_edges(keys, sketches, bits, near))

        for batch in batches:
            for b, k, s in zip(*[batch.column(c).to_pylist() for c in ("band", "key", "sketch")], strict=True):
                if b != band:
                    close()
                    band, keys, sketches, hub = b, [], [], None
                keys.append(k)
                sketches.append(s)
                if len(keys) > most:
                    # Too many to compare: all stay candidates of each other.
                    hub = hub or keys[0]
                    out.extend((k, hub) for k in keys if k != hub)
                    keys, sketches = [], []
            yield flush(out)
        close()
        yield flush(out)

    return edges


def flush(out: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    pairs = [p for p in set(out) if p[0] != p[1]]
    batch = pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], ["a", "b"])
    out.clear()
    return batch


def candidate_edges(bucketed: DataFrame, bits: int, near: float, most: int) -> DataFrame:
    """Edges (a, b) that join all candidate pairs of ``bucketed`` (band, key, sketch).

    Buckets of more than ``most`` rows are found by counting, which is
    pre-aggregated, and their members are hung under the least of them, so
    that no bucket is larger than that where it is looked at in one task.
    """
    hot = bounded(cut(bucketed.groupBy("band").count().where(F.col("count") > most).select(F.col("band").alias("_hot"))))
    if not hot.limit(1).count():
        return within_buckets(bucketed, bits, near, most)
    members = bucketed.join(hot, F.col("band") == F.col("_hot"))
    hubs = bounded(cut(members.groupBy("band").agg(F.min("key").alias("b")).withColumnRenamed("band", "_hub")))
    hung = bucketed.join(hubs, F.col("band") == F.col("_hub")).where("key <> b").select(F.col("key").alias("a"), "b")
    return within_buckets(bucketed.join(hot, F.col("band") == F.col("_hot"), "left_anti"), bits, near, most).union(hung)


def within_buckets(bucketed: DataFrame, bits: int, near: float, most: int) -> DataFrame:
    return bucketed.repartition(F.col("band")).sortWithinPartitions("band", "key").mapInArrow(bucket_edges(bits, near, most), "a binary, b binary")


def common(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of each left set with each right one (or left one)."""
    sets = left + (right or [])
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    grams, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    same = np.zeros(len(grams), bool)
    same[1:] = grams[1:] == grams[:-1]
    shared = same.copy()
    shared[:-1] |= same[1:]
    # n-grams that one set alone has meet nothing
    number = np.cumsum(~same)[shared]
    owner = owner[shared]
    a = len(left)
    found = np.zeros((a, len(sets) - a if right is not None else a), np.float32)
    if not len(number):
        return found
    number = np.unique(number, return_inverse=True)[1]
    width = 4096
    for low in range(0, int(number[-1]) + 1, width):
        i, j = np.searchsorted(number, (low, low + width))
        x = np.zeros((len(sets), width), np.float32)
        x[owner[i:j], number[i:j] - low] = 1
        found += x[:a] @ (x[a:] if right is not None else x).T
    return found


def linked(inter: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Pairs whose intersection over union reaches the threshold, in whole numbers."""
    p, q = threshold.numerator, threshold.denominator
    inter = np.rint(inter).astype(np.int64)
    return (p + q) * inter >= p * (left[:, None] + right[None, :])


def verify(threshold: Fraction):
    """Rows of one component, or of two blocks of it, come sorted by ``unit`` and give links and edges."""

    def one(sides, keys, weights, sets) -> Iterator[tuple]:
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        weights = np.array(weights, np.int64)
        side = np.array(sides)
        if side.any():
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(a) or not len(b):
                return
            hit = linked(common([sets[i] for i in a], [sets[i] for i in b]), sizes[a], sizes[b], threshold)
            n = len(keys)
            adjacent = np.zeros((n, n), bool)
            adjacent[np.ix_(a, b)] = hit
            adjacent |= adjacent.T
        else:
            adjacent = linked(common(sets, None), sizes, sizes, threshold)
            np.fill_diagonal(adjacent, False)
        label = forest(adjacent)
        texts, docs = adjacent.sum(axis=1), adjacent @ weights
        for i in np.flatnonzero(texts):
            yield keys[i], int(texts[i]), int(docs[i]), keys[label[i]]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, out = None, ([], [], [], []), []
        for batch in batches:
            for u, *row in zip(*[batch.column(c).to_pylist() for c in ("unit", "side", "key", "copies", "grams")], strict=True):
                if u != unit:
                    if len(held[0]) > 1:
                        out += one(*held)
                    unit, held = u, ([], [], [], [])
                for into, value in zip(held, row, strict=True):
                    into.append(value)
                held[3][-1] = np.frombuffer(held[3][-1], np.uint64)
            yield made(out)
            out = []
        if len(held[0]) > 1:
            out += one(*held)
        yield made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], ["key", "texts", "docs", "root"])

    return rows


def ngram_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = N,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
    bits: int = SKETCH,
    near: float = NEAR,
    block: int = BLOCK,
    least: int = LEAST_BLOCK,
    most: int = 2 * BLOCK,
    keyed: bool = False,
) -> DataFrame:
    """One row per document: doc_id, class_id, links, text_links, n_grams, copies.

    ``class_id`` is the smallest doc_id that links reach. ``links`` counts the
    other documents whose similarity reaches the threshold, copies included;
    ``text_links`` counts the different n-gram sets among them. If ``keyed``,
    ``row`` is the ``row_key`` and ``kept`` marks the row of each class that
    stays: the one with the smallest id, nulls last, and of those the least
    key. Rows that are equal in every column are marked alike.
    """
    extra = ["row"] if keyed else []
    exact = Fraction(str(threshold))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            keys, sizes, counts, values, sketches = [], [], [], [], []
            for lo, hi in portions(texts):
                grams, off = ngram_sets(texts[lo:hi], n)
                own = [set_key(grams[off[i] : off[i + 1]]) for i in range(hi - lo)]
                lengths = np.diff(off)
                # Only the first of equal sets in a task, and no empty set, goes on to the bands.
                fresh = np.zeros(hi - lo, bool)
                for i, k in enumerate(own):
                    if lengths[i] and k not in seen:
                        seen.add(k)
                        fresh[i] = True
                keys += own
                sizes += lengths.tolist()
                s: list = [None] * (hi - lo)
                counts.append(fresh * bands)
                if fresh.any():
                    chosen = np.flatnonzero(fresh)
                    part = np.concatenate([[0], np.cumsum(lengths[chosen])])
                    band, sk = signatures(grams[flat_ranges(off[:-1][chosen], lengths[chosen])], part, bands, rows, bits)
                    values.append(band.view(np.int64).ravel())
                    for x, i in enumerate(chosen):
                        s[i] = sk[x].tobytes()
                sketches += s
                if len(seen) > 500_000:
                    seen.clear()
            edge = np.concatenate([[0], np.cumsum(np.concatenate(counts) if counts else [])]).astype(np.int32)
            bands_of = pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), bands_of, pa.array(sketches, pa.binary()), *batch.columns[2:]],
                ["doc_id", "key", "n_grams", "bands", "sketch", *extra],
            )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[row_key(docs, text_col).alias(c) for c in extra])
    marked = cut(source.mapInArrow(sketch, ", ".join(["doc_id long, key binary, n_grams long, bands array<long>, sketch binary", *[f"{c} binary" for c in extra]])))
    first = [F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")] if keyed else []
    texts = cut(marked.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), *first))

    groups = components(candidate_edges(marked.where("sketch is not null").select(F.explode("bands").alias("band"), "key", "sketch"), bits, near, most))
    candidates = cut(groups.join(texts, F.col("node") == F.col("key")).select("key", "component", "first_id", "copies"))

    # Which documents to read again: a bitmap whose misses cost only work, or, for more texts than it may hold, a join.
    many_texts = candidates.count()
    log = min(FILTER_BITS, max(12, int(16 * many_texts).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << log))
    again = source.select("doc_id", "text")
    bitmap = np.zeros(1 << log - 6, np.uint64)
    if many_texts > FILTER_MOST:
        again = again.join(candidates.select(F.col("first_id").alias("_first")).distinct(), F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi")
        bitmap[:] = ~np.uint64(0)
    else:
        words = candidates.select(place("first_id").alias("p")).groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v"))
        for r in words.toLocalIterator():
            bitmap[r.w] = r.v & 0xFFFFFFFFFFFFFFFF
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits_of = shared.value
        for batch in batches:
            p = batch.column(1).to_numpy()
            want = (bits_of[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
            texts_of = [t or "" for t in batch.column(0).filter(pa.array(want)).to_pylist()]
            for lo, hi in portions(texts_of):
                grams, off = ngram_sets(texts_of[lo:hi], n)
                own = [grams[off[i] : off[i + 1]] for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([pa.array([set_key(g) for g in own], pa.binary()), pa.array([g.tobytes() for g in own], pa.binary())], ["set_key", "grams"])

    read = again.select("text", place("doc_id").alias("p")).mapInArrow(sets, "set_key binary, grams binary")
    needed = read.join(candidates, F.col("set_key") == F.col("key")).dropDuplicates(["key"]).select("key", "component", "copies", "grams", F.octet_length("grams").alias("size"))
    needed = cut(needed)

    # Small components are one unit of work; large ones are cut into blocks by set size.
    counts = needed.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("bytes"))
    least = min(least, block)
    whole = (F.col("members") <= 2 * least) & (F.col("bytes") <= UNIT_BYTES)
    fits = F.col("members") * (UNIT_BYTES // 2) / F.col("bytes")
    size = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(fits), F.greatest(F.lit(least), F.floor(F.col("members") / PARTS))))
    large_ones = bounded(cut(counts.where(~whole).select(F.col("component").alias("_c"), size.alias("_block"))))
    many = large_ones.limit(1).count() > 0
    alone = needed.join(large_ones, F.col("component") == F.col("_c"), "left_anti") if many else needed
    units = alone.select(F.hex("component").alias("unit"), F.lit(0).alias("side"), "key", "copies", "grams")
    if many:
        large = cut(needed.join(large_ones, F.col("component") == F.col("_c")).drop("_c"))
        ranked = cut(rank_within(large.select("component", "key", "size", "_block"), ["component"], ["size", "key"], "r").withColumn("b", F.floor(F.col("r") / F.col("_block"))))
        ranges = ranked.groupBy("component", "b").agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
        left, right = (ranges.select(F.col("component").alias(f"c{s}"), F.col("b").alias(f"b{s}"), F.col("lo").alias(f"lo{s}"), F.col("hi").alias(f"hi{s}")) for s in "xy")
        meet = left.join(right, (F.col("cx") == F.col("cy")) & (F.col("bx") <= F.col("by"))).where(F.col("loy") * exact.numerator <= F.col("hix") * exact.denominator)
        unit = F.concat_ws(":", F.hex("cx"), F.col("bx"), F.col("by")).alias("unit")
        seats = meet.select(unit, F.col("cx").alias("c"), F.col("bx").alias("at"), F.lit(0).alias("side")).union(
            meet.where("bx < by").select(unit, F.col("cx").alias("c"), F.col("by").alias("at"), F.lit(1).alias("side"))
        )
        placed = ranked.select("component", "b", F.col("key").alias("k")).join(seats, (F.col("component") == F.col("c")) & (F.col("b") == F.col("at"))).select("unit", "side", "k")
        units = units.union(placed.join(large, F.col("k") == F.col("key")).select("unit", "side", "key", "copies", "grams"))
    found = units.repartition(F.col("unit")).sortWithinPartitions("unit", "side", "key").mapInArrow(verify(exact), "key binary, texts long, docs long, root binary")
    found = cut(found)
    links = found.groupBy("key").agg(F.sum("texts").alias("text_links"), F.sum("docs").alias("links"), F.min("root").alias("root"))
    if many:
        classes = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
        links = links.drop("root").join(classes.select(F.col("node").alias("key"), F.col("component").alias("root")), "key", "left")
    of = texts.join(links, "key", "left").withColumn("root", F.coalesce("root", "key"))
    best = [F.min("best").alias("_best")] if keyed else []
    lowest = of.groupBy("root").agg(F.min("first_id").alias("class_id"), *best)
    stays = ["_best"] if keyed else []
    of = of.join(lowest, "root").select(F.col("key").alias("_key"), "class_id", "copies", F.coalesce("text_links", F.lit(0)).alias("text_links"), F.coalesce("links", F.lit(0)).alias("links"), *stays)
    return marked.select("doc_id", "key", "n_grams", *extra).join(of, F.col("key") == F.col("_key")).select(
        "doc_id",
        "class_id",
        (F.col("links") + F.col("copies") - 1).alias("links"),
        "text_links",
        "n_grams",
        "copies",
        *extra,
        *[(F.col("row") == F.col(f"{c}.row")).alias("kept") for c in stays],
    )


def op4(spark, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
