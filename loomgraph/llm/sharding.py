"""Shards of nearly equal bytes: minimax contiguous partition of atomic groups.

Rows with equal texts form a group that is never split. Groups stand in the
order of a digest of their text. The smallest capacity for which a greedy scan
needs no more shards than there are is found by binary search, and the shards
are cut there.

The scan is run on the driver over bounded summaries only: the groups are
summed by a prefix of their digest, and a prefix's sums tell between which
capacities the answer lies. Only the few prefixes in which a cut can fall are
then split further, again and again, until every possible cut is known
exactly. The result is that of a scan over all groups.

A group larger than an even share has a shard of its own, since no cut could
make that shard smaller; the others share what is left.

Within the capacity found, cuts move as near to even shares as the capacity
lets them, so the last shard is not the short one.

Defined results: a null text counts as empty; an empty table gives an empty
result; repeated rows are rows of one group; shards may be empty when there
are fewer groups than shards.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, rank_within

PER_ROW = 8
FIRST, STEP = 3, 2  # hexadecimal digits of the first summary, and of each further one


@dataclass
class Bins:
    """Runs of consecutive groups: digest prefix, bytes, groups and the largest group."""

    prefix: list[str]
    size: np.ndarray
    groups: np.ndarray
    largest: np.ndarray

    def __post_init__(self) -> None:
        self.edge = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        self.open = self.groups > 1

    def mirrored(self) -> Bins:
        return Bins(self.prefix[::-1], self.size[::-1], self.groups[::-1], self.largest[::-1])

    def at(self, x: int) -> int:
        return min(int(np.searchsorted(self.edge, x, side="right")) - 1, len(self.size) - 1)

    def last_cut(self, x: int) -> tuple[int, int]:
        """Bounds of the last group boundary at or before ``x``."""
        if x >= self.edge[-1]:
            return int(self.edge[-1]), int(self.edge[-1])
        b = self.at(x)
        start = int(self.edge[b])
        if not self.open[b]:
            return start, start
        return max(start, x - int(self.largest[b]) + 1), x

    def scan(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        """Where a greedy scan ends each shard, by the lower or the upper bounds."""
        ends, x = [], 0
        for _ in range(shards):
            x = self.last_cut(x + capacity)[hopeful]
            ends.append(x)
        return ends

    def least(self, shards: int, hopeful: bool) -> int:
        total = int(self.edge[-1])
        low, high = max(-(-total // shards), int(self.largest.max(initial=0))), total
        while low < high:
            mid = (low + high) // 2
            if self.scan(mid, shards, hopeful)[-1] >= total:
                high = mid
            else:
                low = mid + 1
        return low

    def doubtful(self, spans: list[tuple[int, int]]) -> set[int]:
        found: set[int] = set()
        for a, b in spans:
            if len(self.size):
                i, j = self.at(max(0, a)), self.at(max(0, b))
                found.update(int(k) + i for k in np.flatnonzero(self.open[i : j + 1]))
        return found


def even_cuts(bins: Bins, capacity: int, shards: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Cuts near to even shares with no shard above ``capacity``, and where they could be."""
    total = int(bins.edge[-1])
    most = bins.scan(capacity, shards, True)[:-1]
    least = [total - x for x in bins.mirrored().scan(capacity, shards, True)[:-1]][::-1]
    cuts, spans, before = [], [], 0
    for i, (low, high) in enumerate(zip(least, most, strict=True)):
        high = min(high, bins.last_cut(before + capacity)[1])
        x = min(max((i + 1) * total // shards, low, before), max(high, before))
        a = bins.last_cut(x)[1]
        b = int(bins.edge[np.searchsorted(bins.edge, x)])
        spans.append((x, x))
        good = [c for c in (a, b) if max(low, before) <= c <= high]
        before = min(good, key=lambda c: abs(c - x), default=max(before, high))
        cuts.append(before)
    return cuts, spans


def group_cuts(groups: DataFrame, shards: int) -> list[str]:
    """Digest prefixes at which the shards after the first begin; ``groups`` has key and bytes."""

    def summed(digits: int, within: list[str] | None) -> dict[str, tuple[int, int, int]]:
        rows = groups
        if within is not None:
            parents = groups.sparkSession.createDataFrame([(p,) for p in within], "_in string")
            rows = groups.join(F.broadcast(parents), F.substring("key", 1, digits - STEP) == F.col("_in"), "left_semi")
        table = rows.groupBy(F.substring("key", 1, digits).alias("p")).agg(
            F.sum("bytes").alias("s"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("m")
        )
        return {r.p: (r.s, r.n, r.m) for r in table.toLocalIterator()}

    level, digits = summed(FIRST, None), FIRST
    while True:
        names = sorted(level)
        bins = Bins(names, *[np.array([level[p][k] for p in names], np.int64) for k in range(3)])
        if not names:
            return []
        total = int(bins.edge[-1])
        low, high = bins.least(shards, True), bins.least(shards, False)
        back = bins.mirrored()
        low_back, high_back = back.least(shards, True), back.least(shards, False)
        low, high = min(low, low_back), max(high, high_back)
        spans = list(zip(bins.scan(low, shards, False), bins.scan(high, shards, True), strict=True))
        spans += [(total - b, total - a) for a, b in zip(back.scan(low, shards, False), back.scan(high, shards, True), strict=True)]
        doubt = bins.doubtful(spans)
        if not doubt:
            cuts, spans = even_cuts(bins, low, shards)
            doubt = bins.doubtful(spans)
            if not doubt:
                return [names[int(np.searchsorted(bins.edge, c))] if c < total else "g" for c in cuts]
        digits += STEP
        # Bins not split this time keep a shorter prefix and are split by it later.
        chosen = [names[i] for i in doubt]
        finer: dict[str, tuple[int, int, int]] = {}
        for n in sorted({len(p) for p in chosen}):
            finer |= summed(n + STEP, [p for p in chosen if len(p) == n])
        level = {p: v for p, v in level.items() if p not in set(chosen)} | finer


def shard_rows(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put each row into a shard: doc_id, size, text_crc32, shard, slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + PER_ROW).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.sha2(text, 256).alias("key"),
    )
    rows = cut(rows)
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    giants: list[str] = []
    while len(giants) < shards - 1:
        # Fewer than ``shards`` groups can exceed an even share, so this list is bounded.
        share = max(1, total // (shards - len(giants)))
        large = [(r.key, r.bytes) for r in groups.where((F.col("bytes") > share) & ~F.col("key").isin(giants)).orderBy(F.desc("bytes"), "key").limit(shards - 1 - len(giants)).collect()]
        if not large:
            break
        giants += [k for k, _ in large]
        total -= sum(b for _, b in large)
    first = len(giants)
    cuts = group_cuts(groups.where(~F.col("key").isin(giants)), shards - first)
    shard = F.lit(first)
    for c in cuts:
        shard = shard + (F.col("key") >= c).cast("int")
    for i, key in enumerate(giants):
        shard = F.when(F.col("key") == key, i).otherwise(shard)
    placed = rows.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"))
    return rank_within(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot")


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_rows(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
