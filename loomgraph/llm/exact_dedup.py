"""Exact deduplication by Grace hashing.

Texts are equal when they are the same after the white space of ASCII is
deleted. Every task dedups what it holds with ``GraceTable``: records go to
spill files by a digest of their text, bucket by bucket, and a bucket that is
still too large is partitioned again by other bits of the digest, until it
fits an open-addressing table that compares complete contents.

The first pass dedups each input partition where it lies, so that a text with
copies all over the table leaves each partition once, with its best row and
its count. The second pass dedups those by digest. Contents travel and spill
compressed; where bytes differ under one digest, the contents are unpacked and
compared, since two builds of a compressor may pack one content differently. A
partition is taken in portions of at most ``PORTION`` rows, so that what is
kept for each row is bounded too.

Of equal texts the row with the most code points in its original text stays,
and of those the one with the smallest id.

Defined results: a null text counts as empty, and all empty texts are equal;
repeated ids are rows of their own, and one row of each group stays even then;
an empty table gives an empty result; a null id sorts after all others.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

WHITE = b"\x20\t\n\x0b\x0c\r"
MEMORY = 64 << 20  # bytes of contents that a table may hold
PORTION = 1 << 18  # rows of an input partition that are dedupped together
FAN_OUT = 16
NO_ID = 1 << 62

HEAD = struct.Struct("<32sqqqqqI")


class OpenTable:
    """Open addressing with linear probing; slots hold record numbers, contents are compared in full."""

    def __init__(self) -> None:
        self.records: list[list] = []
        self._resize(1 << 10)

    def _resize(self, size: int) -> None:
        self.mask = size - 1
        self.slots = [-1] * size
        for n, r in enumerate(self.records):
            i = int.from_bytes(r[0][:8], "little") & self.mask
            while self.slots[i] >= 0:
                i = (i + 1) & self.mask
            self.slots[i] = n

    def find(self, digest: bytes, content: bytes) -> list | None:
        """The record of this content, or None after having made room for it."""
        i = int.from_bytes(digest[:8], "little") & self.mask
        while (n := self.slots[i]) >= 0:
            r = self.records[n]
            if r[0] == digest and (r[1] == content or unpacked(r[1]) == unpacked(content)):
                return r
            i = (i + 1) & self.mask
        if 2 * len(self.records) >= len(self.slots):
            self._resize(2 * len(self.slots))
            return self.find(digest, content)
        self.slots[i] = len(self.records)
        return None


def unpacked(content: bytes) -> bytes:
    """The content behind compressed bytes; bytes that are no frame stand for themselves."""
    return zstandard.ZstdDecompressor().decompress(content) if content[:4] == zstandard.FRAME_HEADER else content


def better(a: tuple[int, int, int], b: tuple[int, int, int]) -> bool:
    """Whether row ``a`` stays rather than ``b``; rows are (code points, id, place in the input)."""
    return (-a[0], a[1], a[2]) < (-b[0], b[1], b[2])


class GraceTable:
    """Groups records (digest, content, row, count, label) by content.

    ``groups()`` yields each group as (digest, content, row, count, labels):
    the best row, the summed count and the labels of all its records.
    """

    def __init__(self, memory: int = MEMORY, level: int = 0) -> None:
        self.memory, self.level = memory, level
        self.table, self.held = OpenTable(), 0
        self.files: list | None = None
        self.folder: tempfile.TemporaryDirectory | None = None

    def add(self, digest: bytes, content: bytes, row: tuple[int, int, int], count: int, label: int) -> None:
        if self.files is not None:
            self._spill(digest, content, row, count, label)
            return
        r = self.table.find(digest, content)
        if r is None:
            self.table.records.append([digest, content, row, count, [label]])
            self.held += len(content) + 300
        else:
            if better(row, r[2]):
                r[2] = row
            r[3] += count
            r[4].append(label)
            self.held += 40
        # Records that all have one content cannot be parted by partitioning.
        if self.held > self.memory and len(self.table.records) > 1 and self.level < 16:
            self._part()

    def _part(self) -> None:
        self.folder = tempfile.TemporaryDirectory(prefix="grace-")
        self.files = [open(os.path.join(self.folder.name, str(i)), "wb+") for i in range(FAN_OUT)]
        for digest, content, row, count, labels in self.table.records:
            self._spill(digest, content, row, count, labels[0])
            for label in labels[1:]:
                # What the first record carries counts for all.
                self._spill(digest, content, row, 0, label)
        self.table, self.held = OpenTable(), 0

    def _spill(self, digest: bytes, content: bytes, row: tuple[int, int, int], count: int, label: int) -> None:
        # Bits from the end of the digest; the table takes them from its start.
        bucket = digest[31 - self.level // 2] >> 4 * (self.level % 2) & FAN_OUT - 1
        self.files[bucket].write(HEAD.pack(digest, *row, count, label, len(content)))
        self.files[bucket].write(content)

    def groups(self) -> Iterator[list]:
        if self.files is None:
            yield from self.table.records
            return
        try:
            for file in self.files:
                file.seek(0)
                inner = GraceTable(self.memory, self.level + 1)
                while head := file.read(HEAD.size):
                    digest, chars, doc, place, count, label, size = HEAD.unpack(head)
                    inner.add(digest, file.read(size), (chars, doc, place), count, label)
                file.truncate(0)
                yield from inner.groups()
        finally:
            for file in self.files:
                file.close()
            self.folder.cleanup()


def dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    memory: int = MEMORY,
    portion: int = PORTION,
) -> DataFrame:
    """Group of each row: doc_id, keep_id, group_size, kept and text_sha256."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 36
        pack = zstandard.ZstdCompressor(level=1).compress
        n, groups = 0, 0

        def packed(made: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*made, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 4)
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(made), pa.int64()), pa.array([True] * len(made), pa.bool_())], NAMES)

        def drained(table: GraceTable, seen: list, digests: list[bytes]) -> Iterator[pa.RecordBatch]:
            """The groups of a portion, and its rows with their groups."""
            nonlocal groups
            group, made, size = np.zeros(len(seen), np.int64), [], 0
            for digest, content, row, count, labels in table.groups():
                group[labels] = task + groups
                made.append((task + groups, digest, content, *row, count))
                groups += 1
                size += len(content) + 200
                if size > 8 << 20:
                    yield packed(made)
                    made, size = [], 0
            yield packed(made)
            for a in range(0, len(seen), 1 << 16):
                own = slice(a, a + (1 << 16))
                k = len(seen[own])
                none, place = pa.nulls(k, pa.int64()), task + n - len(seen) + a + np.arange(k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group[own]), pa.array(digests[own], pa.binary()), pa.nulls(k, pa.binary()), none, none, pa.array(place), none, pa.array(seen[own], pa.int64()), pa.array([False] * k, pa.bool_())], NAMES
                )

        table, seen, digests = GraceTable(memory), [], []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                plain = text.encode("utf-8", "surrogatepass").translate(None, WHITE)
                digest = hashlib.sha256(plain).digest()
                table.add(digest, pack(plain), (len(text), NO_ID if doc is None else doc, task + n), 1, len(seen))
                seen.append(doc)
                digests.append(digest)
                n += 1
            if len(seen) >= portion:
                yield from drained(table, seen, digests)
                table, seen, digests = GraceTable(memory), [], []
        yield from drained(table, seen, digests)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = GraceTable(memory)
        for batch in batches:
            for digest, content, chars, doc, place, count, group in zip(*[batch.column(c).to_pylist() for c in ("digest", "content", "chars", "doc", "place", "count", "group")], strict=True):
                table.add(digest, content, (chars, doc, place), count, group)
        made: list[tuple] = []

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], pa.int64()) for i in range(4)], ["group", "keep_id", "keep_place", "group_size"])
            made.clear()
            return out

        for _, _, (_, doc, place), count, labels in table.groups():
            made.extend((label, doc, place, count) for label in labels)
            if len(made) > 50_000:
                yield rows()
        yield rows()

    NAMES = ["group", "digest", "content", "chars", "doc", "place", "count", "doc_id", "best"]
    schema = "group long, digest binary, content binary, chars long, doc long, place long, count long, doc_id long, best boolean"
    local = cut(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(first, schema))
    best = local.where("best").select("group", "digest", "content", "chars", "doc", "place", "count")
    merged = best.repartition(F.col("digest")).mapInArrow(second, "group long, keep_id long, keep_place long, group_size long")
    rows = local.where("not best").select(F.col("group").alias("_group"), "doc_id", "digest", "place")
    joined = rows.join(merged, F.col("_group") == F.col("group"))
    return joined.select(
        "doc_id",
        F.when(F.col("keep_id") != NO_ID, F.col("keep_id")).alias("keep_id"),
        "group_size",
        (F.col("place") == F.col("keep_place")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op7(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
with n as (
  select doc_id, length(coalesce(text, '')) as chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as plain from documents
), r as (
  select *, first_value(doc_id) over w as keep_id, count(*) over (partition by plain) as group_size, row_number() over w as place from n
  window w as (partition by plain order by chars desc, doc_id)
)
select doc_id, keep_id, group_size, place = 1 as kept, sha256(plain) as text_sha256 from r
"""
