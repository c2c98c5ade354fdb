"""Bounded-space online packing of documents into training sequences.

Each partition keeps a fixed number of open windows. A document is tokenized,
cut into whole sequences as far as it fills them, and its remainder goes into
the open window that it fits best. When it fits none and all windows are open,
the fullest is emitted and a new one opened. Windows still open at the end of
the partitions are packed as wholes in the same way, some partitions together,
and so on until one task is left, which emits all it holds. A task of that
merge gets at most ``FAN_IN`` times the number of open windows, however large
the input is.

Defined results: a null or empty text is the end token alone; an empty table
gives no pieces; repeated rows are packed as documents of their own; very long
texts are tokenized in segments cut at token boundaries.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut
from .textvec import portions
from .tokenize import encoder, vocabulary

LENGTH = 1024
OPEN = 128
FAN_IN = 32
SLICE = 1024
END = 0

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Windows:
    """A fixed number of open windows; ``emit`` gets the pieces of each window that closes."""

    def __init__(self, length: int, most: int, emit) -> None:
        self.length, self.most, self.emit = length, most, emit
        self.room: list[tuple[int, int]] = []  # free space and number of each open window, in order
        self.held: dict[int, list] = {}
        self.next = 0

    def place(self, size: int, pieces: list) -> None:
        i = bisect_left(self.room, (size, -1))
        if i < len(self.room):
            free, window = self.room.pop(i)
        else:
            if len(self.room) >= self.most:
                self.emit(self.held.pop(self.room.pop(0)[1]))
            free, window = self.length, self.next
            self.next += 1
            self.held[window] = []
        self.held[window] += pieces
        if free == size:
            self.emit(self.held.pop(window))
        else:
            insort(self.room, (free - size, window))

    def rest(self) -> Iterator[list]:
        for _, window in self.room:
            yield self.held[window]


class Rows:
    """Pieces as columns; ``closed`` tells whether a sequence is final."""

    NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

    def __init__(self, task: int) -> None:
        self.task, self.sequence, self.rows, self.closed = task, 0, [], []

    def add(self, pieces: list, closed: bool = True) -> None:
        # Numbers of sequences are unique: the task's above, the task's own count below.
        number, at = (self.task << 34) + self.sequence, 0
        self.sequence += 1
        for doc, start, length, crc, total in pieces:
            self.rows.append((doc, start, length, crc, total, number, at))
            at += length
        self.closed += [closed] * len(pieces)

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[]] * len(self.NAMES)
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns] + [pa.array(self.closed, pa.bool_()), pa.array([self.task] * len(self.rows), pa.int64())], [*self.NAMES, "closed", "task"])
        self.rows, self.closed = [], []
        return batch


def token_pieces(path: str, length: int, ids: list[int], texts: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Row id, tokens of its document and ids of each document."""
    ids_of = encoder(path, added=True)
    encode = ids_of.encode
    parts, owner = [], []
    for i, t in enumerate(texts):
        for s in ids_of.segments(t):
            parts.append(s)
            owner.append(i)
    held: list[np.ndarray] = []
    for a, b in portions(parts):
        flat, off = encode(parts[a:b])
        for k in range(a, b):
            held.append(flat[off[k - a] : off[k - a + 1]])
            if k + 1 == len(parts) or owner[k + 1] != owner[k]:
                yield ids[owner[k]], np.concatenate([*held, [END]]).astype("<u4")
                held = []


def pack(
    docs: DataFrame,
    length: int = LENGTH,
    windows: int = OPEN,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack every document; one row per piece, as in ``PIECE``.

    A piece holds the tokens ``start`` to ``start + length`` of its document,
    which has ``doc_tokens`` with the end token, and stands at ``offset`` of
    its sequence. ``ids_crc32`` is the checksum of its ids.
    """
    path = tokenizer or vocabulary()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = Rows(TaskContext.get().partitionId())
        open_windows = Windows(length, windows, rows.add)
        # Some rows of a batch at a time, as their texts are held twice.
        for batch in (b.slice(a, SLICE) for b in batches for a in range(0, b.num_rows, SLICE)):
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for doc, tokens in token_pieces(path, length, ids, texts):
                n = len(tokens)
                for start in range(0, n, length):
                    piece = tokens[start : start + length]
                    one = [(doc, start, len(piece), zlib.crc32(piece.tobytes()), n)]
                    if len(piece) == length:
                        rows.add(one)
                    else:
                        open_windows.place(len(piece), one)
            yield rows.take()
        for pieces in open_windows.rest():
            rows.add(pieces, closed=False)
        yield rows.take()

    def merge(level: int, last: bool):
        def merged(key, table):
            group = key[0].as_py()
            rows = Rows((level << 26) + group)
            open_windows = Windows(length, windows, rows.add)
            table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
            columns = [table.column(c).to_pylist() for c in Rows.NAMES[:5]]
            bounds = np.flatnonzero(np.diff(table.column("sequence_id").to_numpy(), prepend=-1)).tolist() + [table.num_rows]
            held = [list(zip(*[c[a:b] for c in columns], strict=True)) for a, b in zip(bounds, bounds[1:], strict=False)]
            for pieces in sorted(held, key=lambda p: -sum(x[2] for x in p)):
                open_windows.place(sum(x[2] for x in pieces), pieces)
            for pieces in open_windows.rest():
                rows.add(pieces, closed=last)
            rows.task = group
            return pa.Table.from_batches([rows.take()])

        return merged

    schema = PIECE + ", closed boolean, task long"
    packed = cut(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(place, schema))
    done, rest = packed.where("closed"), packed.where("not closed")
    tasks = (rest.agg(F.max("task")).first()[0] or 0) + 1
    level = 0
    while True:
        level += 1
        tasks = -(-tasks // FAN_IN)
        moved = rest.withColumn("_to", F.floor(F.col("task") / FAN_IN)).groupBy("_to").applyInArrow(merge(level, tasks == 1), schema)
        if tasks == 1:
            return done.unionByName(moved).select(*Rows.NAMES)
        moved = cut(moved)
        done, rest = done.unionByName(moved.where("closed")), moved.where("not closed")


def op2(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
