"""Media columns of progressive JPEG files and their RGB tensors.

``encode_media`` stores texts: a text's UTF-8 bytes, filled with zero bytes to
a positive multiple of 64, are the quantized coefficients of 8 x 8 blocks,
each less 128, and the image is written as a progressive file with chroma at
half resolution. Coefficients are what the format keeps without loss, so the
payload comes back bit by bit. A payload of more than ``CHUNK`` bytes becomes
several files one after the other, so that memory stays bounded.

``decode_media`` reads files, any that ``jpeg`` takes: it accumulates all scans
into coefficients, transforms them back, upsamples chroma and stores tensors
of height x width x 3 bytes at full resolution.

Defined results: a null or empty text is a payload of 64 zero bytes; a null
medium gives null columns; a medium that cannot be read gives null columns and
its fault in ``error``; equal texts give equal files, tensors and features in
any batch; repeated rows are handled each; columns of ``docs`` with the names
of new columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg

SAMPLING = ((2, 2), (1, 1), (1, 1))
BLOCKS = 6  # of an MCU
CHUNK = 1 << 20
SHIFT = 128


def frame_for(blocks: int, at: int) -> tuple[jpeg.Frame, int]:
    """An image nearly square that holds so many blocks, placed at ``at``, and the end of its blocks."""
    mcus = max(1, -(-blocks // BLOCKS))
    cols = int(np.ceil(np.sqrt(mcus)))
    frame = jpeg.Frame(16 * cols, 16 * -(-mcus // cols), SAMPLING)
    return frame, frame.place(at)


def files_of(texts: list[bytes]) -> list[bytes]:
    """The stored form of each byte string."""
    frames, notes, owner, spots, total = [], [], [], [], 0
    for i, t in enumerate(texts):
        for lo in range(0, max(1, len(t)), CHUNK):
            piece = t[lo : lo + CHUNK]
            frame, end = frame_for(-(-max(1, len(piece)) // 64), total)
            frames.append(frame)
            notes.append(b"payload " + str(len(piece)).encode())
            spots.append((total * 64, piece))
            owner.append(i)
            total = end
    coefs = np.zeros(total * 64, np.int32)
    for at, piece in spots:
        size = -(-max(1, len(piece)) // 64) * 64
        coefs[at : at + size] = -SHIFT
        coefs[at : at + len(piece)] += np.frombuffer(piece, np.uint8)
    out = [b""] * len(texts)
    for i, file in zip(owner, jpeg.encode(frames, coefs.reshape(-1, 64), notes), strict=True):
        out[i] += file
    return out


def feature(tensors: list[np.ndarray]) -> str:
    """Sizes of the images, and mean and mean square of each channel over all of them, from exact sums."""
    pixels = sum(t.shape[0] * t.shape[1] for t in tensors)
    sums, squares = np.zeros(3), np.zeros(3)
    for t in tensors:
        flat = t.reshape(-1, 3)
        for c in range(3):
            counts = np.bincount(flat[:, c], minlength=256)
            sums[c] += counts @ np.arange(256)
            squares[c] += counts @ np.arange(256) ** 2
    sizes = ",".join(f"{t.shape[1]}x{t.shape[0]}" for t in tensors)
    return sizes + " mean " + " ".join(f"{x / pixels:.4f}" for x in sums) + " square " + " ".join(f"{x / pixels:.2f}" for x in squares)


def read_media(media: list[bytes | None]) -> list[tuple]:
    """(tensor bytes, shapes, payload, payload's own length, feature, error) of each value."""
    out: list[tuple] = [(None,) * 6] * len(media)
    there = [i for i, m in enumerate(media) if m is not None]
    if not there:
        return out
    try:
        frames, coefs, notes, owner = jpeg.decode([media[i] for i in there])
    except (ValueError, IndexError, KeyError) as fault:
        if len(there) == 1:
            out[there[0]] = (None, None, None, None, None, str(fault) or type(fault).__name__)
            return out
        for i in there:
            out[i] = read_media([media[i]])[0]
        return out
    held: list[list] = [[] for _ in there]
    for frame, note, k in zip(frames, notes, owner, strict=True):
        payload, own = None, None
        if note.startswith(b"payload "):
            own = int(note[8:])
            size = -(-max(1, own) // 64)
            payload = (coefs[frame.first[0] : frame.first[0] + size] + SHIFT).astype(np.uint8).tobytes()
        held[k].append((jpeg.rgb(frame, coefs), payload, own))
    for i, parts in zip(there, held, strict=True):
        tensors = [p[0] for p in parts]
        stored = all(p[1] is not None for p in parts)
        out[i] = (
            b"".join(t.tobytes() for t in tensors),
            [{"height": t.shape[0], "width": t.shape[1]} for t in tensors],
            b"".join(p[1] for p in parts) if stored else None,
            sum(p[2] for p in parts) if stored else None,
            feature(tensors),
            None,
        )
    return out


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    first = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def encode_media(docs: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """``docs`` without the text, with its stored form."""
    kept = [c for c in docs.columns if c not in (text_col, media_col)]
    rows = docs.select(*kept, F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(len(kept)).to_pylist()]
            for a, b in slices([len(t) for t in texts], CHUNK):
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in range(len(kept))], pa.array(files_of(texts[a:b]), pa.binary())], [*kept, media_col])

    return rows.mapInArrow(run, rows.drop("_text").withColumn(media_col, F.lit(b"")).schema)


NEW = "tensor binary, shapes array<struct<height:int,width:int>>, payload binary, n_bytes long, feature string, error string"


def decode_media(rows: DataFrame, media_col: str = "media") -> DataFrame:
    """``rows`` with the tensors of their media, and what ``encode_media`` stored in them.

    ``tensor`` holds the images of a value one after the other, ``shapes`` their sizes.
    """
    names = [c.strip().split()[0] for c in ("tensor", "shapes", "payload", "n_bytes", "feature", "error")]
    kept = [c for c in rows.columns if c not in names]
    kinds = (pa.binary(), pa.list_(pa.struct([("height", pa.int32()), ("width", pa.int32())])), pa.binary(), pa.int64(), pa.string(), pa.string())
    place = kept.index(media_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column(place).to_pylist()
            for a, b in slices([len(m or b"") for m in media], CHUNK):
                found = read_media(media[a:b])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(a, b - a) for i in range(len(kept))], *[pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)]], [*kept, *names]
                )

    from pyspark.sql.types import StructType

    schema = StructType(rows.select(*kept).schema.fields + StructType.fromDDL(NEW).fields)
    return rows.select(*kept).mapInArrow(run, schema)


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    read = decode_media(encode_media(docs))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
