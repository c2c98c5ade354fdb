"""Nearest vectors by cosine: multi-index hashing of learned binary codes.

Codes are signs after a learned rotation: directions of most variance are
found on a bounded sample, rotated so that signs lose least (alternating
between signs and the best rotation for them), with as many rotations as the
bits need. A code is split into substrings of 16 bits.

The index is made of blocks of rows; each block has, for each substring, its
rows in the order of that substring's value. A query of radius r probes each
substring within its share of r. The shares add up so that a code within r
cannot miss all of them (pigeonhole), so every code of a block within the
radius is retrieved. Probes are listed values, or where these are more than
the values that occur, the values that occur. What is retrieved is compared by
whole code, and then ranked by cosines of the original vectors.

The radius is learned: for a bounded sample of queries the nearest rows of the
whole table are found exactly, and the radius covers ``target`` of them. A
query with fewer than k rows within the radius is asked again over all codes,
so it gets k where there are as many.

Queries go in blocks to the blocks of the index, each of bounded size; each
pair of blocks gives at most k rows for a query. Rows are dealt to blocks by
row number, so copies of one vector spread evenly.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor those of another length than the commonest (the
greatest of those as common). Repeated rows are rows of their own, and only
the query's own row is no candidate. Null ids are never queries and come last
among ties; rows of one id that tie come in any order. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut
from .vectors import common_length, matrix, sound

BITS = 128
PIECE = 16  # bits of a substring
BLOCK = 16_384  # rows of an index block
ASKED = 1024  # queries of a block
FIT_ROWS = 4096  # rows from which the rotation is learned
FIT_QUERIES = 256  # queries from which the radius is learned
TARGET = 0.98  # share of their nearest rows within the radius


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component to about 1, so that no product overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1))[:, None]


def learn(sample: np.ndarray, bits: int = BITS, steps: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the unit vectors, and projections (dim, bits) whose signs are the code."""
    x = unit(sample)
    mean = x.mean(0)
    x = x - mean
    _, _, axes = np.linalg.svd(x.T @ x)
    rng = np.random.default_rng(7)
    out: list[np.ndarray] = []
    while (left := bits - sum(m.shape[1] for m in out)) > 0:
        lead = axes[: min(left, len(axes))].T
        v = x @ lead
        turn = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))[0]
        for _ in range(steps):
            u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
            turn = w.T @ u.T
        out.append(lead @ turn)
    return mean, np.concatenate(out, 1)


def encode(x: np.ndarray, mean: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Codes as substrings, (rows, bits / 16) of 16 bits each."""
    return np.packbits((unit(x) - mean) @ turned >= 0, axis=1).view(">u2").astype(np.uint16)


def shares(radius: int, pieces: int) -> list[int]:
    """Radius of each substring; a code within ``radius`` is within its share in one of them at least."""
    whole, more = divmod(radius, pieces)
    return [whole if j <= more else whole - 1 for j in range(pieces)]


@cache
def masks(most: int) -> np.ndarray:
    """All 16-bit values with at most ``most`` bits set."""
    every = np.arange(1 << PIECE, dtype=np.uint16)
    return every[np.bitwise_count(every) <= most]


class Index:
    """The substring tables of one block."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.tables = []
        for j in range(codes.shape[1]):
            order = np.argsort(codes[:, j], kind="stable")
            values, starts = np.unique(codes[order, j], return_index=True)
            self.tables.append((order, values, np.append(starts, len(order))))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes differ from ``code`` in at most ``radius`` bits."""
        marked = np.zeros(len(self.codes), bool)
        for j, (share, (order, values, starts)) in enumerate(zip(shares(radius, len(self.tables)), self.tables, strict=True)):
            if share < 0:
                continue
            share = min(share, PIECE)
            if len(probes := masks(share)) < len(values):
                wanted = probes ^ code[j]
                at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
                hit = at[values[at] == wanted]
            else:
                hit = np.flatnonzero(np.bitwise_count(values ^ code[j]) <= share)
            size = starts[hit + 1] - starts[hit]
            ends = np.cumsum(size)
            if len(ends):
                marked[order[np.arange(ends[-1]) + np.repeat(starts[hit] - ends + size, size)]] = True
        found = np.flatnonzero(marked)
        return found[np.bitwise_count(self.codes[found] ^ code).sum(1, dtype=np.int64) <= radius]


def cosines(x: np.ndarray, norms: np.ndarray, q: np.ndarray, norm: float) -> np.ndarray:
    # Summed row by row, so that equal vectors have equal cosines wherever they stand.
    return (x * q).sum(1) / (norms * norm)


PAIR = "asked long, query_id long, vec_id long, score double, apart int"


@dataclass
class Learned:
    dim: int
    mean: np.ndarray
    turned: np.ndarray


def blocks(rows: DataFrame, size: int, of: Learned, name: str) -> DataFrame:
    """``rows(row, id, x)`` in blocks of about ``size`` rows: (name, rows, ids, codes, x)."""
    count = max(1, -(-rows.count() // size))

    def build(table: pa.Table) -> pa.Table:
        x = matrix(table.column("x").combine_chunks(), of.dim)
        codes = encode(x, of.mean, of.turned)
        listed = [pa.array([table.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("row", "id")]
        return pa.table([table.column(name).slice(0, 1), *listed, pa.array([codes.tobytes()]), pa.array([x.tobytes()])], names=[name, "rows", "ids", "codes", "x"])

    dealt = rows.withColumn(name, F.pmod(F.xxhash64("row"), F.lit(count)).cast("int"))
    return cut(dealt.groupBy(name).applyInArrow(build, f"{name} int, rows array<long>, ids array<long>, codes binary, x binary"))


def ask(index: DataFrame, queries: DataFrame, radius: int, k: int, of: Learned) -> DataFrame:
    """The k nearest rows of each block within the radius of each query, as ``PAIR``; ``apart`` is the distance of codes."""
    pieces = BITS // PIECE

    def opened(table: pa.Table, mark: str) -> tuple:
        rows = np.array(table.column(f"{mark}rows")[0].as_py(), np.int64)
        codes = np.frombuffer(table.column(f"{mark}codes")[0].as_py(), np.uint16).reshape(-1, pieces)
        return rows, table.column(f"{mark}ids")[0].as_py(), codes, np.frombuffer(table.column(f"{mark}x")[0].as_py()).reshape(-1, of.dim)

    def meet(table: pa.Table) -> pa.Table:
        rows, ids, codes, x = opened(table, "")
        asked, asked_ids, asked_codes, asked_x = opened(table, "q_")
        found, last = Index(codes), np.iinfo(np.int64).max
        order = np.array([last if i is None else i for i in ids], np.int64)
        x = scaled(x)
        norms = np.sqrt((x * x).sum(1))
        out: list[tuple] = []
        for n, q in enumerate(scaled(asked_x)):
            near = found.within(asked_codes[n], radius)
            near = near[rows[near] != asked[n]]
            score = cosines(x[near], norms[near], q, np.sqrt((q * q).sum()))
            if len(near) > k:
                top = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
                near, score = near[top], score[top]
            for t in np.lexsort((order[near], -score))[:k]:
                apart = int(np.bitwise_count(codes[near[t]] ^ asked_codes[n]).sum(dtype=np.int64))
                out.append((int(asked[n]), asked_ids[n], ids[near[t]], float(score[t]), apart))
        names = ["asked", "query_id", "vec_id", "score", "apart"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32()]
        return pa.table([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names=names)

    many = (index.agg(F.max("block")).first()[0] or 0) + 1
    sent = queries.select("q_block", *[F.col(c).alias(f"q_{c}") for c in ("rows", "ids", "codes", "x")], F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("block"))
    return best(sent.join(index, "block").groupBy("block", "q_block").applyInArrow(meet, PAIR), k)


def best(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("asked").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    embeddings: DataFrame,
    every: int = 50,
    k: int = 5,
    target: float = TARGET,
    block: int = BLOCK,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row whose id ``every`` divides."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = rows.where(sound(F.col("x")) & F.exists("x", lambda c: c != 0))
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "id", "x"))
    dim = common_length(rows, "x")
    none = embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not dim:
        return none
    rows = rows.where(F.size("x") == dim)
    asked = rows.where(F.pmod("id", F.lit(every)) == 0)
    by_hash = [F.xxhash64("x"), F.col("row")]
    sample = np.array([r.x for r in rows.orderBy(*by_hash).limit(FIT_ROWS).collect()])
    of = Learned(dim, *learn(sample))
    index, queries = blocks(rows, block, of, "block"), blocks(asked, ASKED, of, "q_block")
    if queries.isEmpty():
        return none
    tried = blocks(asked.orderBy(*by_hash).limit(FIT_QUERIES), ASKED, of, "q_block")
    apart = [r.apart for r in ask(index, tried, BITS, k, of).select("apart").collect()]
    radius = int(np.quantile(apart, target, method="higher")) if apart else BITS
    first = cut(ask(index, queries, radius, k, of))
    # Who found too few is asked again over all codes.
    full = first.groupBy("asked").count().where(F.col("count") >= min(k, rows.count() - 1)).select("asked")
    left = cut(asked.join(full, F.col("row") == F.col("asked"), "left_anti"))
    if not left.isEmpty():
        first = first.join(full, "asked", "left_semi").unionByName(ask(index, blocks(left, ASKED, of, "q_block"), BITS, k, of))
    return first.select("query_id", "rank", "vec_id", "score")


def op12(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
