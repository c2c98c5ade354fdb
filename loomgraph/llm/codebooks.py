"""Codes for vectors: product quantization with codebooks from Yinyang Lloyd.

A vector's components become integers, and each of its parts is coded by the
nearest entry of that part's codebook. Lloyd's rounds are the Yinyang kind:
the entries of a codebook are clustered into groups once; each row keeps, for
each of its parts, an upper bound of the distance to its own entry and one
lower bound per group of the distance to all others in it. When entries move,
bounds are adjusted by the drift, and only groups whose lower bound does not
stay above the upper one are scanned. Bounds are floats with a margin, so a
group that may hold a tie is always scanned; what is scanned is compared by
integer distances, ties going to the lower index. The codes are therefore
those of plain Lloyd.

Rows stay in their partitions: a round maps them, and sums per entry, added up
inside each task first, are all that is shuffled. Codebooks, bounded by
parts x entries, are all that the driver sees.

Defined results: rows are dropped whose vector is null, empty or holds null or
non-finite components, whose length is not that of the row with the smallest
id, or holds a component of 2**17 or more, whose errors would not fit a long.
Null ids sort last, rows of one id by their vectors. Where the length is no
multiple of the parts, the first parts are longer by one. With fewer rows than
entries there are as many entries as rows. Repeated rows count each; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded, cut
from .vectors import matrix, sound

SCALE = 1024
LARGEST = 2.0**17
PER_GROUP = 16  # entries for which there is a group
SLICE = 2048  # rows taken together
MARGIN = 1e-5  # of a bound, far above what rounding adds over all rounds
EXACT = 1 << 23  # below it, sums of products are exact as doubles


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of whole numbers, exact."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < EXACT and x.shape[1] <= 16:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None]


def grouped(entries: np.ndarray, rounds: int = 5) -> np.ndarray:
    """A group for each entry, by a few rounds of clustering that start from evenly spaced entries."""
    count = max(1, len(entries) // PER_GROUP)
    seeds = entries[np.linspace(0, len(entries) - 1, count).astype(int)].astype(np.float64)
    for _ in range(rounds):
        own = ((entries[:, None] - seeds[None]) ** 2).sum(2).argmin(1)
        for g in range(count):
            if (own == g).any():
                seeds[g] = entries[own == g].mean(0)
    return np.unique(own, return_inverse=True)[1]


@dataclass
class Codebook:
    """One part's entries, their groups, and how far each moved in the last round."""

    entries: np.ndarray
    group: np.ndarray
    drift: np.ndarray

    @property
    def groups(self) -> int:
        return int(self.group.max()) + 1

    def start(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Entries for the rows of ``x``, their squared distances, and the bounds."""
        d = squared(x, self.entries)
        own = d.argmin(1)
        best = d[np.arange(len(x)), own]
        return own, best, np.sqrt(best), self.lower(d, own, np.arange(self.groups))

    def lower(self, d: np.ndarray, own: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Least distance in each of the groups ``which``, the own entry aside; ``d`` has all entries."""
        other = d.astype(np.float64)
        other[np.arange(len(d)), own] = np.inf
        return np.sqrt(np.stack([other[:, self.group == g].min(1) for g in which], 1)) if len(which) else np.empty((len(d), 0))

    def again(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """As ``start``, from the bounds of the round before; also how many (row, group) were scanned."""
        most = np.array([self.drift[self.group == g].max() for g in range(self.groups)])
        own, low, upper = own.copy(), low - most, upper + self.drift[own]
        apart = x - self.entries[own]
        best = (apart * apart).sum(1)
        open_rows = np.flatnonzero(low.min(1) <= upper * (1 + MARGIN) + MARGIN)
        upper = np.sqrt(best)
        # The exact distance is the tighter bound.
        need = low[open_rows] <= (upper[open_rows] * (1 + MARGIN) + MARGIN)[:, None]
        had, first = own.copy(), best.copy()
        seen: list[tuple[int, np.ndarray, np.ndarray]] = []
        for g in range(self.groups):
            rows = open_rows[need[:, g]]
            if not len(rows):
                continue
            members = np.flatnonzero(self.group == g)
            d = squared(x[rows], self.entries[members])
            at = d.argmin(1)
            least, entry = d[np.arange(len(rows)), at], members[at]
            better = (least < best[rows]) | ((least == best[rows]) & (entry < own[rows]))
            best[rows[better]], own[rows[better]] = least[better], entry[better]
            seen.append((g, rows, d))
        moved = np.flatnonzero(own != had)
        left = self.group[had[moved]]
        low[moved, left] = np.minimum(low[moved, left], np.sqrt(first[moved]))
        for g, rows, d in seen:
            other = np.where(np.flatnonzero(self.group == g)[None] == own[rows][:, None], np.inf, d)
            low[rows, g] = np.sqrt(other.min(1))
        return own, best, np.sqrt(best), low, int(need.sum())

    def moved(self, sums: dict[int, tuple[list, int]]) -> Codebook:
        """The entries replaced by the floors of their means."""
        now = self.entries.copy()
        for k, (total, n) in sums.items():
            now[k] = [int(t) // n for t in total]
        apart = (now - self.entries).astype(np.float64)
        return Codebook(now, self.group, np.sqrt((apart * apart).sum(1)))


def bounds_of(dim: int, parts: int) -> list[tuple[int, int]]:
    edges = np.cumsum([0, *(len(x) for x in np.array_split(np.arange(dim), parts))])
    return [(int(a), int(b)) for a, b in zip(edges, edges[1:], strict=False)]


def assign(rows: DataFrame, books: list[Codebook], spans: list[tuple[int, int]], dim: int) -> DataFrame:
    """``rows`` with codes, errors and bounds by ``books``; the bounds of the round before are used where there are any."""
    width = [b.groups for b in books]
    old = "own" in rows.columns

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, SLICE) for b in batches for a in range(0, b.num_rows, SLICE)):
            n = batch.num_rows
            if not n:
                continue
            x = np.frombuffer(b"".join(batch.column("v").to_pylist()), np.int64).reshape(n, dim)
            error = np.zeros(n, np.int64)
            owns, uppers, lows = [], [], []
            if old:
                had = np.frombuffer(b"".join(batch.column("own").to_pylist()), np.uint16).reshape(n, -1)
                bound = np.frombuffer(b"".join(batch.column("bounds").to_pylist()), np.float32).reshape(n, -1).astype(np.float64)
            at = 0
            for p, (book, (a, b)) in enumerate(zip(books, spans, strict=True)):
                part, g = np.ascontiguousarray(x[:, a:b]), width[p]
                if old:
                    own, best, upper, low, _ = book.again(part, had[:, p].astype(np.int64), bound[:, at], bound[:, at + 1 : at + 1 + g])
                else:
                    own, best, upper, low = book.start(part)
                at += 1 + g
                error += best
                owns.append(own.astype(np.uint16))
                uppers.append(upper)
                lows.append(low)
            # Rounded outwards, so that they stay bounds.
            outwards = lambda m, to: np.nextafter(m.astype(np.float32), np.float32(to))
            bound = np.concatenate([np.concatenate([outwards(u[:, None], np.inf), outwards(low, -np.inf)], 1) for u, low in zip(uppers, lows, strict=True)], 1)
            own = np.stack(owns, 1)
            as_bytes = lambda m: pa.array([r.tobytes() for r in np.ascontiguousarray(m)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("v"), as_bytes(own), pa.array(error), as_bytes(bound)], ["vec_id", "label", "v", "own", "error", "bounds"])

    kind = dict(rows.dtypes)
    return rows.mapInArrow(mapped, f"vec_id {kind['vec_id']}, label {kind['label']}, v binary, own binary, error long, bounds binary")


def entry_sums(rows: DataFrame, spans: list[tuple[int, int]], dim: int) -> list[dict[int, tuple[list, int]]]:
    """For each part and used entry, the sums of its parts' components and their number."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64).reshape(n, dim)
            own = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(n, -1)
            for p, (a, b) in enumerate(spans):
                used, inverse, counts = np.unique(own[:, p], return_inverse=True, return_counts=True)
                total = np.zeros((len(used), b - a), np.int64)
                np.add.at(total, inverse, x[:, a:b])
                for k, t, c in zip(used.tolist(), total, counts.tolist(), strict=True):
                    have = held.setdefault((p, k), [np.zeros(b - a, np.int64), 0])
                    have[0], have[1] = have[0] + t, have[1] + c
        keys = list(held)
        columns = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([held[k][0].tolist() for k in keys], pa.list_(pa.int64())), pa.array([held[k][1] for k in keys], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "total", "n"])

    each = rows.select("v", "own").mapInArrow(partial, "part int, entry int, total array<long>, n long")
    widest = max(b - a for a, b in spans)
    # Whole numbers of any size: a sum over all rows may not fit a long.
    summed = each.groupBy("part", "entry").agg(F.array(*[F.sum(F.get("total", F.lit(i)).cast("decimal(38,0)")) for i in range(widest)]).alias("total"), F.sum("n").alias("n"))
    out: list[dict[int, tuple[list, int]]] = [{} for _ in spans]
    for r in summed.collect():
        a, b = spans[r.part]
        out[r.part][r.entry] = (r.total[: b - a], r.n)
    return out


def compress(
    embeddings: DataFrame,
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows with codes and errors, (vec_id, label, own, error), where ``own`` has 16 bits a part; and the final codebooks."""
    vector = F.col(vector_col).cast("array<double>")
    rows = embeddings.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), vector.alias("x"))
    rows = rows.where(sound(F.col("x"))).where(~F.exists("x", lambda c: F.abs(c) >= LARGEST))
    order = [F.col("vec_id").asc_nulls_last(), F.col("x")]
    first = rows.orderBy(*order).first()
    if first is None:
        return rows.select("vec_id", "label", F.lit(b"").alias("own"), F.lit(0).cast("long").alias("error")), []
    dim = len(first.x)
    rows = rows.where(F.size("x") == dim)
    spans = bounds_of(dim, parts)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.floor(SCALE * matrix(batch.column("x"), dim)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([r.tobytes() for r in v], pa.binary())], ["vec_id", "label", "v"])

    kind = dict(rows.dtypes)
    heads = np.floor(SCALE * np.array([r.x for r in rows.orderBy(*order).limit(entries).collect()])).astype(np.int64)
    books = [Codebook(c, grouped(c), np.zeros(len(c))) for c in (heads[:, a:b] for a, b in spans)]
    now = rows.mapInArrow(whole, f"vec_id {kind['vec_id']}, label {kind['label']}, v binary")
    for _ in range(rounds):
        now = cut(assign(now, books, spans, dim))
        books = [book.moved(sums) for book, sums in zip(books, entry_sums(now, spans, dim), strict=True)]
    now = cut(assign(now, books, spans, dim).select("vec_id", "label", "own", "error"))
    return now, [b.entries for b in books]


def op13(spark, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = hashlib.sha256(",".join(str(v) for book in books for entry in book.tolist() for v in entry).encode()).hexdigest()
    totals = bounded(cut(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")).withColumnRenamed("label", "_label")))
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("_label")))
    # The low byte of each 16 bits is the index.
    code = F.lower(F.concat(*[F.hex(F.substring("own", 2 * p + 1, 1)) for p in range(4)]))
    return joined.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Plain Lloyd over all entries, in SQL."""
    near = lambda c: (
        f"select r, p, arg_min(k, (d, k)) as k, min(d) as d from (select x.r, x.p, k, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i]))) as d"
        f" from x join {c} c on x.p = c.p) group by r, p"
    )
    with_ = [
        "kept as (select row_number() over (order by vec_id nulls last) as r, vec_id, label, list_transform(embedding, lambda e: cast(floor(1024 * cast(e as double)) as bigint)) as v from embeddings"
        " where len(embedding) > 0 and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0)",
        f"x as materialized (select r, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] as v from kept, range({parts}) t(p))",
        f"c0 as materialized (select p, r - 1 as k, v from x where r <= {entries})",
    ]
    for n in range(rounds):
        with_ += [
            f"a{n} as materialized ({near(f'c{n}')})",
            f"m{n} as (select p, k, i, cast(floor((s - ((s % n) + n) % n) / n) as bigint) as v from (select p, k, i, cast(sum(e) as bigint) as s, count(*) as n from (select a.p, a.k, unnest(range(1, len(v) + 1)) as i, unnest(v) as e from a{n} a join x using (r, p)) group by p, k, i))",
            f"c{n + 1} as materialized (select c.p, c.k, coalesce(m.v, c.v) as v from c{n} c left join (select p, k, list(v order by i) as v from m{n} group by p, k) m using (p, k))",
        ]
    return (
        "with " + ",\n".join(with_) + f",\nlast as materialized ({near(f'c{rounds}')}),\n"
        "coded as (select r, string_agg(lower(printf('%02x', k)), '' order by p) as code, cast(sum(d) as bigint) as error from last group by r)\n"
        f"select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, (select sha256(string_agg(array_to_string(v, ','), ',' order by p, k)) from c{rounds}) as codebooks_sha256 from kept join coded using (r)"
    )


OP13_SQL = _sql()
