"""Codebooks against plain Lloyd in whole numbers, and nearest vectors against all cosines."""

import hashlib
import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from loomgraph.llm import codebooks, neighbours, registry

VEC = "vec_id long, embedding array<float>, label int"
ODD = [
    (None, [0.5, 0.25, -0.125, 1.0, 0.0, 0.0, 0.75, -1.0], None),
    (900, None, 1),
    (901, [], 1),
    (902, [0.5, None, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6], 1),
    (903, [float("nan")] + [0.1] * 7, 1),
    (904, [float("inf")] + [0.1] * 7, 1),
    (905, [0.0] * 8, 2),
    (950, [0.1, 0.2], 2),
]


def vectors(rng, n, copies=0):
    rows = [(int(i), [float(np.float32(x)) for x in rng.standard_normal(8)], int(i) % 3 if i % 5 else None) for i in range(n)]
    return rows + [(5000 + i, rows[7][1], 1) for i in range(copies)] + [rows[3], rows[3]]


def written(spark, rows, folder):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, VEC).withColumn("row", F.lit("x")).withColumn("score", F.lit(1)).withColumn("v", F.lit(2))
    frame.repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def brute_codes(rows, entries=256, rounds=4, parts=4):
    good = [r for r in rows if r[1] and len(r[1]) == 8 and all(x is not None and math.isfinite(x) for x in r[1])]
    good.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    x = [[math.floor(1024 * e) for e in r[1]] for r in good]
    books = [[v[2 * p : 2 * p + 2] for v in x[:entries]] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for v in x:
                own[nearest(v[2 * p : 2 * p + 2], books[p])[1]].append(v[2 * p : 2 * p + 2])
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if own[k] else e for k, e in enumerate(books[p])]
    coded = []
    for r, v in zip(good, x, strict=True):
        found = [nearest(v[2 * p : 2 * p + 2], books[p]) for p in range(parts)]
        coded.append((r[0], r[2], "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    totals = defaultdict(int)
    for _, label, _, error in coded:
        totals[label] += error
    digest = hashlib.sha256(",".join(str(e) for book in books for c in book for e in c).encode()).hexdigest()
    return sorted((repr(i), code, error, totals[label], digest) for i, label, code, error in coded)


@pytest.mark.parametrize("n", [600, 40])
def test_codes_are_those_of_plain_lloyd(spark, tmp_path, n):
    rows = vectors(np.random.default_rng(n), n, copies=50) + ODD
    folder = written(spark, rows, tmp_path)
    got = registry.queries()["op13_codebooks"](spark, folder).collect()
    plain = sorted((repr(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got)
    assert plain == brute_codes(rows)
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from read_parquet('{folder}/embeddings.parquet/*.parquet') where len(embedding) <> 2")
    assert sorted((repr(r[0]), *r[1:]) for r in c.execute(registry.oracle_sql()["op13_codebooks"]).fetchall()) == plain


def test_groups_are_skipped_and_ties_go_to_the_lower_entry():
    rng = np.random.default_rng(2)
    x = rng.integers(-40, 40, (4000, 4)) + 900 * rng.integers(0, 6, (4000, 1))
    book = codebooks.Codebook(x[:64].copy(), codebooks.grouped(x[:64]), np.zeros(64))
    own, best, upper, low = book.start(x)
    scanned = []
    for _ in range(6):
        book = book.moved({k: (x[own == k].sum(0).tolist(), int((own == k).sum())) for k in set(own.tolist())})
        own, best, upper, low, n = book.again(x, own, upper, low)
        d = codebooks.squared(x, book.entries)
        assert (own == d.argmin(1)).all() and (best == d.min(1)).all()
        for g in range(book.groups):
            other = np.where((book.group == g)[None] & (np.arange(64)[None] != own[:, None]), d, np.iinfo(np.int64).max).min(1)
            assert (low[:, g] <= np.sqrt(other) + 1e-6).all()
        scanned.append(n)
    assert scanned[-1] < 0.5 * len(x) * book.groups


def test_whole_numbers_too_large_for_doubles():
    x = np.array([[2**26, -(2**26), 5], [2**26 - 1, 3, 2**26]])
    assert codebooks.squared(x, x[::-1]).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)) for q in x[::-1]] for p in x]


def brute_nearest(rows, every=50, k=5):
    good = [r for r in rows if r[1] and len(r[1]) == 8 and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    x = np.array([r[1] for r in good])
    u = x / np.sqrt((x * x).sum(1))[:, None]
    out = []
    for i, r in enumerate(good):
        if r[0] is not None and r[0] % every == 0:
            scores = (u * u[i]).sum(1)
            others = sorted((j for j in range(len(good)) if j != i), key=lambda j: (-round(scores[j], 12), good[j][0] is None, good[j][0]))
            out.append((r[0], [(good[j][0], scores[j]) for j in others[:k]]))
    return out


@pytest.mark.parametrize("block", [100, 16_384])
def test_nearest_vectors(spark, tmp_path, block):
    rows = vectors(np.random.default_rng(5), 1500, copies=300) + ODD
    folder = written(spark, rows, tmp_path)
    got = defaultdict(dict)
    for r in neighbours.search(spark.read.parquet(f"{folder}/embeddings.parquet"), block=block).collect():
        assert r.rank not in got[r.query_id]
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    want = brute_nearest(rows)
    assert set(got) == {q for q, _ in want} and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    hits = 0
    for q, best in want:
        own = [got[q][n] for n in range(1, 6)]
        assert [s for _, s in own] == sorted((s for _, s in own), reverse=True)
        hits += len({i for i, _ in own} & {i for i, _ in best})
        for i, s in own:
            assert abs(s - dict(best).get(i, s)) < 1e-12
    assert hits >= 0.95 * 5 * len(want)
    # A query among the copies finds copies, those with the smallest ids.
    assert [got[5050][n][0] for n in range(1, 6)] == [7, 5000, 5001, 5002, 5003]


def test_few_candidates_and_none(spark, tmp_path):
    rows = [(0, [1.0, 0.0, 0.0], 1), (1, [2.0, 0.0, 0.0], 1), (50, [-1.0, 0.0, 0.0], 1)]
    frame = spark.createDataFrame(rows, VEC)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.search(frame).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 50, -1.0), (50, 1, 0, -1.0), (50, 2, 1, -1.0)]
    assert neighbours.search(frame.where("vec_id = 0")).count() == 0 == neighbours.search(frame.where("vec_id = 1")).count()
    assert neighbours.search(frame.limit(0)).count() == 0
    coded, books = codebooks.compress(frame.limit(0))
    assert coded.count() == 0 and books == []
    frame.limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("op12_neighbours", "op13_codebooks"):
        assert registry.queries()[name](spark, str(tmp_path)).count() == 0


def test_huge_and_tiny_components(spark):
    rows = [(0, [1e300, 1e300], 1), (1, [1e-300, 0.0], 1), (2, [5e-324, 5e-324], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.score for r in neighbours.search(frame).collect()}
    assert abs(got[1] - math.sqrt(0.5)) < 1e-12 and abs(got[2] - 1) < 1e-12


def test_every_code_within_the_radius_is_found():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 1 << 16, (800, 4), dtype=np.uint16)
    codes[400:] = codes[rng.integers(0, 400, 400)] ^ (1 << rng.integers(0, 16, (400, 4))).astype(np.uint16)
    index = neighbours.Index(codes)
    for radius in (0, 1, 2, 3, 4, 7, 20, 64):
        for code in codes[::97]:
            apart = np.bitwise_count(codes ^ code).sum(1)
            assert index.within(code, radius).tolist() == np.flatnonzero(apart <= radius).tolist()
    assert all(sum(s + 1 for s in neighbours.shares(r, m)) == r + 1 for r in range(40) for m in range(1, 9) if r >= m - 1)
