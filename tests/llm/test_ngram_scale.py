"""The n-gram join where groups are large: hot buckets, blocks by size and by bytes, a join in place of the filter."""

import random

import pyarrow.parquet as pq
import pytest

from loomgraph.llm import ngram_join as nj


def brute(rows, n=5, t=(4, 5)):
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    at = {}
    for i, s in enumerate(sets):
        for g in s:
            at.setdefault(g, []).append(i)
    links = [set() for _ in rows]
    for i, s in enumerate(sets):
        seen = {}
        for g in s:
            for j in at[g]:
                seen[j] = seen.get(j, 0) + 1
        for j, both in seen.items():
            if j != i and both * t[1] >= t[0] * (len(s) + len(sets[j]) - both):
                links[i].add(j)
        if not s:
            links[i] = {j for j, o in enumerate(sets) if not o and j != i}
    root = list(range(len(rows)))
    for i in range(len(rows)):
        stack, seen = [i], {i}
        while stack:
            for j in links[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        root[i] = min(rows[k][0] for k in seen)
    return {rows[i][0]: (root[i], len(links[i])) for i in range(len(rows))}


def near_group(copies: int, words: int = 60, seed: int = 3):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(copies):
        text = list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            text[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(text))
    return out


@pytest.fixture(scope="module")
def rows():
    texts = near_group(90) + near_group(40, 30, 4) + ["a lone text of its own that nothing else is like"] * 2 + [None, "", "few words"]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("most", [4, 10_000])
def test_hot_buckets_equal_brute_force(spark, rows, most):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.links) for r in nj.ngram_join(docs, most=most, block=16).collect()}
    assert got == brute(rows)


def test_blocks_by_bytes_and_without_the_filter(spark, rows, monkeypatch):
    monkeypatch.setattr(nj, "UNIT_BYTES", 4096)
    monkeypatch.setattr(nj, "FILTER_MOST", 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.links) for r in nj.ngram_join(docs).collect()}
    assert got == brute(rows)


def test_whole_table_equals_brute_force(spark):
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = [(r["doc_id"], r["text"]) for r in table]
    got = {r.doc_id: (r.class_id, r.links) for r in nj.op4(spark, "/root/testdata/sf0.01").collect()}
    assert got == brute(rows)
