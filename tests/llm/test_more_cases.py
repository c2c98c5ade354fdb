"""Repeats of notices, odd sections, fields, contents packed differently, many sources."""

import random
from collections import Counter

import numpy as np
import pytest
import zstandard

from loomgraph.llm import exact_dedup, license_scan, mixing, token_counts
from loomgraph.llm.license_scan import Templates, apart, scan_words
from loomgraph.llm.textvec import Batch, word_spans

SHORT = [("MIT", 0), ("MIT", 1), ("Apache-2.0", 0)]


def hashed(text):
    b = Batch([text])
    return b.hashes(*word_spans(b), fold=True)


@pytest.mark.parametrize(("name", "k"), SHORT)
@pytest.mark.parametrize("times", [1, 2, 5])
def test_a_notice_is_reported_each_time(name, k, times):
    known = Templates(license_scan.TEMPLATES, license_scan.GRAM, license_scan.WINDOW)
    text = license_scan.TEMPLATES[name][k]
    size = len(hashed(text))
    found = scan_words(hashed(" ".join([text] * times)), known, 0.8, license_scan.BAND)
    assert [(f[1], f[2], f[3]) for f in found] == [(i * size, (i + 1) * size, size) for i in range(times)]


def test_a_long_notice_with_words_put_in_is_one_match():
    known = Templates(license_scan.TEMPLATES, license_scan.GRAM, license_scan.WINDOW)
    text = license_scan.TEMPLATES["MIT"][2].split()
    half = len(text) // 2
    words = ["start"] * 5 + text[:half] + [f"page{i}" for i in range(25)] + text[half:] + ["end"] * 5
    found = scan_words(hashed(" ".join(words)), known, 0.8, license_scan.BAND)
    assert len(found) == 1 and found[0][3] == len(hashed(" ".join(text)))


def brute_scan(words, templates, coverage):
    """All stretches against all templates, in full tables."""

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = list(row)
            for j, y in enumerate(b):
                row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
        return row

    found = []
    for t, template in enumerate(templates):
        for a in range(len(words)):
            row = common(template, words[a : a + len(template) + max(2, len(template) // 4)])
            best = max(row)
            b = row.index(best)
            if best >= coverage * len(template) and words[a] in template:
                found.append((t, a, a + b, best))
    return apart(found)


def test_scan_equals_all_stretches():
    rng = random.Random(11)
    names = {f"L{k}": (" ".join(f"t{k}w{i}" for i in range(n)),) for k, n in enumerate((6, 9, 14))}
    known = Templates(names, 3, 2)
    for _ in range(25):
        words = []
        for _ in range(rng.randint(1, 5)):
            words += [f"o{rng.randrange(50)}" for _ in range(rng.choice((0, 1, 4)))]
            notice = rng.choice(list(names.values()))[0].split()
            if len(notice) > 9 and rng.random() < 0.5:
                notice[rng.randrange(4, len(notice) - 4)] = "changed"
            words += notice
        text = " ".join(words)
        got = scan_words(hashed(text), known, 0.8, 8)
        want = brute_scan(hashed(text).tolist(), [w.tolist() for w in known.words], 0.8)
        assert got == want


@pytest.mark.parametrize("times", range(21))
def test_a_notice_with_its_own_words_inside(times):
    """Its first words stand any number of times in its middle, one after the other or apart."""
    known = Templates(license_scan.TEMPLATES, license_scan.GRAM, license_scan.WINDOW)
    text = license_scan.TEMPLATES["MIT"][2].split()
    size, half = len(hashed(" ".join(text))), len(text) // 2
    most = size // 4
    inner = (text[:5] * times)[:most]
    found = scan_words(hashed(" ".join(text[:half] + inner + text[half:])), known, 0.8, license_scan.BAND)
    assert [f[3] for f in found if known.names[f[0]] == "MIT" and f[3] > 20] == [size]
    spread, step = [], max(1, len(text) // (times + 1))
    for k, w in enumerate(text):
        spread += ([*text[:5]] if times and k and k % step == 0 and len(spread) - k < most - 5 else []) + [w]
    found = scan_words(hashed(" ".join(spread)), known, 0.8, license_scan.BAND)
    assert [f[3] for f in found if known.names[f[0]] == "MIT" and f[3] > 20] == [size]


def test_scan_with_repeated_grams_equals_all_stretches():
    """Templates whose grams occur several times in them, and texts made of their pieces."""
    rng = random.Random(4)
    names = {"A": ("a b c d a b c e a b c f g h",), "B": ("x y z x y z w v u t",)}
    known = Templates(names, 3, 2)
    for _ in range(60):
        words = []
        for _ in range(rng.randint(1, 3)):
            notice = rng.choice(list(names.values()))[0].split()
            at = rng.randrange(3, len(notice) - 3)
            inner = notice[:3] if rng.random() < 0.6 else []
            words += [f"o{rng.randrange(50)}" for _ in range(rng.choice((0, 4, 8)))] + notice[:at] + inner[: max(2, len(notice) // 4)] + notice[at:]
        text = hashed(" ".join(words))
        got = scan_words(text, known, 0.8, 8)
        want = brute_scan(text.tolist(), [w.tolist() for w in known.words], 0.8)
        # The same notices with as many words; where one begins may differ by words that stand twice.
        assert sorted((t, n) for t, _, _, n in got) == sorted((t, n) for t, _, _, n in want)


def test_many_hits_take_little_time():
    import time

    known = Templates(license_scan.TEMPLATES, license_scan.GRAM, license_scan.WINDOW)
    words = hashed(" ".join(license_scan.TEMPLATES["MIT"][2].split()[:7] * 8000))
    began = time.perf_counter()
    scan_words(words, known, 0.8, license_scan.BAND)
    assert time.perf_counter() - began < 20


def test_sections_that_cannot_be(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, None)], "doc_id long, text string")
    rows = [(1, 0, 0, 7), (1, 1, 4, 13), (1, 2, None, 5), (1, 3, 9, 2), (1, 4, 13, 99), (2, 0, 0, 5), (1, None, -5, -1)]
    sections = spark.createDataFrame(rows, "doc_id long, section long, start long, end long")
    got = {(r.doc_id, r.section): (r.start, r.end, r.tokens) for r in token_counts.attribute(docs, sections).collect()}
    assert got[1, 1][:2] == (7, 13) and got[1, 2] == (None, 5, 0.0) and got[1, 3] == (9, 2, 0.0)
    assert got[1, 4][:2] == (13, 18) and got[2, 0] == (0, 0, 0.0) and got[1, None] == (0, 0, 0.0)
    total = token_counts.attribute(docs, None).where("doc_id = 1").agg({"tokens": "sum"}).first()[0]
    assert sum(v[2] for k, v in got.items() if k[0] == 1) == total


def test_fields_are_sections(spark):
    docs = spark.createDataFrame([(1, "A head", "and a body of text", "clash"), (2, None, "only a body", None), (3, "", "", None)], "doc_id long, title string, body string, text string")
    got = {(r.doc_id, r.section): r.tokens for r in token_counts.attribute_fields(docs, ["title", "body"]).collect()}
    alone = {r.doc_id: r.tokens for r in token_counts.attribute(docs.selectExpr("doc_id", "body as text")).collect()}
    assert got[1, 1] in (alone[1], alone[1] + 1) and got[1, 0] >= 2 and got[2, 0] == 0 and got[3, 1] == 0


def test_contents_packed_differently_are_equal():
    content = b"the same content in two frames " * 20
    a, b = zstandard.ZstdCompressor(level=1).compress(content), zstandard.ZstdCompressor(level=19, write_checksum=True).compress(content)
    assert a != b
    table = exact_dedup.GraceTable()
    table.add(b"d" * 32, a, (5, 1, 0), 1, 0)
    table.add(b"d" * 32, b, (6, 2, 1), 1, 1)
    table.add(b"d" * 32, zstandard.ZstdCompressor().compress(b"other"), (1, 3, 2), 1, 2)
    groups = sorted((g[3], g[2][1], g[4]) for g in table.groups())
    assert groups == [(1, 3, [2]), (2, 2, [0, 1])]


def test_portions_give_the_same_groups(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a b", "ab", "c", "", None, "long " * 50])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    small = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        got = Counter(map(tuple, exact_dedup.dedup(docs, portion=25).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", small)
    assert got == Counter(map(tuple, exact_dedup.dedup(docs).collect())) and len(got) == 200


def test_targets_of_many_sources_equal_a_loop(spark):
    rng = random.Random(3)
    sizes = {f"host{i}": rng.choice((0, 1, 5, 100, 10_000)) for i in range(60)} | {None: 77}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(frame).collect()}
    order = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_ = {s: 0.0 for s in order}, set(order)
    left = float(sum(sizes.values()))
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 3 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / w for s in open_}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(3.0 * sizes[s] for s in over)
        open_ -= over
    assert got.keys() == target.keys() and all(np.isclose(got[s], target[s]) for s in got)
