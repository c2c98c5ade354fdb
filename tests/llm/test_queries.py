"""The registered queries themselves, on written tables with odd rows, held against plain loops."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from loomgraph.llm import registry
from loomgraph.llm.tokenize import vocabulary

from .conftest import DOC, doc, sentence
from .test_operators import brute_join, near_corpus

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def tables(spark, odd_docs, tmp_path_factory):
    """A folder whose documents also hold a text above 1 MiB, and characters of two UTF-16 units on line ends."""
    rng = random.Random(5)
    more = [doc(11, sentence(rng, 260_000), "d"), doc(12, "one\n\ntwo three\nlé\U0001f600\n", None), doc(13, "no end\nhere", "c")]
    folder = str(tmp_path_factory.mktemp("tables"))
    odd_docs.unionByName(spark.createDataFrame(more, DOC), allowMissingColumns=True).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("nothing"))
    spark.createDataFrame([], DOC).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def texts(spark, tables):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]


def test_tables_without_rows(spark, nothing):
    for name in ("op2_pack", "op3_token_counts", "op4_ngram_join", "op5_html_extract", "op6_license_scan", "op7_exact_dedup", "op8_media", "op9_shards", "op10_mix_sources"):
        assert QUERIES[name](spark, nothing).count() == 0, name


def test_pack(spark, tables, texts, library):
    ids = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in texts]
    crc = lambda part: zlib.crc32(struct.pack(f"<{len(part)}I", *part))
    rows = QUERIES["op2_pack"](spark, tables).collect()
    of = {i: own for i, own in ids}  # rows that share an id share their text here
    covered, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.doc_tokens == len(of[r.doc_id]) and r.length > 0
        assert r.ids_crc32 == crc(of[r.doc_id][r.start : r.start + r.length])
        covered[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    times = Counter(i for i, _ in ids)
    for i, pieces in covered.items():
        seen = Counter(k for start, length in pieces for k in range(start, start + length))
        assert seen == dict.fromkeys(range(len(of[i])), times[i])
    assert covered.keys() == of.keys()
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    # Rows meet in few windows here, so all but the last sequences are full.
    assert sum(len(own) for _, own in ids) > 0.95 * 1024 * (len(sequences) - 8)


def test_token_counts_of_lines(spark, tables, texts, library):
    want = Counter()
    for i, text in texts:
        text = text or ""
        ends = [k + 1 for k, c in enumerate(text) if c == "\n" and k + 1 < len(text)]
        bounds = [0, *ends, len(text)]
        spans = library.encode(text, add_special_tokens=False).offsets
        per = Counter()
        line = 0
        for a, b in spans:
            while bounds[line + 1] <= a:
                line += 1
            share, k = [], line
            while k < len(bounds) - 1 and bounds[k] < b:
                share.append((min(b, bounds[k + 1]) - max(a, bounds[k]), -k))
                k += 1
            per[-max(share)[1]] += 1
        for k in range(len(bounds) - 1):
            want[i, k, bounds[k], bounds[k + 1], float(per[k]), len(spans)] += 1
    got = Counter((r.doc_id, r.section, r.start, r.end, r.tokens, r.doc_tokens) for r in QUERIES["op3_token_counts"](spark, tables).collect())
    assert got == want


def test_ngram_join(spark, tmp_path):
    rows = near_corpus()
    spark.createDataFrame([doc(i, t) for i, t in rows], DOC).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: (r.class_id, r.links) for r in QUERIES["op4_ngram_join"](spark, str(tmp_path)).collect()} == brute_join(rows)


def test_html(spark, tmp_path):
    story = "The mill by the river had been closed for years before anyone thought to open its doors again."
    pages = {
        1: (f"<html><body><nav><a href=/a>Home</a> <a href=/b>News</a></nav><article><h1>The mill</h1><p>{story}</p>\n<p>{story} Fish &amp; chips&#33;</p></article><footer>All rights</footer></body></html>", f"The mill {story} {story} Fish & chips!"),
        2: (None, ""),
        3: ("", ""),
        4: (f"<body><script>var a = '<p>{story}</p>';</script><style>p{{}}</style><p>{story}</p>", story),
    }
    spark.createDataFrame([(i, f"http://x/{i}", h) for i, (h, _) in pages.items()], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in QUERIES["op5_html_extract"](spark, str(tmp_path)).collect()}
    assert got == {i: (f"http://x/{i}", t, len(t)) for i, (_, t) in pages.items()}


@pytest.mark.parametrize("name", ["op7_exact_dedup", "op10_mix_sources"])
def test_queries_with_sql(spark, tables, name):
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from read_parquet('{tables}/documents.parquet/*.parquet')")
    frame = QUERIES[name](spark, tables)
    columns = sorted(frame.columns)
    want = duck.sql(f"select {', '.join(columns)} from ({SQL[name]})").fetchall()
    assert Counter(map(repr, want)) == Counter(repr(tuple(r)) for r in frame.select(*columns).collect())


def test_media(spark, tables, texts):
    want = Counter()
    for i, text in texts:
        raw = (text or "").encode()
        whole = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want[i, len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:])] += 1
    rows = QUERIES["op8_media"](spark, tables).collect()
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    values = defaultdict(set)
    for r in rows:
        values[r.payload_sha256].add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in values.values()) and len({v for s in values.values() for v in s}) == len(values)


def test_shards(spark, tables, texts):
    raw = [(i, (t or "").encode()) for i, t in texts]
    rows = QUERIES["op9_shards"](spark, tables).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len(b) + 8, zlib.crc32(b)) for i, b in raw)
    assert {r.law for r in rows} == {"bytes"} and all(0 <= r.shard < 24 and r.grown_shard is None for r in rows)
    slots, groups = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        groups[r.size, r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in groups.values())
    # No cut can give a fullest shard below the largest group or the even share.
    size, group = Counter(), Counter()
    for r in rows:
        size[r.shard] += r.size
        group[r.text_crc32] += r.size
    assert max(size.values()) <= max(max(group.values()), sum(size.values()) / 24 + sorted(group.values())[-3])
