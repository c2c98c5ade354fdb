import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import exact_dedup, gru, html_extract, jpeg, license_scan, media, mixing, ngram_join, packing, sharding, token_counts, toxicity
from loomgraph.llm.textvec import Batch
from loomgraph.llm.tokenize import encoder, segments, vocabulary

from .conftest import DOC, doc, sentence


@pytest.fixture(scope="session")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    return t


ODD = ["", "don't we'll 's  x\n\n y", "a　b  c", "  lead", "tail  ", "\n\n", "'re''s 'll", "l'été ½ ² 一二 \U0001f600!", "<|endoftext|>", "a'", "'", "\t\tfoo", " 's", "x\x85y \x1c z"]


def test_tokens_are_those_of_the_library(tokenizer):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choices("ab 's\n\t.1é一,　'", k=rng.randint(0, 60))) for _ in range(300)]
    ids, off = encoder(vocabulary()).encode(texts)
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t
        own, a, b, _ = encoder(vocabulary()).encode_spans([t])
        assert list(zip(a.tolist(), b.tolist(), strict=True)) == tokenizer.encode(t, add_special_tokens=False).offsets, t


def test_segments_keep_the_tokens():
    text = sentence(random.Random(3), 3000)
    parts = segments(text, 1000)
    assert len(parts) > 5 and "".join(parts) == text
    ids = lambda ts: encoder(vocabulary()).encode(ts)[0].tolist()
    assert ids(parts) == ids([text])


def test_packing(spark, odd_docs, no_docs, tokenizer):
    got = packing.pack(odd_docs, windows=2).toPandas()
    texts = [r.text or "" for r in odd_docs.collect()]
    ids = [np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4") for t in texts]
    assert got["length"].sum() == sum(map(len, ids))
    want = Counter()
    for t in ids:
        for s in range(0, len(t), 1024):
            want[s, zlib.crc32(t[s : s + 1024].tobytes()), len(t)] += 1
    assert Counter(zip(got.start, got.ids_crc32, got.doc_tokens, strict=True)) == want
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq.length.sum() <= 1024 and seq.offset.tolist() == [0, *seq.length.cumsum().tolist()[:-1]]
    assert packing.pack(no_docs).count() == 0


def test_windows_place_best_fit_and_emit_the_fullest():
    out = []
    w = packing.Windows(10, 2, out.append)
    for name, size in (("a", 6), ("b", 7), ("c", 3), ("d", 8), ("e", 9)):
        w.place(size, [name])
    assert out == [["b", "c"], ["d"]] and sorted(w.rest()) == [["a"], ["e"]]


def test_token_counts(spark, odd_docs, no_docs, tokenizer):
    got = token_counts.attribute(odd_docs).toPandas()
    total = sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in odd_docs.collect())
    assert got.tokens.sum() == total
    docs = spark.createDataFrame([doc(1, "hello wonderful world")], DOC)
    spans = tokenizer.encode("hello wonderful world", add_special_tokens=False).offsets
    sections = spark.createDataFrame([(1, 0, 0, 8), (1, 1, 8, 15)], "doc_id long, section long, start long, end long")
    for rule in token_counts.RULES:
        out = {r.section: r.tokens for r in token_counts.attribute(docs, sections, rule).collect()}
        want = defaultdict(float, {0: 0.0, 1: 0.0})
        for a, b in spans:
            share = {s: max(0, min(b, y) - max(a, x)) for s, (x, y) in enumerate(((0, 8), (8, 15)))}
            if rule == "share":
                for s, n in share.items():
                    want[s] += n / (b - a)
                want[-1] += 1 - sum(share.values()) / (b - a)
            elif rule == "most":
                want[max(share, key=lambda s: (share[s], -s)) if any(share.values()) else -1] += 1
            else:
                want[0 if a < 8 else 1 if a < 15 else -1] += 1
        assert out == pytest.approx({s: n for s, n in want.items() if n > 1e-9 or s >= 0})
    assert token_counts.attribute(no_docs).count() == 0


def brute_join(rows):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for i, t in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for i, w in words.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    count = Counter()
    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) > 0):
                count[a] += 1
                count[b] += 1
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (find(i), count[i]) for i in sets}


def near_corpus():
    rng = random.Random(7)
    rows = []
    for _ in range(12):
        base = sentence(rng, rng.randint(4, 160)).split()
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = sentence(rng, 1)
            rows.append((len(rows), " ".join(w)))
    return [*rows, (len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, "a b")]


@pytest.mark.parametrize("block", [1024, 4])
def test_ngram_join_equals_brute_force(spark, block):
    rows = near_corpus()
    docs = spark.createDataFrame([doc(i, t) for i, t in rows], DOC).repartition(3)
    got = {r.doc_id: (r.class_id, r.links) for r in ngram_join.ngram_join(docs, block=block).collect()}
    assert got == brute_join(rows)


def test_ngram_join_takes_odd_rows(odd_docs, no_docs):
    rows = ngram_join.ngram_join(odd_docs).collect()
    assert len(rows) == 12 and {r.class_id for r in rows if r.doc_id in (5, 6, 7)} == {5}
    assert ngram_join.ngram_join(no_docs).count() == 0


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>no</title><script>var a="<p>no</p>"</script></head><body><nav><a href=x>no</a></nav>
      <div class="cookie-banner">no no no</div><article><header><h1>Head &amp; line</h1></header><p>First   par <b>bo</b>ld.<br>Next
      <p class="ad">no advert<p>Last&nbsp;one.<form><input><button>no</button></form><div class="comments"><p>no comment of a reader at all</p></div></article><footer>no</footer>"""
    assert html_extract.extract(page) == "Head & line First par bold. Next Last one."
    assert html_extract.extract('<div class="content has-sidebar"><p>Main words here.</p></div><div class="left sidebar-2"><p>no</p></div>') == "Main words here."
    assert [html_extract.extract(x) for x in (None, "", "<p></p>", "plain words", "<nav>menu</nav>")] == ["", "", "", "plain words", ""]
    for labelled in html_extract.LABELLED:
        main = re.search(r"<!--\[-->(.*)<!--\]-->", labelled, re.S)[1]
        want = " ".join(re.sub(r"<[^>]*>", " ", re.sub(r"</?[ab]\b[^>]*>", "", main)).split())
        assert html_extract.extract(labelled) == want
    pages = spark.createDataFrame([(1, "u", page, "clash"), (None, None, None, None)], "page_id long, url string, html string, text string")
    assert {r.page_id: r.text for r in html_extract.extract_pages(pages).collect()} == {1: "Head & line First par bold. Next Last one.", None: ""}
    assert html_extract.best_run([-1, 2, -1, 3, -5, 4]) in ((1, 4), (5, 6)) and html_extract.best_run([-1.0]) == (0, 0)
    html_extract.extract("<a " * 3000 + '"' * 3000)


def test_licences(spark, odd_docs, no_docs):
    mit = license_scan.TEMPLATES["MIT"][2]
    changed = mit.replace("free of charge", "without any fee").replace("\n", " ")
    text = "Some words first. " + changed + " And then more.\nReleased under the MIT License."
    docs = spark.createDataFrame([doc(1, text), doc(2, "the quick brown fox is released under the table")], DOC)
    got = sorted(license_scan.scan(docs).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.license, r.template) for r in got] == [(1, "MIT", 2), (1, "MIT", 0)]
    assert got[0].matched_text.startswith("Permission is hereby granted") and got[0].coverage > 0.95
    assert text[got[1].start : got[1].end] == "Released under the MIT License"
    assert license_scan.scan(odd_docs).count() == 0 == license_scan.scan(no_docs).count()


def test_alignment_equals_the_full_table():
    rng = np.random.default_rng(1)
    for _ in range(40):
        a, b = rng.integers(0, 4, rng.integers(1, 12)).astype(np.uint64), rng.integers(0, 4, rng.integers(1, 15)).astype(np.uint64)
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert license_scan.align(a, b, 0, 20)[0] == table[-1, -1]


def brute_dedup(rows):
    groups = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, n, i))
    out = Counter()
    for plain, own in groups.items():
        for m, x in enumerate(sorted(own)):
            out[x[4], min(own)[4], len(own), m == 0, hashlib.sha256(plain.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("memory", [1 << 26, 2000])
def test_exact_dedup_equals_brute_force(spark, odd_docs, no_docs, memory):
    rng = random.Random(4)
    texts = [sentence(rng, rng.randint(0, 30)) for _ in range(40)]
    rows = [(i, rng.choice(texts).replace(" ", rng.choice([" ", "\n", "  "]))) for i in range(300)]
    docs = spark.createDataFrame([doc(i, t) for i, t in rows], DOC).repartition(4)
    assert Counter(map(tuple, exact_dedup.dedup(docs, memory=memory).collect())) == brute_dedup(rows)
    odd = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = Counter(tuple(r) for r in exact_dedup.dedup(odd_docs, memory=memory).collect())
    assert got == brute_dedup(odd)
    assert exact_dedup.dedup(no_docs).count() == 0


def test_jpeg_round_trip_and_another_decoder(spark):
    rng = np.random.default_rng(0)
    for trial in range(12):
        sampling = ((2, 2), (1, 1), (1, 1)) if trial % 3 else ((1, 1), (1, 1), (1, 1))
        frames, at = [], 0
        for _ in range(3):
            frames.append(jpeg.Frame(16 * int(rng.integers(1, 8)), 16 * int(rng.integers(1, 8)), sampling))
            at = frames[-1].place(at)
        amplitude = (2, 4, 128)[trial % 3]
        coefs = (rng.integers(-amplitude, amplitude, (at, 64)) * (rng.random((at, 64)) < (0.02, 0.3, 1)[trial // 4])).astype(np.int32)
        files = jpeg.encode(frames, coefs, [b"note"] * 3)
        read, got, notes, _ = jpeg.decode(files)
        assert (got == coefs).all() and notes == [b"note"] * 3
        # The JVM's own reader agrees up to its rounding and its chroma filter.
        jvm = spark.sparkContext._jvm
        if trial in (4, 3):
            image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(files[0])))
            own = jpeg.rgb(read[0], got)
            flat = np.array(list(image.getRGB(0, 0, image.getWidth(), image.getHeight(), None, 0, image.getWidth())), np.int64) & 0xFFFFFF
            theirs = np.stack([flat >> 16, flat >> 8 & 255, flat & 255], axis=1).reshape(own.shape)
            assert np.abs(theirs - own).mean() < (2 if trial == 3 else 12)


def test_media(spark, odd_docs, no_docs):
    got = media.decode_media(media.encode_media(odd_docs.select("doc_id", "text", "key"))).toPandas()
    want = Counter((r.text or "").encode() for r in odd_docs.collect())
    assert Counter(p[:n] for p, n in zip(got.payload, got.n_bytes, strict=True)) == want
    assert all(len(p) % 64 == 0 and len(p) > 0 and not p[n:].strip(b"\0") for p, n in zip(got.payload, got.n_bytes, strict=True))
    assert all(len(t) == sum(s["height"] * s["width"] * 3 for s in shapes) for t, shapes in zip(got.tensor, got.shapes, strict=True))
    assert got.groupby("media").feature.nunique().max() == 1
    assert media.decode_media(media.encode_media(no_docs)).count() == 0
    alone = media.files_of([b"same text"])[0]
    assert media.files_of([b"other", b"same text"])[1] == alone
    found = media.read_media([None, b"rubbish", alone, alone[:-40]])
    assert found[0][5] is None and found[1][5] and found[2][2][:9] == b"same text" and found[3][5]


def test_minimax_cuts_equal_brute_force(spark):
    rng = random.Random(9)
    for shards in (2, 5, 9):
        sizes = {hashlib.sha256(str(i).encode()).hexdigest(): rng.randint(1, 40) for i in range(400)}
        frame = spark.createDataFrame(list(sizes.items()), "key string, bytes long")
        cuts = sharding.group_cuts(frame, shards)
        order = [sizes[k] for k in sorted(sizes)]

        def needed(capacity, order=order):
            n, held = 1, 0
            for s in order:
                if held + s > capacity:
                    n, held = n + 1, 0
                held += s
            return n

        best = next(c for c in range(max(order), sum(order) + 1) if needed(c) <= shards)
        held = Counter()
        for k, s in sizes.items():
            held[sum(k >= c for c in cuts)] += s
        assert len(cuts) == shards - 1 and max(held.values()) == best


def test_shards(spark, odd_docs, no_docs):
    got = sharding.shard_rows(odd_docs, 4).toPandas()
    rows = odd_docs.collect()
    assert Counter(zip(got["size"], got.text_crc32, strict=True)) == Counter((len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in rows)
    assert got.groupby("text_crc32").shard.nunique().max() == 1
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    assert sharding.shard_rows(no_docs).count() == 0


def test_mixing(spark, odd_docs, no_docs):
    rng = random.Random(6)
    rows = [doc(i, sentence(rng, rng.randint(0, 50)), rng.choice(["a", "b", "c", "d", None])) for i in range(400)] + [doc(900 + i, "w " * 5, "tiny") for i in range(3)]
    got = mixing.mix(spark.createDataFrame(rows, DOC).repartition(5)).toPandas()
    got["source"] = got["source"].fillna("(none)")
    assert got.copies.max() <= 3 and len(got) == len(rows)
    sizes = {k: v["size"].sum() for k, v in got.groupby("source")}
    assert sum(got.drop_duplicates("source").target) == pytest.approx(sum(sizes.values()))
    for source, own in got.groupby("source"):
        assert own.target.iloc[0] <= 3 * sizes[source] + 1e-6
        assert abs((own.copies * own["size"]).sum() - own.target.iloc[0]) <= own["size"].max() + 1
    again = mixing.mix(spark.createDataFrame(rows, DOC).repartition(2)).toPandas()
    key = ["doc_id", "copies"]
    assert sorted(map(tuple, got[key].values)) == sorted(map(tuple, again[key].values))
    assert mixing.mix(odd_docs).count() == 12 and mixing.mix(no_docs).count() == 0
    docs = spark.createDataFrame(rows, DOC)
    assert mixing.emit(docs, mixing.mix(docs)).count() == got.copies.sum()


def test_gradients():
    net = gru.Network(1)
    words = gru.prepare(["good day to you all " * 12, "bad bad people", "x y"])
    net.words[:] = np.random.default_rng(0).standard_normal(net.words.shape) * 0.1
    net.words, net.grams = net.words.astype(np.float64), net.grams.astype(np.float64)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    y, one, keep = np.array([0.0, 1, 0]), np.ones(3), np.ones((len(words.word), 1), np.float32)
    g, dw, _, _ = net.gradients(words, y, one, keep)
    for name in net.p:
        at, old = tuple(np.array(net.p[name].shape) // 2), net.p[name].copy()
        losses = []
        for step in (1e-2, -1e-2):
            net.p[name] = old.copy()
            net.p[name][at] += step
            losses.append(net.gradients(words, y, one, keep)[3])
        net.p[name] = old
        assert (losses[0] - losses[1]) / 2e-2 == pytest.approx(g[name][at], abs=2e-5)


def test_every_window_counts():
    net = gru.Network(2)
    net.words[:] = np.random.default_rng(0).standard_normal(net.words.shape)
    for n in (1, 31, 32, 33, 48, 49, 100):
        words = gru.prepare([sentence(random.Random(n), n)])
        seen = {(w * gru.STRIDE + t) for w in range(len(words.ids)) for t in range(gru.WINDOW) if words.ids[w, t] >= 0}
        assert seen == set(range(n))
    texts = [sentence(random.Random(i), 5 * i) for i in range(30)]
    assert np.allclose(net.scores(texts), [net.scores([t])[0] for t in texts], atol=1e-5)
    assert np.allclose(net.scores(texts, most=7), net.scores(texts), atol=1e-5)


def test_toxicity_learns_and_scores_everything(spark, odd_docs, no_docs):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(240):
        words = sentence(rng, rng.randint(5, 60)).split()
        bad = i % 4 == 0
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["vilething", "foulword", "nastyone"]))
        rows.append(doc(i, " ".join(words)))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, toxic int")
    network = toxicity.fit(docs, marks, steps=120)
    got = toxicity.score(docs, network).join(marks, "doc_id").select("doc_id", "score", "toxic", toxicity.held_out(F.col("doc_id")).alias("h")).toPandas()
    test = got[got.h]
    assert ((test.score >= 0.5) == (test.toxic == 1)).mean() > 0.9
    assert set(test.doc_id) == {i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0}
    odd = toxicity.score(odd_docs, network).toPandas()
    assert len(odd) == 12 and odd.score.between(0, 1).all() and odd.score.dtype == float
    assert toxicity.score(no_docs, network).count() == 0
    assert toxicity.fit(docs, marks.where("toxic = 0"), steps=5).scores(["a b c"])[0] < 0.01


def test_words_never_span_texts():
    b = Batch(["ab c", "", "d", " e"])
    start, end = b.words()
    assert [b.text[i:j] for i, j in zip(start, end, strict=True)] == ["ab", "c", "d", "e"] and b.counts(start).tolist() == [2, 0, 1, 1]
