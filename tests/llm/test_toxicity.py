"""The network's forward pass against plain loops, and the registered query on small written tables."""

import math
import random
import zlib

import numpy as np

from loomgraph.llm import registry, toxicity
from loomgraph.llm.gru import HIDDEN, SHARP, STRIDE, WINDOW, Network, prepare

from .conftest import DOC, doc, sentence


def plain_score(net, text):
    """Every window of a text by itself, word after word, with lists and loops."""
    words = prepare([text])
    own = {}
    for t in range(len(words.word)):
        grams = words.gram[words.gram_off[t] : words.gram_off[t + 1]]
        own[t] = [float(net.words[words.word[t]][k]) + sum(float(net.grams[g][k]) for g in grams) / math.sqrt(max(1, len(grams))) for k in range(net.words.shape[1])]
    sequence = []
    for row in words.ids:  # windows overlap by STRIDE words
        sequence = sequence[: len(sequence) - (WINDOW - STRIDE) if sequence else 0] + [int(i) for i in row if i >= 0]
    p = {k: v.tolist() for k, v in net.p.items()}
    sig = lambda v: 1 / (1 + math.exp(-v))
    dot = lambda x, m, j: sum(a * m[i][j] for i, a in enumerate(x))

    def run(ids, side):
        h, out = [0.0] * HIDDEN, []
        for i in ids if side == "f" else ids[::-1]:
            x = [dot(own[i], p["w" + side], j) + p["b" + side][j] for j in range(3 * HIDDEN)]
            u = [dot(h, p["u" + side], j) for j in range(3 * HIDDEN)]
            new = []
            for j in range(HIDDEN):
                z, r = sig(x[j] + u[j]), sig(x[HIDDEN + j] + u[HIDDEN + j])
                n = math.tanh(x[2 * HIDDEN + j] + r * u[2 * HIDDEN + j])
                new.append((1 - z) * n + z * h[j])
            h = new
            out.append(h)
        return out if side == "f" else out[::-1]

    logits = []
    for row in words.ids:
        ids = [int(i) for i in row if i >= 0]
        states = [f + b for f, b in zip(run(ids, "f"), run(ids, "b"), strict=True)]
        e = [sum(math.tanh(dot(s, p["wa"], j) + p["ba"][j]) * p["va"][j] for j in range(len(p["va"]))) for s in states]
        w = [math.exp(v - max(e)) for v in e]
        c = [sum(a * s[j] for a, s in zip(w, states, strict=True)) / sum(w) for j in range(2 * HIDDEN)]
        logits.append(sum(a * b for a, b in zip(c, p["wo"], strict=True)) + p["bo"][0])
    if not logits:
        return sig(p["bo"][0])
    return sig(max(logits) + math.log(sum(math.exp(SHARP * (v - max(logits))) for v in logits)) / SHARP)


def test_forward_pass_in_loops():
    rng = np.random.default_rng(4)
    net = Network(5)
    net.words[:] = rng.standard_normal(net.words.shape) / 2
    net.grams[:] = rng.standard_normal(net.grams.shape) / 4
    words = random.Random(6)
    texts = ["", "one", "Two words", *[sentence(words, n) for n in (31, 32, 33, 47, 48, 49, 110)]]
    got = net.scores(texts)
    assert np.allclose(got, [plain_score(net, t) for t in texts], atol=2e-4)
    assert np.allclose(got, [net.scores([t])[0] for t in texts], atol=1e-6) and np.allclose(got, net.scores(texts, most=2), atol=1e-6)


def small(spark, folder):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(160):
        bad = i % 2
        text = sentence(rng, 40) + (" vileword nastyword" if bad else " kindword goodword") + " " + sentence(rng, 15)
        rows.append(doc(i, text))
        # Labels of rows held out are turned, so that learning from them would show.
        labels.append((i, 1, 1 - bad if zlib.crc32(str(i).encode()) % 5 == 0 else bad))
    rows += [(None, "vileword nastyword", "en", None, 3), doc(200, None), doc(201, ""), doc(202, " \n"), doc(203, rows[1][1]), doc(203, rows[1][1]), doc(204, "word " * 250_000 + "vileword nastyword")]
    from pyspark.sql import functions as F

    spark.createDataFrame(rows, DOC).withColumn("score", F.lit("clash")).withColumn("toxic", F.lit(7)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (9999, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_query(spark, tmp_path):
    rows = small(spark, str(tmp_path))
    got = registry.queries()["op1_toxicity"](spark, str(tmp_path)).collect()
    assert sorted(repr(r.doc_id) for r in got) == sorted(repr(r[0]) for r in rows)
    for r in got:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    scores = {r.doc_id: r.score for r in got}
    assert sum((scores[i] >= 0.5) == bool(i % 2) for i in range(160)) >= 155
    assert scores[200] == scores[201] == scores[202] and len({r.score for r in got if r.doc_id == 203}) == 1 and scores[204] >= 0.5
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    assert toxicity.score(empty.drop("score"), Network()).count() == 0


def test_nothing_is_learned_from_rows_held_out(spark, tmp_path):
    small(spark, str(tmp_path))
    read = lambda t: spark.read.parquet(f"{tmp_path}/{t}.parquet")
    texts, y = toxicity.sample(read("documents"), read("labels"), 1000, "doc_id", "text", "toxic")
    assert all(("vileword" in t) == bool(k) for t, k in zip(texts, y.tolist(), strict=True)) and len(texts) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(160))
