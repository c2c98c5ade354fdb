import random
from collections import Counter

import corpus_pipeline
from loomgraph.llm import mixing

from .conftest import DOC, doc, sentence

STAGES = dict(corpus_pipeline.STAGES)


def test_mixing_takes_null_shared_and_repeated_ids(spark):
    words = [" ".join(f"w{i}x{k}" for k in range(3 + i)) for i in range(12)]
    rows = [(None, words[0], "en", "a", 1), (None, words[1], "en", "b", 1), (None, None, None, None, None), (1, words[2], "en", "a", 1), (1, words[3], "en", "a", 1)]
    rows += [(1, words[4], "en", "b", 1), (2, words[5], "en", None, 1), (2, words[5], "en", None, 1), (2, words[5], "en", "a", 1), (3, "", "en", "b", 0), (3, None, "en", "b", 0)]
    rows += [(10 + i, w, "en", "ab"[i % 2], 1) for i, w in enumerate(words)]
    docs = spark.createDataFrame(rows, DOC).repartition(3)
    want = Counter()
    for r in mixing.mix(docs).collect():
        assert 0 <= r.copies <= 3
        want[r.doc_id, r.source, r["size"]] += r.copies
    out = STAGES["mixing"](spark, docs, "")
    assert out.columns == docs.columns
    got = Counter(map(tuple, out.collect()))
    assert Counter((i, s, len((t or "").split())) for i, t, _, s, _ in got.elements()) == +want
    have = Counter(rows)
    assert all(n <= 3 * have[r] for r, n in got.items())
    assert sum(n for r, n in got.items() if r[0] is None) > 0


def test_near_copies_are_dropped_by_row(spark):
    rng = random.Random(5)
    base = {k: sentence(rng, 60) for k in "abcdefg"}
    near = lambda k, w: base[k] + " " + w
    texts = [
        # A null id near to an id goes, other null ids stay.
        (4, base["a"]), (None, near("a", "x")), (None, base["b"]),
        # A clean text stays though its id is also that of a near copy.
        (5, base["c"]), (6, near("c", "y")), (6, base["d"]),
        # Near copies of one id, a class of null ids, and a row that is repeated in full: one of each stays.
        (7, base["e"]), (7, near("e", "z")), (None, base["f"]), (None, near("f", "z")), (8, base["g"]), (8, base["g"]),
    ]
    docs = spark.createDataFrame([doc(i, t) for i, t in texts], DOC).repartition(3)
    out = STAGES["ngram_join"](spark, docs, "")
    assert out.columns == docs.columns
    got = Counter((r.doc_id, next(k for k, b in base.items() if r.text.startswith(b))) for r in out.collect())
    assert got == Counter([(4, "a"), (None, "b"), (5, "c"), (6, "d"), (7, "e"), (None, "f"), (8, "g")])
