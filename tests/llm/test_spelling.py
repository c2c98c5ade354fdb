"""Spelling variants against plain loops over all pairs, on written tables with odd rows."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from loomgraph.llm import registry, spelling

from .conftest import DOC, doc


def brute_words(rows, every=199, least_length=6, least_count=5):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= least_length and n >= least_count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words, times=5):
    near = {w: sorted((-words[v], v) for v in words if one_edit(w, v)) for w in words}
    form = {w: own[0][1] if own and -own[0][0] >= times * words[w] else None for w, own in near.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), words[w], len(near[w]), words[form[w]] if form[w] else 0) for w in words)


def plain(rows):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in rows)


@pytest.mark.parametrize("most", [1, 3, 64])
def test_near_words_where_many_share_a_half(spark, most):
    """All words share their first or last half with many others, so keys are refined down to single code points."""
    rng = random.Random(most)
    words = {}
    while len(words) < 250:
        size = rng.randint(6, 9)
        w = "".join(rng.choice("abé") for _ in range(size))
        words[rng.choice(["aaa" + w[3:], w[:-3] + "bbb", w])] = rng.randint(5, 400)
    words |= {"aaaaaa": 5, "aaaaaaa": 30, "aaaaaaaa": 200, "aaaaaaaaa": 1100}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert plain(spelling.variants(frame, most=most).collect()) == brute_variants(words)


def test_ties_go_to_the_smaller_word(spark):
    words = {"kitten": 5, "mitten": 50, "bitten": 50, "étape1x": 7}
    rows = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert {r.word: r.form for r in rows}["kitten"] == "bitten"
    assert {r.word: (r.root, r.n_near, r.form_n) for r in rows}["étape1x"] == ("étape1x", 0, None)


@pytest.fixture(scope="module")
def folder(spark, odd_docs, tmp_path_factory):
    """Odd rows; a word in two cases; a hot word; accents that are not lower-cased; a run longer than a slice."""
    more = [doc(20 + i, "Station station STATION stations statiom Études études " * 3 + "x" * i) for i in range(40)]
    more += [doc(70, "statoin " * 9), doc(71, "words " * 300_000), doc(72, "z" * 1_200_000 + " end"), doc(72, "Zoology zoology")]
    folder = str(tmp_path_factory.mktemp("spelling"))
    odd_docs.unionByName(spark.createDataFrame(more, DOC), allowMissingColumns=True).withColumn("word", odd_docs.key).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_query(spark, folder):
    own = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = plain(registry.queries()["op11_spelling"](spark, folder).collect())
    assert got == brute_variants(brute_words(own)) and len(got) > 5
    c = duckdb.connect()
    # Its loops take long over a run of a million letters, which is no word here.
    c.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet') where not starts_with(coalesce(text, ''), 'zzz')")
    assert sorted((w, f or "", r, n, k, m or 0) for w, f, r, n, k, m in c.execute(registry.oracle_sql()["op11_spelling"]).fetchall()) == got


def test_words_that_checksums_shorten(spark):
    """Runs are shortened often enough for shortened and whole forms to meet."""
    rows = [(i, "harbour harbours lantern") for i in range(400)] + [(None, "harbour")] * 6
    words = spelling.words(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), every=7)
    assert {r.word: r.n for r in words.collect()} == brute_words(rows, every=7)


def test_no_rows(spark, no_docs):
    assert spelling.variants(spelling.words(no_docs)).count() == 0


def test_slices_cut_no_run(monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 7)
    text = "alpha beta-gammadelta  épsilon zeta"
    assert "".join(spelling.slices(text)) == text
    assert [w for part in spelling.slices(text) for w in re.findall(spelling.RUN, part)] == re.findall(spelling.RUN, text)
