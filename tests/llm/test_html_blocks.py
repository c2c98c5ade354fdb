"""Main text of pages: the run decides, in linear time, with and without telling tags."""

import random
import time

import pyarrow.parquet as pq
import pytest

from loomgraph.llm.html_extract import best_run, extract, extract_pages, fitted
from loomgraph.llm.html_pages import labelled

TEXT = "The mill stood idle for a year, because its owner had gone to sea and nobody else knew the gears."


def test_blocks_on_both_sides_of_a_box_are_kept():
    page = f"<body><section><p>{TEXT} {TEXT}</p></section><div class='ad'>{'buy this boat now ' * 20}</div><section><p>{TEXT}</p></section><div id='footer'>the end</div></body>"
    assert extract(page) == f"{TEXT} {TEXT} {TEXT}"


def test_boxes_between_blocks_do_not_cut_the_text():
    for tag in ("section", "div"):
        for box in ("ad", "newsletter", "related"):
            block = lambda word, n: f"<{tag}><p>{word * n}</p></{tag}>"
            page = f"<body><nav><a href=/>home</a></nav>{block('one ', 300)}<div class={box}><p>{'buy ' * 60}</p></div>{block('two ', 50)}<footer>end</footer></body>"
            assert extract(page) == ("one " * 300 + "two " * 50).strip()


def test_scan_against_all_runs():
    rng = random.Random(5)
    for n in (0, 1, 2, 7, 30):
        for _ in range(40):
            scores = [rng.choice((-2.0, -0.5, 0.0, 0.5, 1.0)) for _ in range(n)]
            first, last = best_run(scores)
            best = max([0.0, *(sum(scores[a:b]) for a in range(n) for b in range(a + 1, n + 1))])
            assert sum(scores[first:last]) == best
            assert (first == last) == (best <= 0)


def test_another_run_gives_another_text():
    one = lambda scores: (max(range(len(scores)), key=scores.__getitem__),) * 1
    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist()
    changed = sum(extract(p) != extract(p, lambda s: (one(s)[0], one(s)[0] + 1)) for p in pages)
    assert changed > 0.9 * len(pages)


def test_weights_have_their_signs():
    evidence, weight = fitted()
    assert weight["word"] > 0 and weight["word:box"] < 0 and weight["word:links"] < 0
    assert all(w < 0 for k, w in weight.items() if not k.startswith("word"))
    assert evidence["<nav>"] < 0 < evidence["<article>"]
    assert len(labelled()) > 24


@pytest.mark.parametrize("name", ["search-results", "related", "widget", "alert", "share", "comments"])
def test_names_alone_remove_no_article(name):
    whole = f"Wheels {TEXT} {TEXT}"
    body = f"<h1>Wheels</h1><p>{TEXT}</p><p>{TEXT}</p>"
    assert extract(f"<nav><a href='/'>Home</a></nav><article class='{name}'>{body}</article><footer>all rights</footer>") == whole
    assert extract(f"<nav><a href='/'>Home</a></nav><div class='ad'>Buy a boat</div><div class='{name}'>{body}</div><footer>all rights</footer>") == whole
    assert extract(f"<article><h1>Wheels</h1><p>{TEXT}</p><div class='{name}'><p>Not of the story at all.</p></div><p>{TEXT}</p></article>") == whole


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("   ", ""),
        ("<nav><a href='/'>Home</a></nav>", ""),
        ("plain words", "plain words"),
        ("a < b and c > d", "a < b and c > d"),
        ("<p>&am<b>p;</b> x&nbsp;y &eacute;</p>", "&amp; x y é"),
        ("<p>one<b>two</b><i> three</i><br>four</p>", "onetwo three four"),
        ("<article><p>x<img src=a>y<script>z</script>w</p><p hidden>no</p><form>no <p>no</p></form><p>So is.</p></article>", "xyw So is."),
        ("<script>var a; <p>after a script that never ends</p>", "after a script that never ends"),
        ("<body class='has-sidebar no-comments'><p>words of a page with neighbours</p>", "words of a page with neighbours"),
        ("<article><header><h1>Head</h1></header><p>body text here</p><footer>foot</footer></article><section class='comments'><article class='comment'><p>I think that it is bad.</p></article></section>", "Head body text here"),
        ("<div><a href=/>Home</a> | <a href=/n>News</a> | <a href=/s>Sport</a></div><h1>A head</h1><div><p>body text of this page</p></div>", "A head body text of this page"),
        ("<div id='page' class='site'><div class='sidebarRight'>ab cd ef gh</div><div class='post category-newsletter'><h2>T</h2><p>some words of a post</p></div></div>", "T some words of a post"),
    ],
)
def test_cases(page, text):
    assert extract(page) == text


@pytest.mark.parametrize("page", ["<a ", "<iframe>", "<div></x>", '<a x="y>" ', "<b><div><i></b>", "<ul><li>a", "<p>x", "<", '<a ="', "<script>", "<!-- "])
def test_time_is_linear(page):
    def took(n: int) -> float:
        began = time.perf_counter()
        extract(page * n)
        return time.perf_counter() - began

    took(2_000)
    assert took(32_000) < 10 * took(8_000) + 0.5


def test_pages_without_rows_and_with_clashing_columns(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, text string, _x int")
    assert extract_pages(empty).count() == 0
    rows = spark.createDataFrame([(1, None, "<p>a b c</p>", "old", 7), (1, None, "<p>a b c</p>", "old", 7), (2, "u", None, None, None)], empty.schema)
    out = sorted((r.page_id, r.text, r._x) for r in extract_pages(rows).collect())
    assert [o[1] for o in out] == ["a b c", "a b c", ""] and [o[0] for o in out] == [1, 1, 2]
