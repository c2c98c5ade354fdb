"""Main text of web pages by the maximum-scoring run of tokens.

A page is read once into words and tags. Words score positive and tags
negative, and words in page furniture (menus, adverts, comments and the like)
negative too. All scores are log odds counted on labelled pages
(``html_pages``): of the tokens by kind, and of the names that elements bear.
One linear scan finds the contiguous run with the highest sum, and that run is
the main text. Its ends are moved outwards where the tokens between cost no
more than ``SNAP``: to further words of the smallest element that holds the
run, and to the ends of elements around, so that a short heading or a last
line is not cut off. Furniture inside the run is left out; it costs the
run at most ``BOX``, so that text goes on after a box.

Whether an element is furniture depends on all elements around it: evidence of
tags, roles, class names and ids is added up from the outside in, and only so
much credit is kept (``CREDIT``) that an advert inside an article is still
seen. Names alone never empty a page: when hardly any text is left, elements
that hold most of the words are no furniture whatever they are called.

Defined results: a null, empty or wordless page gives the empty text;
unclosed and stray tags are repaired as browsers do for paragraphs and list
items; a script without an end ends at the next block of text; text outside
all markup counts as text; references are decoded in each piece of text by
itself; repeated pages give repeated rows. Whole pages are read in one pass
whose time is linear in their length.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_pages import LABELLED, labelled

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big button cite code data del dfn em font i img input ins kbd label link mark meta noscript q ruby s samp script small span strike strong style sub sup template time tt u var wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe".split())
#: Elements that show no text of their own, or only controls: never output.
SILENT = frozenset("head script style textarea title noscript template xmp iframe form button select option datalist svg math canvas object audio video map dialog".split())
#: Tags that tell what an element is for; other tags say nothing about their words.
TELLING = frozenset("nav footer aside header menu article main section".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCE = frozenset("ul ol dl table div section article main body aside nav header footer form blockquote".split())
CELLS = frozenset("td th li".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEIGHBOUR = ("has-", "with-", "no-", "without-")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Only a value after = may be quoted; possessive, so that a failed match is one look.
REST = re.compile(r"(?>[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')?)*+>")
NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
RESUME = re.compile(r"<(?:p|h[1-6]|div|article|section|main|body|table|ul|ol|blockquote)[\s>]", re.I)

MOST_NAME, MOST_TAG, CREDIT = 2.5, 3.0, 0.5  # bounds of the evidence of names and tags, and of what is passed inwards
OUT = -1.0  # evidence from which an element is furniture
BOX, SNAP = 4.0, 6.0
UNSEEN = -0.5  # score of a tag that no labelled page has
FEW = 10  # words; a page with fewer left is looked at again, if a box holds half of all words and FEW / 2 times what is left


class Element:
    __slots__ = ("block", "box", "end", "first", "heading", "home", "link", "linked", "name", "out", "own", "parent", "silent", "state", "words")

    def __init__(self, name: str, parent: Element | None, first: int) -> None:
        self.name, self.parent, self.first, self.end = name, parent, first, -1
        self.words = self.linked = 0  # of the block, and for the root of the page
        self.own: tuple[str, ...] = ()
        if parent is None:
            self.block, self.box, self.state = self, None, 0.0
            self.silent = self.out = self.link = self.heading = self.home = False
            return
        self.block = parent.block if name in INLINE else self
        self.link = parent.link or name == "a"
        self.heading = parent.heading or name in HEADINGS
        self.home = parent.home or name in ("article", "main")

    def judge(self, evidence: dict[str, float], spared: frozenset[int]) -> None:
        """Sum of what tag and names say, on top of the elements around."""
        up = self.parent
        tag = evidence.get(f"<{self.name}{'@home' if self.name == 'header' and up.home else ''}>", 0.0)
        names = 0.0 if self.first in spared else sum(name_evidence(n, evidence) for n in self.own)
        e = max(-MOST_TAG, min(MOST_TAG, tag)) + max(-MOST_NAME, min(MOST_NAME, names))
        self.state = min(up.state, CREDIT) + e
        self.out = up.out or self.silent or self.state <= OUT
        self.box = up.box or (self if self.out else None)


def parts_of(name: str) -> list[str]:
    """Words of a class name or id: of relatedPosts-2, related and post."""
    found = re.findall(r"[A-Z]?[a-z]+|[A-Z]+", name)
    return [p[:-1] if len(p) > 3 and p.endswith("s") else p for p in (f.lower() for f in found)]


def name_evidence(name: str, evidence: dict[str, float]) -> float:
    """Of the words of a name the one that speaks most against the element, else the one most for it."""
    seen = [evidence[f".{p}"] for p in parts_of(name) if f".{p}" in evidence]
    if name.startswith("role=") or f"={name}" in evidence:
        return evidence.get(f"={name}", 0.0)
    return 0.0 if not seen else min(seen) if min(seen) < 0 else max(seen)


def names_of(name: str, attributes: str) -> tuple[tuple[str, ...], bool]:
    """Class names, id and role of an element, and whether it is hidden."""
    if not attributes or attributes.isspace():
        return (), False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "style" in found and HIDDEN.search(found["style"]) is not None
    if name in ("html", "body"):
        return (), hidden  # they describe the page
    # Names such as has-sidebar tell of a neighbour.
    names = [n for n in f"{found.get('class', '')} {found.get('id', '')}".split() if not n.lower().startswith(NEIGHBOUR)]
    if found.get("role"):
        names.append(f"role={found['role'].lower()}")
    return tuple(names), hidden


class Page:
    """Tokens of a page, each [kind, number of words or None, text, separates, element], and its labelled stretches."""

    def __init__(self, page: str, evidence: dict[str, float], spared: frozenset[int] = frozenset()) -> None:
        self.tokens: list[tuple] = []
        self.marks: list[int] = []
        self.root = Element("#root", None, 0)
        self.elements = [self.root]
        self.has_home = False
        self.evidence, self.spared = evidence, spared
        self.stack = [self.root]
        self.open: dict[str, list[int]] = defaultdict(list)  # places of the open elements of each name
        self.blocks, self.fences, self.cells = [0], [0], [0]  # places of open blocks, of fences, of cells and fences
        self.read(page)
        self.pop_to(1)
        self.root.end = len(self.tokens)

    def pop_to(self, place: int) -> None:
        stack = self.stack
        while len(stack) > place:
            e = stack.pop()
            e.end = len(self.tokens)
            self.open[e.name].pop()
            for places in (self.blocks, self.fences, self.cells):
                if places[-1] == len(stack):
                    places.pop()

    def push(self, e: Element) -> None:
        at = len(self.stack)
        self.stack.append(e)
        self.open[e.name].append(at)
        if e.name not in INLINE:
            self.blocks.append(at)
        if e.name in FENCE:
            self.fences.append(at)
            self.cells.append(at)
        elif e.name in CELLS:
            self.cells.append(at)

    def text(self, piece: str) -> None:
        if not piece:
            return
        top = self.stack[-1]
        n = len(piece.split())
        self.tokens.append(("word", n, piece, False, top))
        if not top.out:
            top.block.words += n
            top.block.linked += n if top.link else 0

    def end_tag(self, name: str) -> None:
        block = name not in INLINE
        self.tokens.append((f"/{name}", None, None, block, self.stack[-1]))
        places = self.open.get(name)
        # The end of an inline element does not reach over a block.
        if places and (block or places[-1] > self.blocks[-1]):
            self.pop_to(places[-1])

    def start_tag(self, name: str, attributes: str) -> bool:
        """Whether the element stays open."""
        if name not in INLINE and name != "br":
            # A new block ends an open paragraph; list items and cells end their like.
            paragraph = self.open.get("p")
            if paragraph and paragraph[-1] > self.cells[-1]:
                self.pop_to(paragraph[-1])
            like = [self.open[c][-1] for c in CLOSES.get(name, ()) if self.open.get(c)]
            if like and max(like) > self.fences[-1]:
                self.pop_to(min(p for p in like if p > self.fences[-1]))
        e = Element(name, self.stack[-1], len(self.tokens))
        e.own, hidden = names_of(name, attributes)
        e.silent = e.parent.silent or hidden or name in SILENT
        e.judge(self.evidence, self.spared)
        self.tokens.append((name, None, None, name not in INLINE, e))
        self.has_home = self.has_home or name in ("article", "main")
        # A slash at the end of an unquoted value belongs to the value.
        if name in VOID or name not in RAW and attributes.endswith("/") and not attributes[-2:-1].strip("\"' \n\t"):
            return False
        self.elements.append(e)
        self.push(e)
        return True

    def read(self, page: str) -> None:
        at, n = 0, len(page)
        endless: set[str] = set()  # raw elements that end nowhere from here on
        last = page.rfind(">")
        loose = False
        begun = 0  # where the text before the next tag begins
        while True:
            at = page.find("<", at)
            if at < 0 or at > last:
                self.text(page[begun:])
                return
            if page.startswith("<!--", at):
                self.text(page[begun:at])
                if page.startswith("<!--[-->", at) or page.startswith("<!--]-->", at):
                    self.marks.append(len(self.tokens))
                end = page.find("-->", at + 2)
                at = begun = n if end < 0 else end + 3
                continue
            if at + 1 < n and page[at + 1] in "!?":
                self.text(page[begun:at])
                end = page.find(">", at)
                at = begun = end + 1
                continue
            m = NAME.match(page, at + 1)
            if not m:
                at += 1
                continue
            self.text(page[begun:at])
            rest = None if loose else REST.match(page, m.end())
            if rest:
                end = rest.end()
            else:
                # Quotes that close nowhere: from here on the first > ends a tag.
                loose = True
                end = page.find(">", m.end()) + 1
            name = m[1].lower()
            attributes = page[m.end() : end - 1]
            at = begun = end
            if page[m.start()] == "/":
                self.end_tag(name)
            elif self.start_tag(name, attributes) and name in RAW:
                close = None if name in endless else re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                if close is None:
                    endless.add(name)
                    resume = RESUME.search(page, at)
                    at = begun = resume.start() if resume else n
                else:
                    at = begun = close.start()
                    continue
                self.pop_to(self.open[name][-1])

    def kind(self, token: tuple) -> str:
        kind, words, _, _, e = token
        links = 2 * e.block.linked > e.block.words
        if words is None:
            return f"{kind} links" if links else kind
        if e.out:
            return "word:box"
        if links:
            return "word:links"
        stray = self.has_home and not e.home
        if e.heading:
            return "word:heading stray" if stray else "word:heading"
        return "word:stray" if stray else "word"

    def scores(self, weight: dict[str, float]) -> list[float]:
        """Score of each token; a box counts as a whole, at its first token."""
        out = [0.0] * len(self.tokens)
        boxes: dict[int, float] = defaultdict(float)
        for i, token in enumerate(self.tokens):
            words, e = token[1], token[4]
            score = weight.get(self.kind(token), UNSEEN) * (1 if words is None else words)
            if e.box is None:
                out[i] = score
            else:
                boxes[e.box.first] += score if not e.silent else 0.0
        for i, total in boxes.items():
            out[i] = min(UNSEEN, max(-BOX, total))
        return out


def odds(inside: Counter, outside: Counter, half: float) -> dict[str, float]:
    a, b = sum(inside.values()), sum(outside.values())
    return {k: math.log((inside[k] + half) / (a + half)) - math.log((outside[k] + half) / (b + half)) for k in inside.keys() | outside.keys()}


@cache
def fitted() -> tuple[dict[str, float], dict[str, float]]:
    """Evidence of tags and names, and weights of kinds of tokens, counted on the labelled pages."""
    pages = [*LABELLED, *labelled()]
    main_of = lambda p: [sum(m <= i for m in p.marks) % 2 == 1 for i in range(len(p.tokens))]
    inside, outside = Counter(), Counter()
    total = [0, 0]
    for source in pages:
        page = Page(source, {})
        for token, main in zip(page.tokens, main_of(page), strict=True):
            if not token[1]:
                continue
            total[main] += 1
            e, seen = token[4], set()
            while e.parent is not None:
                if e.name in TELLING:
                    seen.add(f"<{e.name}{'@home' if e.name == 'header' and e.parent.home else ''}>")
                for name in e.own:
                    seen |= {f"={name}"} if name.startswith("role=") else {f".{p}" for p in parts_of(name)} | {f"={name}"}
                e = e.parent
            (inside if main else outside).update(seen)
    # Each piece of text counts once for each name around it; the shares are of all pieces.
    evidence = {k: math.log((inside[k] + 0.5) / (total[1] + 1)) - math.log((outside[k] + 0.5) / (total[0] + 1)) for k in inside.keys() | outside.keys()}
    inside, outside = Counter(), Counter()
    for source in pages:
        page = Page(source, evidence)
        for token, main in zip(page.tokens, main_of(page), strict=True):
            (inside if main else outside)[page.kind(token)] += 1 if token[1] is None else token[1]
    # Words of plain text are worth more than nothing and tags less, whatever the sample.
    signs = {"word": (0.5, 2.0), "word:heading": (0.5, 2.0)}
    weight = {}
    for k, v in odds(inside, outside, 0.5).items():
        low, high = signs.get(k, (-3.0, 1.0) if k.startswith("word") else (-2.0, -0.1))
        weight[k] = max(low, min(high, v))
    return evidence, weight


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and last + 1 of the contiguous run with the highest sum; empty if none is positive."""
    best, run, first, found = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if run <= 0.0:
            run, first = 0.0, i
        run += s
        if run > best:
            best, found = run, (first, i + 1)
    return found


def snapped(page: Page, scores: list[float], first: int, last: int) -> tuple[int, int]:
    """The run with its ends moved to those of the elements around, where that costs little."""
    sums = [0.0]
    for s in scores:
        sums.append(sums[-1] + s)
    tokens = page.tokens
    # Beside the best run nothing is worth more than nothing, but for rounding.
    cheap = lambda cost: -SNAP <= cost <= 1e-9
    around = tokens[first][4]
    while around.first > first or around.end < last:
        around = around.parent
    a, b, at = first, last, first
    while at > around.first and cheap(sums[first] - sums[at - 1]):
        at -= 1
        a = at if tokens[at][1] and scores[at] > 0 else a
    at = last
    while at < around.end and cheap(sums[at + 1] - sums[last]):
        at += 1
        b = at if tokens[at - 1][1] and scores[at - 1] > 0 else b
    e = tokens[a][4]
    while e is not None and cheap(sums[first] - sums[min(a, e.first)]):
        a, e = min(a, e.first), e.parent
    e = tokens[b - 1][4]
    while e is not None and cheap(sums[max(b, e.end)] - sums[last]):
        b, e = max(b, e.end), e.parent
    return a, b


def extract(page: str | None, run=best_run) -> str:
    if not page:
        return ""
    evidence, weight = fitted()
    parsed = Page(page, evidence)
    scores = parsed.scores(weight)
    first, last = run(scores)
    left = sum(t[1] or 0 for t in parsed.tokens[first:last] if not t[4].out)
    if left < FEW:
        again = spare(parsed, left)
        if again:
            parsed = Page(page, evidence, again)
            scores = parsed.scores(weight)
            first, last = run(scores)
    if first == last:
        return ""
    a, b = snapped(parsed, scores, first, last)
    out = []
    for _, words, text, separates, e in parsed.tokens[a:b]:
        if words is None:
            if separates:
                out.append(" ")
        elif not e.out:
            out.append(html.unescape(text))
    return " ".join("".join(out).split())


def spare(page: Page, left: int) -> frozenset[int]:
    """First tokens of the elements that hold more than half of the words that show, and far more than are left."""
    words = [0]
    for t in page.tokens:
        words.append(words[-1] + (t[1] if t[1] and not t[4].silent else 0))
    return frozenset(e.first for e in page.elements if e.own and e.out and not e.silent and words[e.end] - words[e.first] > max(words[-1] / 2, FEW * left / 2))


def extract_pages(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text in ``text_col``; a column of that name is replaced."""
    kept = [c for c in pages.columns if c != text_col]
    rows = pages.select(*kept, F.col(html_col).cast("string").alias("_html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([extract(p) for p in batch.column("_html").to_pylist()], pa.string())
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, texts], [*kept, text_col])

    schema = rows.drop("_html").withColumn(text_col, F.lit("")).schema
    return rows.mapInArrow(read, schema)


def op5(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    rows = extract_pages(pages.select("page_id", "url", F.col("html").alias("_page")), "_page")
    return rows.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
