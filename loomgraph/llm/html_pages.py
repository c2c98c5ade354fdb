"""Labelled pages from which the weights of ``html_extract`` are counted.

Each page is a frame with main text and boxes of page furniture around and
within it. What is main text stands between the comments ``<!--[-->`` and
``<!--]-->``, which may occur several times in a page.
"""

from __future__ import annotations

_SENTENCES = (
    "The river rose before dawn and by noon the lower fields were under water.",
    "Nobody in the village could remember a spring as wet as this one.",
    "Engineers from the district office measured the level twice a day.",
    "They found that the old wall held, though it leaked at its northern end.",
    "Volunteers filled sandbags until the light failed and then went home to sleep.",
    "In the morning the council met to decide what should be rebuilt and what should not.",
    "Prices of seed have risen since then, and most farms will plant less.",
    "A second report, due in autumn, is to compare the three proposals.",
)
_TITLES = ("The flood", "After the rain", "Two views of one wall", "Notes", "What the council decided", "Seed")


def _text(n: int, shift: int = 0) -> str:
    return " ".join(_SENTENCES[(i + shift) % len(_SENTENCES)] for i in range(n))


def _links(*names: str) -> str:
    return "<ul>" + "".join(f'<li><a href="/{n}">{n}</a></li>' for n in names) + "</ul>"


#: Names of furniture by what it holds: class names and ids as they are met in pages.
_MENUS = "nav menu navbar main-navigation breadcrumbs breadcrumb topnav pagination pager toolbar skip-link submenu".split()
_HEADS = "site-header header masthead topbar page-top banner hero-banner brand logo".split()
_SIDES = "sidebar side-bar widget widget-area rail related related-posts recommended more-stories trending popular most-read teaser-list".split()
_ADS = "ad ads advert advertisement sponsored sponsor promo promotion ad-slot ad-box adsbygoogle outbrain".split()
_NOTICES = "cookie-notice cookies consent gdpr notice alert popup modal overlay paywall disclaimer".split()
_CALLS = "newsletter subscribe signup share sharing share-buttons social social-links follow login search donate".split()
_TALK = "comments comment comment-list commentlist replies reply respond discussion disqus_thread reader-comments reviews".split()
_FEET = "footer site-footer copyright legal colophon bottom-bar credits".split()


def _boxes() -> list[str]:
    out = [
        f"<nav>{_links('Home', 'News', 'Sport', 'About')}</nav>",
        f"<header><a href='/'>The Paper</a> <span>Independent since long ago</span> {_links('Home', 'Weather')}</header>",
        f"<aside><h3>Most read</h3>{_links('Storm', 'Drought', 'Harvest')}<p>More from this desk every day.</p></aside>",
        "<footer><p>&copy; The Paper. All rights reserved.</p><p>Contact us by letter or by telephone.</p></footer>",
        "<form><label>Your address</label><input name='q'><p>We never pass it on.</p><button>Send</button></form>",
        f"<div role='navigation'>{_links('One', 'Two', 'Three')}</div>",
        "<div role='banner'><p>The Paper</p><p>All the news of the valley</p></div>",
        "<div role='complementary'><h4>Today</h4><p>Rain, later sun.</p></div>",
        "<div role='contentinfo'><p>Printed in the valley.</p><p>Terms of use</p></div>",
        "<div role='search'><p>Search the archive</p><p>All years</p></div>",
        "<div role='alert'><p>Service is reduced today.</p><p>Read more</p></div>",
        "<div role='dialog'><p>Before you go</p><p>Stay a while</p></div>",
        f"<div>{_links('Front', 'Archive', 'Letters', 'Jobs')}</div>",
        f"<menu>{_links('Open', 'Save')}</menu>",
    ]
    both = lambda i, n: f"class='{n}'" if i % 3 else f"id='{n}'"
    for i, n in enumerate(_MENUS):
        out.append(f"<div {both(i, n)}>{_links('Home', 'News', 'Sport')}<span>You are here</span></div>")
    for i, n in enumerate(_HEADS):
        out.append(f"<div {both(i, n)}><span>The Paper</span><p>News of the valley since long ago</p></div>")
    for i, n in enumerate(_SIDES):
        out.append(f"<{('div', 'section')[i % 2]} {both(i, n)}><h3>More</h3><p>{_SENTENCES[i % 8]}</p>{_links('Storm', 'Drought')}</{('div', 'section')[i % 2]}>")
    for i, n in enumerate(_ADS):
        out.append(f"<div {both(i, n)}><p>Buy two boats for the price of one.</p><p>Only this week, only here.</p></div>")
    for i, n in enumerate(_NOTICES):
        out.append(f"<div {both(i, n)}><p>We use cookies to improve this site.</p><p>By reading on you agree.</p><button>Accept</button></div>")
    for i, n in enumerate(_CALLS):
        out.append(f"<div {both(i, n)}><p>Get our letter every morning.</p><p>Tell your friends.</p><a href='/x'>Join</a></div>")
    for i, n in enumerate(_TALK):
        out.append(f"<{('section', 'div', 'ol')[i % 3]} {both(i, n)}><h3>What readers say</h3><div><p>First! {_SENTENCES[(i + 3) % 8]}</p></div><div><p>I do not agree with this at all.</p></div></{('section', 'div', 'ol')[i % 3]}>")
    for i, n in enumerate(_FEET):
        out.append(f"<div {both(i, n)}><p>All rights reserved.</p><p>Contact us by letter or by telephone.</p></div>")
    return out


#: Frames: how the main text is held; {h} the heading, {a} and {b} text, {box} furniture in the middle.
_FRAMES = (
    "<article><!--[--><h1>{h}</h1>{a}<!--]-->{box}<!--[-->{b}<!--]--></article>",
    "<div id='content'><!--[--><div class='story'><h2>{h}</h2>{a}<!--]-->{box}<!--[-->{b}</div><!--]--></div>",
    "<main><!--[--><h1>{h}</h1>{a}{b}<!--]--></main>",
    "<div class='post'><!--[--><h2 class='post-title'>{h}</h2><div class='entry-content'>{a}<!--]-->{box}<!--[-->{b}</div><!--]--></div>",
    "<table><tr><td>{side}</td><td><!--[-->{a}{b}<!--]--></td></tr></table>",
    "<section><!--[--><h1>{h}</h1>{a}<!--]--></section>{box}<section><!--[-->{b}<!--]--></section>",
    "<article class='news-article'><!--[--><header class='article-header'><h1>{h}</h1><p>By our reporter</p></header><div class='article-body'>{a}<!--]-->{box}<!--[-->{b}</div><!--]--></article>",
    "<main class='main'><article><!--[--><h1>{h}</h1>{a}<!--]-->{box}<!--[-->{b}<!--]--></article></main>",
    "<div class='main-content'><!--[--><h1 class='title'>{h}</h1><div class='text'>{a}</div><div class='text'>{b}</div><!--]--></div>",
    "<div class='entry'><!--[--><h1>{h}</h1><article>{a}<!--]-->{box}<!--[-->{b}</article><!--]--></div>",
    "<div class='page'><div class='body-text'><!--[--><h1>{h}</h1>{a}<!--]-->{box}<!--[-->{b}<!--]--></div></div>",
)


#: What may hold a whole page, furniture and all; None for nothing.
_WRAPPERS = (None, "id='page' class='site'", "class='wrapper container'", None, "class='site-content content-area'", "id='main-area' class='layout'", "class='page-body row'")


def _content(i: int) -> tuple[str, str]:
    shapes = (
        (f"<p>{_text(4, i)}</p><p>{_text(3, i + 2)}</p>", f"<p>{_text(2, i)} <b>Now</b> it was <a class='link' href='/x'>dry</a> again.</p>"),
        (f"<p>{_text(3, i + 1)}</p><blockquote>{_text(1, i)}</blockquote>", f"<h2>Later</h2><p>{_text(3, i + 4)}</p>"),
        (f"<ul class='list'><li>{_text(1, i)}</li><li>{_text(1, i + 3)}</li></ul><p>{_text(2, i)}</p>", f"<p>{_text(5, i + 1)}</p><p>So it was.</p>"),
        (f"<p>{_text(4, i + 2)}<br>{_text(1, i + 5)}", f"<p>{_text(2, i + 3)}<p>{_text(1, i)}"),
        (f"<figure><img src='a.png'><figcaption>{_text(1, i)}</figcaption></figure><p>{_text(4, i + 1)}</p>", f"<table><tr><th>Year</th><th>Level</th></tr><tr><td>One</td><td>Two metres</td></tr></table><p>{_text(2, i)}</p>"),
    )
    return shapes[i % len(shapes)]


#: Pages written out whole.
LABELLED = (
    f"<html><head><title>River</title><style>p {{margin: 0}}</style></head><body><nav>{_links('Home', 'News', 'Sport', 'About')}</nav>"
    f"<div class='ad'>Buy two boats for the price of one.</div><!--[--><article><h1>The flood</h1><p>{_text(4)}</p><p>{_text(3, 2)}</p></article><!--]-->"
    "<footer>&copy; The Paper. All rights reserved.</footer></body></html>",
    f"<html><body><header><a href='/'>The Paper</a> {_links('Home', 'Weather')}</header><div id='content'><!--[--><div class='story'><h2>After the rain</h2>"
    f"<p>{_text(3, 1)}</p><blockquote>{_text(1)}</blockquote><p>{_text(2)} <b>Now</b> it was <a href='/x'>dry</a> again.</p></div><!--]--></div>"
    f"<div class='sidebar'><h3>Related</h3>{_links('Storm', 'Drought', 'Harvest')}</div><form><input name='q'><button>Search</button></form></body></html>",
    f"<body><div class='cookie-notice'>We use cookies to improve this site. <button>Accept</button></div><main><!--[--><h1>Two views</h1><ul><li>{_text(1)}</li><li>{_text(1, 3)}</li></ul>"
    f"<p>{_text(5, 1)}</p><!--]--></main><section id='comments'><h3>Comments</h3><div class='comment'><p>First!</p></div><div class='comment'><p>I do not agree with this at all.</p></div></section></body>",
    f"<html><body><table><tr><td class='menu'>{_links('One', 'Two', 'Three')}</td><td><!--[--><p>{_text(4, 2)}<br>{_text(1, 5)}<p>{_text(2, 3)}</p><!--]--></td></tr></table>"
    "<div class='footer'>Contact us by letter or by telephone.</div><script>var a = '<p>not text</p>';</script></body></html>",
    f"<html><body><div class='banner'>Subscribe today and save</div><aside>{_links('Most read', 'Most shared')}</aside><!--[--><section><h1>Notes</h1><p>{_text(2)}</p><h2>Later</h2><p>{_text(3, 4)}</p></section><!--]-->"
    f"<div class='share'>{_links('Mail', 'Print')}</div></body></html>",
)


def labelled(pages: int = 112, around: int = 7) -> list[str]:
    """The pages: every kind of box occurs in at least seven of them."""
    boxes = _boxes()
    out, at = [], 0
    for i in range(pages):
        own = [boxes[(at + k) % len(boxes)] for k in range(around)]
        at += around
        a, b = _content(i)
        middle = own[0].replace("<header", "<div").replace("</header", "</div")
        frame = _FRAMES[i % len(_FRAMES)].format(h=_TITLES[i % len(_TITLES)], a=a, b=b, box=middle, side=own[1])
        head = f"<!DOCTYPE html><html><head><title>{_TITLES[i % 6]}</title><style>p {{margin: 0}}</style></head><body class='home has-sidebar'>"
        body = own[1] + own[2] + own[3] + frame + "".join(own[4:])
        wrapper = _WRAPPERS[i % len(_WRAPPERS)]
        if wrapper:
            body = f"<div {wrapper}>{body}</div>"
        out.append(head + body + "<script>var a = '<p>not text</p>';</script></body></html>")
    return out
