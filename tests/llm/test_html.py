"""Main text of pages."""

from __future__ import annotations

import math
import random
import time

import pyarrow.parquet as pq
import pytest

from visitframe.llm import html_density

BODY = "".join(f"<p>Sentence {k} of the article has some <b>words</b> &amp; more text to read, so it is dense.</p>" for k in range(6))
WANT = "\n\n".join(f"Sentence {k} of the article has some words & more text to read, so it is dense." for k in range(6))
AROUND = (
    "<html><head><title>t</title><style>p{}</style><script>var x='<p>no</p>';</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav>"
    "<div class='sidebar'><p>Side text of some length</p></div>{}<div id='comments'><article class='comment'><p>I disagree with it.</p></article></div>"
    "<form><input><label>Your name</label></form><footer>Imprint</footer></body></html>"
)


def test_article_without_its_surroundings():
    for inner in (f"<article>{BODY}</article>", f"<div class='content'>{BODY}</div>", f"<main><header><h1>T</h1></header>{BODY}</main>"):
        got = html_density.main_text(AROUND.replace("{}", inner))
        assert got in (WANT, "T\n\n" + WANT)


def test_white_space_and_references():
    got = html_density.main_text("<div><p> a&nbsp;b \n\t c&#233; </p><p>d<br>e</p></div>")
    assert got == "a b cé\n\nd e"


def test_defined_cases(spark):
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (3, "u", "plain text, no tag"), (4, "u", "<p>open <b>tags"), (5, "u", deep), (6, "u", "<!-- only -->"), (None, "u", "< 3 <"), (7, "u", f"<article>{BODY * 2000}</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text")
    got = {r["page_id"]: r["text"] for r in html_density.extract(pages).collect()}
    assert got[1] == got[2] == got[6] == "" and got[3] == "plain text, no tag" and got[4] == "open tags" and got[5] == "deep text"
    assert got[7].count("\n\n") == 6 * 2000 - 1 and got[None]
    assert html_density.extract(pages).count() == len(rows) and html_density.extract(pages.limit(0)).count() == 0


LAYOUT_NAMES = [
    "layout has-sidebar", "page-with-menu", "col content no-sidebar", "post social-post", "commentary-article", "article-share-wrapper",
    "site search-page", "social-science", "page-with-nav", "promotion-of-science",
]


@pytest.mark.parametrize("name", LAYOUT_NAMES)
def test_wrappers_keep_their_article(name):
    for inside in (BODY, f"<article>{BODY}</article>"):
        for page in (f"<div class='{name}'>{inside}</div>", f"<div id='{name.replace(' ', '-')}'>{inside}</div>"):
            assert html_density.main_text(AROUND.replace("{}", page)) == WANT


@pytest.mark.parametrize("name", ["sidebar", "left-sidebar", "ad", "ad-slot", "cookie-banner", "comment-list", "main-nav", "related", "siteFooter", "x newsletter y"])
def test_named_furniture_goes(name):
    extra = f"<div class='{name}'><p>This text is not of the article, and it is of some length too.</p></div>"
    for inside in (BODY, f"<article>{BODY}</article>", f"<h1>T</h1>{BODY}"):
        got = html_density.main_text(f"<body>{extra}<div>{inside}</div>{extra}</body>")
        assert got.removeprefix("T\n\n") == WANT


LONG = "".join(f"<p>Paragraph {k} of a block is long, has no link at all and says this and that about the matter at hand. </p>" for k in range(3))
LONG_WANT = "\n\n".join(f"Paragraph {k} of a block is long, has no link at all and says this and that about the matter at hand." for k in range(3))


@pytest.mark.parametrize("name", ["elementor-widget", "widget", "teaser", "content-widget x", "promo", "banner", "notice"])
@pytest.mark.parametrize("head", ["h1", "h2"])
def test_pages_built_of_marked_blocks(name, head):
    blocks = f"<div class='{name}'><{head}>T</{head}></div><div class='{name}'>{LONG}</div><div class='{name}'>{LONG}</div>"
    for page in (blocks, f"<div class='page'>{blocks}</div>", f"<header>Site</header>{blocks}<div class='sidebar'><div class='widget'><p>Aside.</p></div></div>"):
        assert html_density.main_text(f"<body><nav>menu</nav>{page}<footer>imprint</footer></body>") == f"T\n\n{LONG_WANT}\n\n{LONG_WANT}"


PARTS = [
    "p class='article-teaser'", "p class='teaser'", "div class='text-widget'", "section class='responsible-menu'", "blockquote class='comment'", "p class='promo'",
    "section id='discussion'",
]


@pytest.mark.parametrize("part", PARTS)
def test_marked_parts_of_articles_stay(part):
    own = f"<{part}>This part of the article has a name that menus and boxes have as well.</{part.split()[0]}>"
    want = "This part of the article has a name that menus and boxes have as well.\n\n" + WANT
    assert html_density.main_text(f"<body><nav>x</nav><article>{own}{BODY}</article></body>") == want
    if "teaser" in part or "promo" in part:
        assert html_density.main_text(f"<body><nav>x</nav><div class='content'>{own}{BODY}</div></body>") == want


BOXES = [
    "id='header'", "class='header'", "class='site-header'", "class='page-header'", "class='top-bar'", "class='top-nav-bar'", "class='main-menu-container'",
    "class='site-footer-inner'", "class='google-ad-container'", "class='cc-window'", "class='related-posts'", "class='author-bio'", "class='discussion'",
    "class='outbrain'", "class='announcement'", "class='header-inner'", "class='promo'", "class='comment'",
]


@pytest.mark.parametrize("box", BOXES)
def test_named_boxes_go(box):
    extra = f"<div {box}><h3>Some words</h3><p>This text is not of the article, and it is of some length too.</p></div>"
    for page in (f"{extra}<div><h1>T</h1>{BODY}</div>{extra}", f"{extra}<article><h1>T</h1>{BODY}</article>", f"<article><h1>T</h1>{BODY}{extra}</article>"):
        assert html_density.main_text(f"<body>{page}</body>") == "T\n\n" + WANT
    if "header" not in box:
        assert html_density.main_text(f"<body><div>{extra}{BODY}</div></body>") == WANT


@pytest.mark.parametrize("name", ["article-header", "post-header", "entry-header", "header-of-section", "candy-bar", "discussions-of-science"])
def test_headers_of_articles_stay(name):
    own = f"<div class='{name}'><h2>Title</h2><p>By somebody, who wrote this on a fine day.</p></div>"
    for page in (f"<article>{own}{BODY}</article>", f"<div>{own}{BODY}</div>"):
        assert html_density.main_text(f"<body>{page}</body>") == "Title\n\nBy somebody, who wrote this on a fine day.\n\n" + WANT


def test_comments_longer_than_an_article_without_heading():
    comments = "".join(f"<div class='comment'><p>{'I think otherwise about that. ' * 9}</p></div>" for _ in range(30))
    assert html_density.main_text(f"<body><div>{BODY * 3}</div>{comments}</body>") == "\n\n".join([WANT] * 3)


def test_a_form_around_the_page():
    assert html_density.main_text(f"<body><form><nav>menu</nav><div>{BODY}</div><input><label>Name</label></form></body>") == WANT
    assert html_density.main_text(f"<body><h1>T</h1><div>{BODY}</div><form><p>Please write your name here and send it.</p></form></body>") == "T\n\n" + WANT


def test_title_and_short_paragraphs_stay():
    long = "A very long text of the page. " * 60
    for core in (BODY, long):
        got = html_density.main_text(f"<div><h1>Title</h1><div class=a>{core}</div><p>Short end.</p></div>").split("\n\n")
        assert got[0] == "Title" and got[-1] == "Short end."


def test_many_comments_under_a_short_article():
    comments = "".join(f"<article class='comment'><p>{'I think otherwise about that. ' * 9}</p></article>" for _ in range(30))
    assert html_density.main_text(f"<body><article><h1>T</h1>{BODY}</article><div id='comments'>{comments}</div></body>") == "T\n\n" + WANT
    assert html_density.main_text(f"<body><div><h1>T</h1>{BODY}</div><div class='comments'>{comments}</div></body>") == "T\n\n" + WANT


def test_menus_without_names_go_by_density():
    menu = "<div>" + "".join(f"<a href=x>entry number {k}</a> " for k in range(30)) + "</div>"
    assert html_density.main_text(f"<body>{menu}<div><h1>T</h1>{BODY}</div>{menu}</body>") == "T\n\n" + WANT


def test_references_are_decoded_in_each_text_node():
    assert html_density.main_text("<p>AT&<b>amp;</b> &lt<i>;</i> &am<!-- x -->p; &amp;lt;</p>") == "AT&amp; <; &amp; &lt;"


K = 1 << 20
HOSTILE = {
    "inline ends": "<b>" * (K // 7) + "</i>" * (K // 8),
    "ends through a block": "<i><div>" + "<b>" * (K // 6) + "</i>" * (K // 8),
    "headers": "<main>" + "<header>" * (K // 8) + "<h2>x",
    "quotes": '<a ">"' * (K // 6),
    "attributes": "<a " + "a=' " * (K // 4) + ">",
    "items": "<li><ul>" + "<div>" * (K // 10) + "<li></li>" * (K // 18),
    "rules": "<b>" * (K // 6) + "<hr>" * (K // 8),
    "cells": "<table>" + "<tr><td>" * (K // 8),
    "paragraphs": "<p>x" * (K // 4),
    "comments": "<!-" * (K // 3),
    "scripts": "<script></script" * (K // 16),
    "ampersands": "&" * K,
    "less": "<" * K,
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_hostile_pages_take_linear_time(name):
    start = time.monotonic()
    html_density.main_text(HOSTILE[name])
    assert time.monotonic() - start < 15  # 1 to 2 s on an idle core; hours where tags search the stack


def random_page(rng: random.Random, depth: int = 0) -> str:
    out = []
    for _ in range(rng.randint(1, 5)):
        kind = rng.random()
        if kind < 0.4 or depth > 4:
            out.append(" ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 12))))
        elif kind < 0.55:
            out.append(f"<a href=x>{'link ' * rng.randint(1, 4)}</a>")
        else:
            tag = rng.choice(["div", "section", "span", "ul", "b"])
            out.append(f"<{tag}>{random_page(rng, depth + 1)}</{tag}>")
    return "".join(out)


def test_densities_against_the_formula():
    def plain(node) -> tuple[int, int, int, int]:
        """Characters, tags, and those in links, by recursion."""
        c = t = lc = lt = 0
        for part in node.parts:
            if isinstance(part, str):
                c += sum(not x.isspace() for x in part)
            else:
                own = plain(part)
                c, t, lc, lt = c + own[0], t + own[1] + 1, lc + own[2], lt + own[3] + (part.tag == "a")
        return (c, t, c, t) if node.tag == "a" else (c, t, lc, lt)

    def density(node, ratio: float) -> float:
        c, t, lc, lt = plain(node)
        if not c:
            return 0.0
        t = max(t, 1)
        base = math.log(math.log(c / max(c - lc, 1) * lc + ratio * c + math.e))
        return c / t * (math.log(c / max(lc, 1) * t / max(lt, 1)) / base if base > 1e-12 else 1.0)

    rng = random.Random(5)
    for _ in range(200):
        order = html_density.prune(html_density.parse(random_page(rng)))
        html_density.measure(order)
        c, _, lc, _ = plain(order[0])
        ratio = lc / max(c, 1)
        sums = []
        for node in order:
            assert math.isclose(node.density, density(node, ratio), rel_tol=1e-12)
            sums.append(sum(density(p, ratio) for p in node.parts if not isinstance(p, str)))
            assert math.isclose(node.sum, sums[-1], rel_tol=1e-12)
        best = max(order, key=lambda v: v.sum)
        assert math.isclose(best.sum, max(sums), rel_tol=1e-12)


def test_density_alone_finds_the_articles():
    """Without any use of article and main elements the given pages have the same texts."""
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist():
        if page:
            order = html_density.prune(html_density.parse(page))
            html_density.measure(order)
            assert html_density.render(html_density.choose(order, semantic=False)) == html_density.main_text(page)
            bare = page.replace("<article>", "<div>").replace("</article>", "</div>")
            assert html_density.main_text(bare) == html_density.main_text(page)
