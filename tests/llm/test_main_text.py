"""Main text of pages: the given pages against plain slicing, own pages of many shapes, and markup that is broken."""

import html
import re

import pytest

from claimspark.llm import main_text as m

LONG = "The first sentence of the article, which is long enough, has commas, and goes on for a while. "
STORY = [LONG + "One.", "Short one.", LONG * 3 + "Three & more.", LONG + "Four."]
PARAGRAPHS = "".join(f"<p>{html.escape(t)}</p>" for t in STORY)
TEXT = "\n\n".join(STORY)
MENU = "<ul>" + "".join(f'<li><a href="/{i}">Topic number {i}</a></li>' for i in range(8)) + "</ul>"
REMARKS = "".join(f"<div class='comment'><p>{LONG * 4} says reader {i}.</p></div>" for i in range(6))

PAGES = {
    "article": f"<html><head><title>T</title><script>if (a<b) document.write('</p><p>no</p>')</script></head><body><nav>{MENU}</nav><article><h1>Head</h1>{PARAGRAPHS}</article><footer>&copy; us</footer>",
    "divs": f"<body><div id=top class='site-header'>Our site, {LONG}</div><div id='content'><h1>Head</h1>{PARAGRAPHS}</div><div class='sidebar'><p>{LONG * 9}</p></div></body>",
    "comments": f"<body><article><h1>Head</h1>{PARAGRAPHS}<section id='comments'>{REMARKS}</section></article></body>",
    "comments beside": f"<body><main><div class='post'><h1>Head</h1>{PARAGRAPHS}</div><div class='comment-list'>{REMARKS}</div></main></body>",
    "comments as articles": f"<body><article><h1>Head</h1>{PARAGRAPHS}</article><section class=comments><article><p>{LONG * 20}</p></article></section></body>",
    "notices": f"<div class='cookie-notice' role=dialog><p>{LONG * 8}</p></div><div class='page'><h1>Head</h1>{PARAGRAPHS}<aside>{LONG}</aside><form><p>Your name, please</p><button>Go</button></form></div>",
    "adverts inside": f"<article><h1>Head</h1>{PARAGRAPHS.replace('<p>Short', '<div class=ad-box><div class=ad>Buy, buy, buy.</div></div><p>Short')}</article>",
    "in a form": f"<body><form id=aspnet><div class='main-header'><a href=/>Home</a></div><article><h1>Head</h1>{PARAGRAPHS}</article></form></body>",
    "header of the article": f"<header><h1>The site</h1></header><article><header><h1>Head</h1></header>{PARAGRAPHS}<footer>By the desk</footer></article>",
    "never closed": "<body><article><h1>Head<p><b>" + "<p>".join(html.escape(t) + "<br>" for t in STORY),
    "hidden": f"<article><h1>Head</h1><p style='display: none'>not shown</p><p hidden>nor this</p>{PARAGRAPHS}<!-- <p>nor this</p> --></article>",
    "links at the end": f"<div><h1>Head</h1>{PARAGRAPHS}{MENU}</div>",
    "wrapped": f"<body class='has-sidebar'><div class='layout sidebar-left'><main><section><h1>Head</h1>{PARAGRAPHS}</section></main></div></body>",
}


@pytest.mark.parametrize("name", PAGES)
def test_the_article_and_nothing_else(name):
    assert m.main_text(PAGES[name]) == "Head\n\n" + TEXT


def test_blocks_references_and_white_space():
    page = "<article><p>a &amp; b&nbsp;&#8364;\n\t c<br>d <i>e</i>f</p>loose<ul><li>one<li>two</ul><table><tr><td>x<td>y</table>&lt;p&gt;</article>"
    assert m.main_text(page) == "a & b € c d ef\n\nloose\n\none\n\ntwo\n\nx\n\ny\n\n<p>"
    assert m.main_text("<article><p>1 < 2 and 3 > 2</p><p>a<b</p></article>").startswith("1 < 2 and 3 > 2")


def test_siblings_of_the_best_container_are_kept():
    part = f"<p>{LONG * 2}</p><p>{LONG}</p>"
    page = f"<body><h2>Head</h2><div>{part}{part}</div><div>{part}</div><p>{LONG}</p><div><a href=/>More</a> <a href=/>news</a></div></body>"
    assert m.main_text(page).split("\n\n") == ["Head", *[t.strip() for t in [LONG * 2, LONG] * 3], LONG.strip()]


def test_nothing_to_read():
    for page in (None, "", " \n", "<html></html>", "<nav>menu</nav>", "<script>x", "<!-- x", "<p>", "</div></p>"):
        assert m.main_text(page) == ""
    assert m.main_text("only words") == "only words"


@pytest.mark.parametrize("piece", ["<", "<a href='", '<a b="', "<!--", "</", "<p>", "<a", "<b><p>x", "<div>", "<ul><li>x", "&amp", "<?", "<table>", "<a b=\"'>", "<p><table><div>"])
def test_broken_and_deep_markup_takes_time_in_proportion(piece):
    import time

    t = time.process_time()
    m.main_text(piece * 30_000 + "<p>end")
    assert time.process_time() - t < 6


def plain(page):
    inside = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = (" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside))
    return "\n\n".join(b for b in blocks if b)


def test_given_pages(spark):
    got = {r.page_id: r for r in m.op11_main_text(spark, "/root/testdata/sf0.001").collect()}
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        r = got[p.page_id]
        assert (r.url, r.text, r.n_chars) == (p.url, plain(p.html), len(plain(p.html)))


def test_awkward_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars string, i int, u int, h int"
    rows = [(1, None, None, "t", "n", 1, 2, 3), (None, "u", "", "t", "n", 1, 2, 3), (2, "u", "<p>x", "t", "n", 1, 2, 3), (2, "u", "<p>x", "t", "n", 1, 2, 3), (3, "v", "<p>" + "word, " * 200_000, None, None, None, None, None)]
    got = m.extract_main_text(spark.createDataFrame(rows, schema))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.url or "", r.n_chars) for r in got.collect()) == [(0, "u", 0), (1, "", 0), (2, "u", 1), (2, "u", 1), (3, "v", 6 * 200_000 - 1)]
    assert m.extract_main_text(spark.createDataFrame([], schema)).count() == 0
