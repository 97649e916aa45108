"""What structure alone says about a block of a page."""

import pytest

from plumbline.llm import html_text

LONG = "A sentence of the page that says something of its own. " * 12


@pytest.mark.parametrize(
    "page",
    [
        f'<body class="page has-sidebar"><p>{LONG}</p></body>',
        f'<div class="content with-sidebar"><p>{LONG}</p></div>',
        f'<div class="col no-ads"><p>{LONG}</p></div>',
        f'<div id="share-price-analysis"><p>{LONG}</p></div>',
        f'<form id="aspnetForm" action="."><input name="x"><div><p>{LONG}</p></div></form>',
        f'<form><main><p>{LONG}</p></main></form>',
        f'<div class="shared-ownership"><p>{LONG}</p></div>',
        f'<div data-class="ad"><p>{LONG}</p></div>',
        f'<form><p>{LONG}</p>',
    ],
)
def test_content_is_not_taken_for_furniture(page):
    assert [text for kind, text in html_text.blocks(page) if kind != html_text.AROUND] == [LONG.strip()]


@pytest.mark.parametrize(
    "page",
    [
        '<div class="ad">x</div>',
        '<div class="ad-slot ad-728x90">x</div>',
        '<div id="cookieBanner">x</div>',
        '<section class="reader-comments"><div class="comment-body">x</div></section>',
        '<div class="site-footer">x</div>',
        '<ul class="main_nav">x</ul>',
        '<div class="notices">x</div>',
        '<div role="navigation">x</div>',
        '<div class="related-posts">x</div>',
        '<form><label>Mail</label><input name="m"> Get news by mail <button>Go</button></form>',
        "<nav>x</nav>",
    ],
)
def test_furniture_is_known_by_its_names(page):
    around = [text for kind, text in html_text.blocks(f"<p>own</p>{page}<p>text</p>") if kind != html_text.AROUND]
    assert around == ["own", "text"]


def test_furniture_inside_of_content_goes():
    page = f'<article><p>{LONG}</p><div class="share-buttons">Share this</div><p>end</p></article>'
    assert [text for kind, text in html_text.blocks(page) if kind == html_text.ARTICLE] == [LONG.strip(), "end"]


def test_an_article_begins_also_where_furniture_was_left_open():
    assert html_text.blocks("<nav><a>menu</a><article><p>own text</p></article>") == [(html_text.AROUND, "menu"), (html_text.ARTICLE, "own text")]


def test_unique_blocks_of_a_host_stay_and_shared_ones_go(spark):
    shared = "this line of the host stands on each of its pages and is of no use"
    pages = [
        (i, f"http://host/{i}", f'<body class="has-sidebar"><div class="top-line">{shared}</div><div><p>page {i} has {" ".join(f"word{i}x{k}" for k in range(20))}</p></div></body>')
        for i in range(6)
    ]
    rows = html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in rows} == {i: f"page {i} has " + " ".join(f"word{i}x{k}" for k in range(20)) for i in range(6)}
