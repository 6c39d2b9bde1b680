"""Whole pages with known articles, pages without containers, and broken markup."""

import html
import re
import time

import pytest

from tickloom.llm import html_text as h

LONG = "This is the story of a town that was on the hill and of the people who had been there for as long as they could say it. " * 2

FULL = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="nav-open">
<header id=top><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a><li><a href="/b">B</a></ul></nav>
<div class="cookie-notice">We use cookies on this site.</div><div class="ad">Buy now and save on all the things you need.</div>
<article><header><h1>The &amp; title</h1></header><p>{LONG}<p>Short.<br>Next&nbsp;line &lt;b&gt; &#233;&eacute;
   end</p><script>var t="</p>";</script><!-- gone --><div class="share-bar"><a href=x>Share</a></div>
<ul><li>one</li><li>two</li></ul><form><label>Mail</label><input value=x><button>Go</button></form>
<table><tr><td>cell a</td><td>cell b</td></tr></table><section class="comments"><p>First! {LONG}</p></section></article>
<aside><p>{LONG}</p></aside><div hidden>hidden text</div><footer>&copy; all rights</footer></body></html>"""

WANT = ["The & title", LONG.strip(), "Short. Next line <b> éé end", "one", "two", "cell a", "cell b"]


def test_article_with_everything_around_it():
    assert h.main_text(FULL).split("\n") == WANT


def test_page_without_containers_goes_by_two_passes():
    page = f"""<div><a href=1>One link here</a> <a href=2>and another</a></div><div>Fri 12</div><h2>Heading</h2><p>{LONG}</p><p>Tiny.</p><p>{LONG}</p>
    <div><a href=3>More of the links that are on the page and of the site</a></div><div>xyz</div><div><a href=4>End</a></div>"""
    assert h.main_text(page).split("\n")[-3:] == [LONG.strip(), "Tiny.", LONG.strip()]
    assert "Heading" in h.main_text(page) and "link" not in h.main_text(page) and "xyz" not in h.main_text(page)


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("   ", ""),
        ("<p>", ""),
        ("<article>a < b &amp; c > d", "a < b & c > d"),
        ("<article><p>x<article><p>y</article></article>", "x\ny"),
        ("<article><p title='a>b'>x <b>y</p></b><p>z", "x y\nz"),
        ("<article><p>a<script>never closed <p>b", "a"),
        ("<article><!-- never closed <p>b", ""),
        ("<ARTICLE><P CLASS='Ad'>no</P><P>yes</P></ARTICLE>", "yes"),
        ("<article><p class=lead-ad>no<p class=leading>yes</article>", "yes"),
        ("<article><p>in <span style='display:none'>no</span> out</article>", "in out"),
        ("<article></div></section><p>stray ends</article>", "stray ends"),
    ],
)
def test_small_and_broken_pages(page, want):
    assert h.main_text(page) == want


def test_body_in_a_div_beside_article_cards():
    cards = "".join(f"<article><h3><a href=/{i}>Card number {i} of the week</a></h3><p>A teaser for you, in a few words. {'Read it all there. ' * 5}</p></article>" for i in range(3))
    page = f"<body><div class=body><h1>Headline</h1><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></div><div>{cards}</div></body>"
    blocks = h.blocks_of(page)
    assert sum(len(b.text) for b in blocks if b.article) >= 0.25 * sum(len(b.text) for b in blocks)
    got = h.main_text(page)
    assert got.startswith("\n".join(["Headline", LONG.strip(), "Short one.", LONG.strip()])) and "Card number" not in got


def test_dense_block_outside_an_article_stays_and_short_ones_go():
    page = f"<div>Fri 12</div><article><p>{LONG}</p><p>{LONG}</p><p>Short.</p></article><div><p>{LONG}</p></div>"
    assert h.main_text(page).split("\n") == [LONG.strip(), LONG.strip(), "Short.", LONG.strip()]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<html><head><meta charset=x><title>T</title><body><article><p>a</article>", "a"),
        ("<html><head><title>T</title><link rel=x><noscript><img></noscript><article><p>a</article>", "a"),
        ("<html><head><noscript>no<body><article><p>a</article>", "a"),
        ("<head><title>T</title></head><article>a</article>", "a"),
        ("<article><div>a<object>no <p>no</p></div><p>b</article>", "a\nb"),
        ("<article><p>a <svg><g>no</g></svg> b</p><div><video>no</div><p>c</article>", "a b\nc"),
        ("<article><p>a <noscript><p>no</p></noscript> b</p></canvas>c</article>", "a b\nc"),
        ("<article><p>a<style>never closed <p>b", "a"),
    ],
)
def test_heads_and_mute_elements_without_end_tags(page, want):
    assert h.main_text(page) == want


BROKEN = ["<a ", '<p x="', "<p x='", "<!", "<script ", "<!--", "<a \"<b '", '<p x="y" ', "<a \"'", "</div ", '<a b="<a<a', "<p x=\"'\" y='\"'", "</script", "<div class=", "&#", "< "]


@pytest.mark.parametrize("form", BROKEN)
def test_a_long_page_of_broken_tags_takes_linear_time(form):
    start = time.process_time()
    h.main_text(form * (1_000_000 // len(form)))
    h.main_text("<article><p>ab" + form * (1_000_000 // len(form)))
    assert time.process_time() - start < 8


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "</p>" * 100_000, "<svg>" + "<g>" * 100_000 + "</p>" * 100_000, "<div class=ad>" * 60_000 + "x", "<div class=ad><p>x" * 40_000])
def test_deep_nesting_takes_linear_time(page):
    start = time.process_time()
    h.main_text(page)
    assert time.process_time() - start < 8


@pytest.mark.parametrize("shell", ['<div class="layout with-sidebar">', '<div class="page has-sidebar">', '<div id="search-page">', '<form action="/x">', '<div class="page-header-fixed"><div class="menu-open">'])
@pytest.mark.parametrize("inner", ["<article><h1>Title</h1><p>{0}</p></article>", "<div><h1>Title</h1><p>{0}</p></div>", "<h2>Title</h2><p>{0}</p><p>{0}</p>"])
def test_a_wrapper_is_no_furniture(shell, inner):
    page = f"<body><nav>Menu</nav>{shell}{inner.format(LONG)}<div class=sidebar><p>{LONG[:80]}</p></div></div></div></form><footer>end</footer>"
    assert h.main_text(page).split("\n") == ["Title"] + [LONG.strip()] * inner.count("{0}")


def test_named_furniture_stays_out():
    for name in ("class=comments", "class=discussion", "id=comments", 'class="sidebar"', 'class="ad"'):
        page = f"<article><h1>Title</h1><p>{LONG}</p></article><section {name}><h2>Discussion</h2><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></section>"
        got = h.main_text(page)
        if name in ("class=comments", "class=discussion", "id=comments"):
            assert got == f"Title\n{LONG.strip()}"
    page = f"<article><h1>T</h1><p>{LONG}</p><section id=discussion><h2>Discussion</h2><p>{LONG}</p></section></article>"
    assert h.main_text(page).count(LONG.strip()) == 2
    assert h.main_text(f"<div class=cookie-notice>{LONG}</div>") == ""
    assert h.main_text(f"<div class=comments><article><p>{LONG}</p></article><article><p>{LONG}</p></article></div>") == ""


def test_short_pages_without_containers():
    text = LONG[:121].strip()
    assert h.main_text(f"<nav>Menu</nav><p>{text}</p>") == h.main_text(f"<p>{text}</p>") == text
    half = LONG[:100].strip()
    assert h.main_text(f"<nav>Menu</nav><p>{half} <button>Press</button> {half}<p>{LONG}") == f"{half} {half}\n{LONG.strip()}"
    assert h.main_text(f"<p>{half} <select><option>a<option>b</select> {half}<p>{LONG}") == f"{half} {half}\n{LONG.strip()}"


def test_scripts_and_languages_without_stop_words():
    russian = "Это история города на холме и людей, которые жили там столько, сколько они себя помнили. " * 3
    italian = "Questa storia parla della città sulla collina, degli abitanti rimasti lassù molti anni. " * 3
    for prose in (russian.strip(), italian.strip()):
        assert h.main_text(f"<nav>Menu</nav><div><p>{prose}</p><p>{prose}</p></div><footer>end</footer>") == f"{prose}\n{prose}"


def test_given_pages_without_their_containers(spark):
    """Every given page, its article made a plain division: furniture all goes, long dense blocks all stay.

    The prose of these pages is made of random syllables, so that some of its blocks have no stop word.
    """
    kept = whole = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        page = r.html.replace("<article>", "<div>").replace("</article>", "</div>")
        inside = {b.text for b in h.blocks_of(f"<div>{inner}</div>")}
        got = set(h.main_text(page).split("\n")) - {""}
        assert got <= inside and {t for t in inside if len(t) > h.LONG and h._stop_density(t) >= h.STOP_HIGH} <= got
        kept, whole = kept + sum(map(len, got)), whole + sum(map(len, inside))
    assert kept > 0.9 * whole, kept / whole


def test_long_page_drops_nothing():
    parts = [f"Paragraph {i} of the text &amp; more" for i in range(20_000)]
    page = "<nav>menu</nav><article>" + "".join(f"<p>{p}</p>" for p in parts) + "</article>"
    assert h.main_text(page).split("\n") == [html.unescape(p) for p in parts]


def test_given_pages_give_their_articles(spark):
    rows = h.report(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").drop("url"), "page_id").collect()
    for r in rows:
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        cut = re.split(r"</?(?:p|h1)\b[^>]*>", inner)
        text = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in cut]
        assert r.text == "\n".join(x for x in text if x) and r.n_chars == len(r.text)


def test_tables(spark):
    df = spark.createDataFrame([(1, None, FULL, "t"), (None, "u", None, "t"), (1, None, FULL, "t")], "page_id long, url string, html string, text string")
    assert [r.text for r in h.extract(df).collect()] == ["\n".join(WANT), "", "\n".join(WANT)]
    assert [len(r.blocks) for r in h.blocks(df).collect()][1] == 0
    assert h.report(df.limit(0)).count() == 0
