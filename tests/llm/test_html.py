from __future__ import annotations

import html as H
import math
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm.html import extract, main_text, smooth, threshold

SF = "/root/testdata/sf0.001"

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body>
<header><a href=/>Site name</a></header><nav><ul><li><a href=x>Home</a><li><a>About</a></ul></nav>
<div class="cookie-notice">We use cookies of many kinds, please accept them all or leave this place now.</div>
<main><article><h1>Title &amp; more</h1><p>First  paragraph
with <b>bold</b> words &eacute; and a <a href=y>link</a>, long enough to be seen as text by anyone.<p>Short.
<form><input value=z>Search here<button>Go</button></form><blockquote>A quote.</blockquote>
<script>var x = "<p>not text</p>";</script><aside>Related things to read after this one.</aside>
<section id="comments"><p>A reader says that this is very fine indeed, and so on and on.</p></section></article></main>
<div class="sidebar widget">Side</div><footer>Copyright words</footer></body></html>"""


def test_boilerplate_goes_and_all_else_stays():
    assert main_text(PAGE) == "Title & more\n\nFirst paragraph with bold words é and a link, long enough to be seen as text by anyone.\n\nShort.\n\nA quote."


@pytest.mark.parametrize("html, text", [("", ""), ("plain", "plain"), ("<p>a<p>b", "a\n\nb"), ("<div><p>x</p></div>", "x"), ("<script>x</script>", ""), ("<p>a<br>b&nbsp;c</p>", "a b c"), ("&lt;p&gt;", "<p>"), ("<p>open <b>never closed", "open never closed"), ("</p></div>x", "x"), ("<![CDATA[x]]><!-- c --><?php y ?>z", "z")])
def test_small_pages(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize("mark", ["<a href='", "<!--", "<![CDATA[", "<?", "</", "&#", "<p ", '<a href="x', "<script>", "<title>"])
def test_what_never_ends_takes_linear_time(mark):
    began = time.perf_counter()
    main_text(mark * 100_000)
    assert time.perf_counter() - began < 5


def test_marks_on_what_holds_the_article():
    page = '<body><div class="layout has-sidebar"><div class="post-header"><h1>Head line</h1></div><article><p>Text of it.</p><div class="article-header"><h2>Part</h2></div></article><div class="sidebar">Side</div></div><div id="ad-1">Buy</div></body>'
    assert main_text(page) == "Text of it.\n\nPart"
    assert main_text(page.replace("article>", "section>")) == "Head line\n\nText of it."


def test_content_region_without_article():
    body = "".join(f"<p>{'Word ' * 40}{i}</p>" for i in range(6))
    page = f"<body><div><ul>{'<li><a href=x>link</a>' * 20}</ul></div><div>{body}<p>End.</p></div><div><a>one</a> <a>two</a></div></body>"
    got = main_text(page).split("\n\n")
    assert len(got) == 7 and got[-1] == "End."


def words(n, name):
    return "".join(f"<p>{f'{name} ' * 40}{i}</p>" for i in range(n))


def test_no_content_is_dropped_for_what_holds_more():
    menu = f"<div><ul>{'<li><a href=x>link</a>' * 20}</ul></div>"
    for one, two in (("section", "section"), ("div", "section"), ("article", "div")):
        got = main_text(f"<body>{menu}<div><{one}>{words(8, 'first')}</{one}><{two}>{words(2, 'second')}<p>End.</p></{two}></div></body>").split("\n\n")
        assert len(got) == 11 and got[-1] == "End." and "link" not in got
    few = main_text(f"<body>{menu}<div><article>{words(3, 'first')}</article><div>{words(7, 'second')}</div></div></body>").split("\n\n")
    assert len(few) == 10
    beside = main_text(f"<body>{menu}<div><article>{words(3, 'first')}</article><div><a href=x>{'read on ' * 9}</a></div></div></body>").split("\n\n")
    assert len(beside) == 3


def test_the_threshold_selects():
    """On a page without article or marks: links and short lines around the text stay out because of the threshold,
    and no line does without one; on pages with an article what hints mark comes back without one."""
    side = "<div><ul><li><a href=x>one</a><li><a href=x>two</a></ul><p>Short</p></div>"
    page = f"<body>{side}<div>{words(5, 'text')}<p>End.</p></div>{side}</body>"
    everything = lambda ratios: -math.inf
    assert len(main_text(page).split("\n\n")) == 6
    assert len(main_text(page, bar_of=everything).split("\n\n")) == 12
    assert main_text(PAGE) != main_text(PAGE, bar_of=everything)
    assert "cookies" in main_text(PAGE, bar_of=everything) and main_text(page, bar_of=lambda r: math.inf) == ""


def test_smoothing_is_gaussian():
    rng = random.Random(3)
    values = [rng.random() * 100 for _ in range(40)]
    for sigma in (0.5, 1.0, 2.5):
        weight = lambda i, j: math.exp(-((i - j) ** 2) / (2 * sigma**2)) * (abs(i - j) <= math.ceil(3 * sigma))
        want = [sum(weight(i, j) * v for j, v in enumerate(values)) / sum(weight(i, j) for j in range(40)) for i in range(40)]
        assert smooth(values, sigma) == pytest.approx(want)
    assert threshold([1.0, 3.0]) == 1.0 and threshold([10.0, 10.0]) == 0.0 and threshold([0.0, 0.0, 0.0, 100.0]) == 25.0


@pytest.mark.parametrize("mark", ["<div>x", "<b>x", '<div class="ad">x<h1>', "<ul><li>x", "<p><b>x", "<article>x", "<form><h1>x", "<li><ul><b>x</li>", "<td>x<table>"])
def test_nesting_takes_linear_time(mark):
    began = time.perf_counter()
    main_text(mark * 100_000)
    assert time.perf_counter() - began < 8


def test_features_of_an_article():
    page = """<form action=x><div class="search"><a href=q>find</a></div><article><h1>Head</h1><p>Let <math><mi>x</mi></math> be a number of some length, as the text says here.</p>
<div class="related"><p>Related work is a part of this article and says at some length what others found.</p></div><div class="share"><a href=a>one</a> <a href=b>two</a></div>
<article class="comment"><p>A reader's words, which go on for as long as the text itself does, or longer.</p></article><ul class=promo><li>Buy</ul></article></form>"""
    assert main_text(page) == "Head\n\nLet x be a number of some length, as the text says here.\n\nRelated work is a part of this article and says at some length what others found."


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="<>/abdivp &;=\"'!-", max_size=80))
def test_any_markup_is_read(text):
    assert isinstance(main_text(text), str)


def test_pages_match_their_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in extract(spark.read.parquet(f"{SF}/pages.parquet")).collect():
        article = re.search("<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        blocks = [" ".join(H.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)[^>]*>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, "u", None, "q"), (1, "u", None, "q"), (None, None, "<p>" * 5000 + "deep", "q"), (2, "v", "<p>" + "x " * 500_000, "q")], "page_id long, url string, html string, text string")
    got = extract(rows).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", 0), ("1", 0), ("2", 999_999), ("None", 4)]
    assert extract(rows.limit(0)).count() == 0
