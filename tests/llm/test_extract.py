import itertools
import random
import re
import time
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from refscope.llm import extract as X
from refscope.llm.queries import QUERIES


def price(labels, costs, edges):
    own = sum(max(-c, 0) if good else max(c, 0) for c, good in zip(costs, labels))
    return own + sum(w for a, b, w in edges if labels[a] != labels[b])


def test_minimum_cut_against_all_labellings():
    rng = random.Random(1)
    for _ in range(600):
        costs = [rng.randint(-9, 9) for _ in range(rng.randint(0, 8))]
        edges = [(a, b, rng.randint(0, 6)) for a in range(len(costs)) for b in range(a) if rng.random() < 0.5]
        best = min(price(x, costs, edges) for x in itertools.product((False, True), repeat=len(costs)))
        assert price(X.minimum_cut(costs, edges), costs, edges) == best


def text(html):
    return X.main_text(html, X.PRIOR)[0].split("\n\n") if html else X.main_text(html, X.PRIOR)[0]


ARTICLE = """<HTML><BODY class="has-sidebar"><HEADER><H1>Site</H1><NAV><UL><LI><A HREF="/">Home</A><LI><A>News</A></UL></NAV></HEADER>
<div class="cookie-banner"><p>This site uses cookies. They are good for you.</p><button>OK</button></div>
<form><input value="q"><label>Search this site</label></form>
<MAIN><ARTICLE class="post"><header class="entry-header"><h1>Real title</h1></header>
<p>Para one <b>bold<p>Para&nbsp;two &lt;tag&gt; &#233; &amp x<br>y
<aside class="quote"><p>Pulled out, says the article.</p></aside><!-- <p>not this --><div class="advert">Buy this now. It is cheap.</div>
<blockquote>Quoted words here.</blockquote><ul><li>Item <i>o</i>ne<li>Item two</ul><table><tr><td>c1<td>c2</table>
<script>x="<p>no</p>"</script><style>p{}</style><p hidden>secret</p><p style="display: none">unseen</p></ARTICLE>
<section id="comments"><h2>Comments</h2><article><p>Great post, I enjoyed it a lot. Thank you!</p></article></section></MAIN>
<aside>Related: <a>x</a></aside><footer><p>Footer text here, a sentence.</p></footer>"""


def test_article_without_all_around_it():
    want = ["Real title", "Para one bold", "Para two <tag> é & x y", "Quoted words here.", "Item one", "Item two", "c1", "c2"]
    assert text(ARTICLE) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<form id="f"><div id="content"><article><h1>T</h1><p>Some words. And so on.</p></article></div></form>', ["T", "Some words. And so on."]),
        ('<div class="page with-sidebar"><div class="sidebar"><p>Side text.</p></div><main><p>Main text.</p></main></div>', ["Main text."]),
        (
            '<div class="layout with-sidebar"><div class="sidebar">Side words.</div><div class="content"><h2>T</h2><p>One two three four '
            "five six.</p><ol class=commentlist><li>Nice. Really.</ol></div></div>",
            ["T", "One two three four five six."],
        ),
        ('<nav><a>x</a></nav><div class="cookie-notice"><p>We value you. Please accept.</p></div>', [""]),
        ("just text, no tags at all.", ["just text, no tags at all."]),
        ('<article><p>abc &amp def</p><p>ghi <a href="x', ["abc & def", "ghi"]),
        ("<article><p>2 < 3 and <3</p><p a=\"x>y\" b='>'>z</p></article>", ["2 < 3 and <3", "z"]),
        ("<article><p>one</p></p></b></div><p>two</p></article>", ["one", "two"]),
    ],
)
def test_layouts(html, want):
    assert text(html) == want


def test_a_page_without_names_is_cut_by_neighbours():
    page = (
        "<body><div><a href=/>Home</a> <a href=/a>About us</a></div><div>We use cookies to improve things. <a>Accept</a></div><div><h1>A long "
        "title</h1><p>First paragraph, with a <a href=x>link</a>, goes on for some words. It does.</p><p>Short</p><ul><li>one item</li>"
        "<li>two items</li></ul><p>Last paragraph, which also has words in it.</p></div><div>&copy; 2020 Site. All rights reserved.</div>"
    )
    found = text(page)
    assert found[0] == "A long title" and found[2:5] == ["Short", "one item", "two items"] and len(found) == 6
    blocks = X.blocks_of(page)
    assert [b.text for b in blocks if X.minimum_cut([1 if x is b else -1 for x in blocks], []) != [x is b for x in blocks]] == []


@pytest.mark.parametrize("html", ["<p>" * 50_000, "<div>" * 20_000 + "x.", '<a b="' * 50_000, "<" * 100_000, "<li>x" * 20_000, "<!--" * 50_000])
def test_hostile_pages_take_linear_time(html):
    started = time.time()
    X.main_text(html, X.PRIOR)
    assert time.time() - started < 10


def test_fit_moves_weights_towards_the_blocks():
    assert np.array_equal(X.fit([]), X.PRIOR) and np.array_equal(X.fit([(5, 1, [1, 3, 0, 1, 0, 0, 0])]), X.PRIOR)
    links = X.fit([(50, 1, [1, 4, 0, 1, 0, 0, 0]), (10, 0, [1, 2, 10, 0, 0, 0, 0])])
    assert links[2] < X.PRIOR[2] and links[1] > X.PRIOR[1]
    a = X.fit([(500, 1, [1, 4, 0, 1, 0, 0, 0]), (100, 0, [1, 2, 10, 0, 0, 0, 0])])
    assert np.allclose(a, links)


def test_edge_rows_and_clashing_columns(spark):
    rows = [(1, ARTICLE), (1, ARTICLE), (2, None), (3, ""), (None, "<nav><a>x</a></nav>"), (4, "word. " * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("t")).withColumn("row", F.lit("r"))
    found = X.extracted(pages, F.col("html"), X.fitted(pages, F.col("html"))).collect()
    got = sorted((r.row.page_id or 0, len(r.text), r.row.text, r.row.row) for r in found)
    size = len("\n\n".join(text(ARTICLE)))
    assert got == [(0, 0, "t", "r"), (1, size, "t", "r"), (1, size, "t", "r"), (2, 0, "t", "r"), (3, 0, "t", "r"), (4, 1_199_999, "t", "r")]
    empty = pages.limit(0)
    assert np.array_equal(X.fitted(empty, F.col("html")), X.PRIOR)
    assert X.extracted(empty, F.col("html"), X.PRIOR).count() == 0


def test_query_against_the_articles_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    found = QUERIES["op11_main_text"](spark, sf)
    assert found.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    got = {r.page_id: r for r in found.collect()}
    assert len(got) == len(pages)
    for page in pages:
        inside = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        parts = [" ".join(unescape(re.sub("</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        want = "\n\n".join(p for p in parts if p)
        assert (got[page.page_id].text, got[page.page_id].n_chars, got[page.page_id].url) == (want, len(want), page.url)
