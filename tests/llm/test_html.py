import time

import numpy as np
import pytest

from panelfactor.llm import html_extract

#: Pages of other build than the training generator's, written by hand, each with its main text.
PAGES = {
    "blog": (
        """<!doctype html><html lang=en><head><meta charset=utf-8><title>On bread</title><style>p{margin:0}</style></head><body class="single">
        <div id="page"><header id="masthead" class="site-header"><a href="/">Baker's notes</a><nav class="main-navigation"><ul><li><a href="/about">About</a><li><a href="/recipes">Recipes</a></ul></nav></header>
        <main id="primary"><article class="post-412 post type-post"><h1 class="entry-title">On bread</h1>
        <div class="entry-content"><p>Flour, water &amp; salt are all that <em>bread</em> needs.<p>Time does the rest: a slow rise overnight gives the crumb its holes
        and the crust its colour.</p><blockquote><p>Never hurry a dough.</p></blockquote><ul><li>500 g flour<li>350 g water<li>10 g salt</ul><p>Bake it hot.</div></article>
        <section id="comments" class="comments-area"><h2>2 thoughts</h2><ol class="comment-list"><li class="comment"><p>Lovely, thank you!</p></li><li class="comment"><p>Mine was flat.</p></li></ol></section></main>
        <aside class="widget-area"><section class="widget"><h2>Recent posts</h2><ul><li><a href="#">Rye</a><li><a href="#">Oats</a></ul></section></aside>
        <footer class="site-footer">&copy; 2020 Baker's notes</footer></div></body></html>""",
        "On bread Flour, water & salt are all that bread needs. Time does the rest: a slow rise overnight gives the crumb its holes and the crust its colour. Never hurry a dough. 500 g flour 350 g water 10 g salt Bake it hot.",
    ),
    "table layout": (
        """<html><body bgcolor=white><table width="100%"><tr><td colspan=2 class="banner"><a href="/">River levels</a></td></tr><tr><td class="menu"><a href="a">North</a><br><a href="b">South</a><br><a href="c">West</a></td>
        <td class="content"><h2>Levels in spring</h2><p>The river rose by two metres within a week, and the meadows below the mill were under water until the end of April, as they are in most years.</p>
        <table><tr><th>Week</th><th>Metres</th></tr><tr><td>14</td><td>3.1</td></tr><tr><td>15</td><td>5.2</td></tr></table></td></tr></table></body></html>""",
        "Levels in spring The river rose by two metres within a week, and the meadows below the mill were under water until the end of April, as they are in most years. Week Metres 14 3.1 15 5.2",
    ),
    "news": (
        """<body><div class="cookie-consent"><p>We use cookies to make this site work.</p><button>Accept</button></div><div class="topbar"><a href="/">Home</a> <a href="/world">World</a></div>
        <div class="layout"><div class="story"><h1>Bridge reopens after repairs</h1><div class="share-buttons"><a href="#">Share</a></div><p>The old bridge over the canal opened again on Monday, three months later than planned.</p>
        <div class="advert"><p>Buy our shoes today, they are the best shoes!</p></div><p>Engineers had found cracks in two of its pillars and replaced both of them during the winter.</p><figure><img src=x><figcaption>The bridge on Monday.</figcaption></figure>
        <p>The council said that no further closures were expected.</p></div><div class="sidebar"><h3>Most read</h3><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></div></div>
        <div class="newsletter"><form action="/s"><label>Your address</label><input name=m><button>Subscribe</button></form></div><div class="footer"><p>Contact us. All rights reserved.</p></div></body>""",
        "Bridge reopens after repairs The old bridge over the canal opened again on Monday, three months later than planned. Engineers had found cracks in two of its pillars and replaced both of them during the winter. The bridge on Monday. The council said that no further closures were expected.",
    ),
    "docs": (
        """<html><body><nav><ol class=breadcrumb><li><a href=/>Docs</a><li><a href=/api>API</a></ol></nav><section class="doc-content"><h1>Reading files</h1><p>Call <code>open</code> with a path &mdash; it returns a handle.</p>
        <pre>h = open("a")
        h.read()</pre><h2>Errors</h2><dl><dt>missing</dt><dd>The path names nothing.</dd><dt>denied</dt><dd>The file may not be read.</dd></dl></section><footer><a href=/legal>Legal</a></footer></body></html>""",
        'Reading files Call open with a path \u2014 it returns a handle. h = open("a") h.read() Errors missing The path names nothing. denied The file may not be read.',
    ),
    "unclosed": (
        """<html><body><div class=menu><a href=/>Start</a> <a href=/x>More</a></div><div class=article-body><h1>Two gardens<p>The first garden lies behind the house.<button class=fold>Show more<p>The second one is by the wall, where pears grow.
        <div><svg viewBox="0 0 1 1"><p>Nobody planted the cherries; they came with the birds.<p>In June both are at their best.</div></div><div class=footer>Imprint""",
        "Two gardens The first garden lies behind the house. The second one is by the wall, where pears grow. Nobody planted the cherries; they came with the birds. In June both are at their best.",
    ),
    "bare": ("<html><body><h1>Notice of sale</h1><p>The boat will be sold on Friday at noon in the harbour office, as seen and without any warranty.</p><p>Bids are taken from ten.</p></body></html>", "Notice of sale The boat will be sold on Friday at noon in the harbour office, as seen and without any warranty. Bids are taken from ten."),
}


def overlap(a, b):
    """Words of a that b holds too, with their numbers."""
    left = {}
    for w in b:
        left[w] = left.get(w, 0) + 1
    n = 0
    for w in a:
        if left.get(w, 0):
            left[w] -= 1
            n += 1
    return n


def test_pages_of_other_build():
    """Words of the main text found and words given that belong to it, over pages that no generator here made."""
    got = dict(zip(PAGES, html_extract.main_texts([p for p, _ in PAGES.values()], html_extract.page_model()), strict=True))
    words = {k: (got[k].split(), want.split()) for k, (_, want) in PAGES.items()}
    right = sum(overlap(g, w) for g, w in words.values())
    precision, recall = right / sum(len(g) for g, _ in words.values()), right / sum(len(w) for _, w in words.values())
    print(f"precision {precision:.3f} recall {recall:.3f}")
    for k, (g, w) in words.items():
        print(k, len(g), len(w), overlap(g, w))
    assert precision > 0.95 and recall > 0.95


def parse(page):
    nodes = html_extract.Nodes()
    nodes.add_page(page)
    return [t for t in nodes.texts if t]


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<p>a<button>b<p>c", ["a", "c"]),
        ("<div>a<button>b</button>c</div>", ["ac"]),
        ("<p>one<select><option>x<p>two</p>", ["one", "two"]),
        ("<p>one<select><option>x</select><p>two</p>", ["one", "two"]),
        ("<p>a</p><svg><text>b</text><p>c</p>", ["a", "b", "c"]),
        ("<p>a</p><svg><text>b</text></svg><p>c</p>", ["a", "c"]),
        ("<p>a<object><object>x</object>y</object>b", ["ab"]),
        ("<div>a<button><div>b</div>c</button>d</div>e", ["ad", "e"]),
        ("<div>a<button>b</div><div>c</div>d<button>e</button>f", ["a", "c", "df"]),
        ("<div>a<noscript>b<div>c</div></div>d<noscript>e</noscript>", ["a", "d"]),
        ("<p>a<noscript><p>b<p>c", ["a", "b", "c"]),
        ("<p>a<template><p>b</template>c", ["ac"]),
        ("a<!-->b<!--->c<!-- d --!>e<!-- f -->g", ["abceg"]),
        ("a<!-- b", ["a"]),
        ('<p title="a>b">c</p>', ["c"]),
        ('<p title="a>b</p><p class=x>c', ["b", "c"]),
        ("<p title=don't>c</p>", ["c"]),
        ("a < b <= c <3 d</ >e</3>f", ["a < b <= c <3 def"]),
        ("<script>if (a < b) x = '</p>';</script>t", ["t"]),
        ("<script>only", []),
        ("<STYLE>x</sTyLe >t<TITLE>u</title>v", ["tv"]),
        ("<title>never closed<p>text", ["never closed", "text"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<table><tr><td>a<td>b<tr><th>c</table>", ["a", "b", "c"]),
        ("x</div></p>y", ["x", "y"]),
        ("&lt;b&gt; &#65;&amp;amp;", ["<b> A&amp;"]),
        ("end <p", ["end"]),
    ],
)
def test_broken_markup(page, texts):
    assert parse(page) == texts


@pytest.mark.parametrize(
    "unit",
    ["<a ", '<div class="', "<div>", "</div>", "<!--", "<svg>", "<button>", "<li><div>", "<title>", "<", "&", "<p title='", "<a x=\"'", "<script", "<div></b></i></x>", "<td>", "x<!-->", "<dt><b>", "class=", "<div class='a' "],
)
def test_hostile_pages_take_linear_time(unit):
    page = unit * (400_000 // len(unit))
    began = time.time()
    for source in (page, page + "</svg></button></title>", "<p>" + page + '>"'):
        html_extract.main_texts([source], html_extract.page_model())
    assert time.time() - began < 60


def test_deep_pages_lose_nothing():
    page = "<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>end"
    assert parse(page) == ["deep", "end"]


def test_the_model_file_is_what_training_makes():
    made, kept = html_extract.train(), html_extract.page_model()
    assert (made.features == kept.features).all() and np.allclose(made.cuts, kept.cuts) and np.allclose(made.values, kept.values) and np.isclose(made.base, kept.base)


def test_features_equal_plain_ones():
    """Subtree sums, depths, ranks and shares of a small page, written out from its tree."""
    nodes = html_extract.Nodes()
    nodes.add_page("<div class=content><h1>Title</h1><p>one <a href=x>two</a> three</p><div class=sidebar><p>side</p></div></div><footer>end</footer>")
    x = nodes.features()
    n = len(nodes.tag)
    inside = [[j for j in range(n) if k <= j < nodes.end[k]] for k in range(n)]
    size = [sum(nodes.chars[j] for j in inside[k]) for k in range(n)]
    whole = sum(nodes.chars)
    kids = [[j for j in range(n) if nodes.parent[j] == k] for k in range(n)]
    for k in range(n):
        up = nodes.parent[k]
        assert np.isclose(x[k, 0], np.log1p(size[k])) and np.isclose(x[k, 1], sum(nodes.links[j] for j in inside[k]) / max(size[k], 1), atol=1e-6)
        assert np.isclose(x[k, 2], size[k] / whole, atol=1e-6) and np.isclose(x[k, 3], np.log1p(size[k] / len(inside[k])), atol=1e-6)
        assert x[k, 4] == nodes.depth[k] and np.isclose(x[k, 5], np.log1p(len(kids[k])), atol=1e-6)
        assert np.isclose(x[k, 6], kids[up].index(k) / len(kids[up]) if up >= 0 else 0, atol=1e-6)
        assert np.isclose(x[k, 7], size[k] / max(size[up], 1) if up >= 0 else 1, atol=1e-6)
        assert np.isclose(x[k, 8], sum(nodes.chars[:k]) / whole, atol=1e-6) and x[k, 9] == (nodes.tag[k] < 0)
    assert [t for t in nodes.texts if t] == ["Title", "one two three", "side", "end"] and sum(nodes.links) == 3


def test_pages(spark):
    page = "<html><head><title>T</title><style>x</style></head><body><nav><a href='/'>Home</a></nav><article><h1>A &amp; B</h1><p>One <b>two</b>three\n  four<br>five<p>Six&#33;<script>var a='</p>';</script></article><footer>(c)</footer></body></html>"
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (1, "u", page), (None, "v", "no tags < here &lt;b&gt;"), (5, "w", "<article><p>" + "long text " * 200_000 + "</p></article>"), (6, "x", "<!-- open <p>never"), (7, "y", "<script>only")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'old' as text", "1 as _hx")
    got = {(r.page_id, r.url): r.text for r in html_extract.extract(df).collect()}
    assert got[1, "u"] == "A & B One twothree four five Six!"
    assert got[2, "u"] == got[3, None] == got[6, "x"] == got[7, "y"] == "" and len(got[5, "w"]) == 200_000 * 10 - 1
    assert html_extract.extract(df).columns == ["page_id", "url", "_hx", "text"] and html_extract.extract(df.where("false")).count() == 0
