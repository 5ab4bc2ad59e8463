"""The page scanner, references and published links."""

import time
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from tracefold.functions import references
from tracefold.operators import pages

PAGE = """<!DOCTYPE html><HTML lang=en><head><title> A &amp;
 B </title><meta name=Description content=' first &lt; '><meta property="og:description" content="second"><meta name="generator" content="g1"><meta name="generator" content="g2"><meta property="og:site_name" content="S"><link rel="canonical" href="/c?a=1&amp;b=2"></head>
<body><nav>menu <nav>inner</nav> tail</nav><header>h</header><p>one <b>two</b>&nbsp;&amp; three<br>four</p><!-- <nav> --><script>var x = "</p><nav>";</script><svg><title>no</title></svg>
<a href='https://www.github.com/u?tab=x'>g</a><a title="a > b" href="https://dev.to/u">d</a><a href=rel>r</a><a>no</a><a href="https://[bad/">x</a><textarea>a <nav> b</textarea><footer>f</footer> five</body>"""


def test_a_page_is_read_as_a_browser_reads_it():
    got = pages.scan(PAGE)
    assert got["visible"] == "one two & three four g d r no x a <nav> b five"
    assert (got["title"], got["lang"], got["description"], got["generator"], got["site_name"], got["canonical"]) == ("A & B", "en", "first <", "g2", "S", "/c?a=1&b=2")
    assert got["links"] == ["https://www.github.com/u?tab=x", "https://dev.to/u", "rel", "https://[bad/"]
    assert got["profile_links"] == ["https://dev.to/u", "https://www.github.com/u"]


@pytest.mark.parametrize(("html", "visible"), [("", ""), ("a < b", "a < b"), ("a<p>b", "a b"), ("a</nav>b", "a b"), ("<nav>a<div>b</nav>c", "c"), ("<div><nav>a</div>b", "b"), ("x<!-- y", "x"), ("x<p y", "x"), ("<head><title>t</title><body>b", "b"), ("<p title='>'>q</p>", "q"), ("<nav/>a", "a"), ("&copy; &#65;&#x42;", "© AB")])
def test_odd_pages(html, visible):
    assert pages.scan(html)["visible"] == visible


@pytest.mark.parametrize("piece", ["<", '<a href="', "<!--", "<div>", "<a '", "<script>", "</nav>", "<!", "<nav><p>", "<a\n", "</p", "<a href=x>"])
def test_time_is_linear(piece):
    start = time.process_time()
    pages.scan(piece * 100_000)
    assert time.process_time() - start < 8


def test_profile_links_are_bounded_and_in_order():
    html = "".join(f'<a href="https://github.com/u{k:02}">x</a>' for k in reversed(range(40)))
    assert pages.scan(html)["profile_links"] == [f"https://github.com/u{k:02}" for k in range(25)]


def test_rows_of_metadata(spark):
    rows = [("u", "https://Site.example/x", 200, ["a"], PAGE), ("v", "http://site.example/", 404, None, None)]
    table = spark.createDataFrame(rows, "url string, final_url string, status_code int, redirects array<string>, html string")
    got = {r.url: r for r in pages.http_metadata(table).collect()}
    assert (got["u"].redirect_count, got["u"].hostname, got["u"].https, got["u"].title) == (1, "site.example", True, "A & B")
    assert (got["v"].redirect_count, got["v"].https, got["v"].title, got["v"].profile_links) == (0, False, None, [])
    assert {(r.src, r.dst) for r in pages.profile_edges(pages.http_metadata(table)).collect()} == {("https://site.example/x", "https://dev.to/u"), ("https://site.example/x", "https://www.github.com/u")}
    links = spark.createDataFrame([(1, "https://a.example/b/c", "<a href='//cdn.example/x'>1</a><a href=d>2</a><a href='mailto:x@y'>3</a>")], "page_id long, url string, html string")
    assert [(r.src, r.target, r.dst_host) for r in pages.link_edges(links).collect()] == [("a.example", "https://cdn.example/x", "cdn.example"), ("a.example", "https://a.example/b/d", "a.example"), ("a.example", "mailto:x@y", None)]


def test_references_of_the_standard(spark):
    base = "http://a/b/c/d;p?q"
    forms = ["g:h", "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "g;x?y#s", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "../../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h", "g;x=1/./y", "g;x=1/../y", "g?y/./x", "g#s/../x"]
    rows = [(base, f) for f in forms] + [("http://a", "g"), ("http://a/b", "HTTPS://c/d/../e"), ("http://a/b/", "../..")]
    got = spark.createDataFrame(rows, "b string, r string").select("b", "r", references.resolved(F.col("b"), F.col("r")).alias("t")).collect()
    odd = {("http://a/b", "HTTPS://c/d/../e"): "HTTPS://c/e", (base, "g;x=1/../y"): "http://a/b/c/y"}
    for r in got:
        assert r.t == odd.get((r.b, r.r), urljoin(r.b, r.r)), r


def test_published_links_leave_out_images_badges_and_oneself(spark):
    own = "github.com/example"
    text = 'Hi [me](https://github.com/Example/) [site](https://example.org/p), ![x](https://example.com/portrait.jpg)\n![b](https://img.shields.io/a.svg) <a class="k" href=\'https://www.h.example/q\'>h</a> https://bare.example/z. [site](https://example.org/p) [rel](docs/x.md) <https://angle.example/> *https://star.example/'
    rows = [(text,), ("\n".join(f"[l{n}](https://example.com/{n})" for n in range(80)),), (None,), ("none",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(references.published_links(F.col("t"), F.lit(own))).collect()]
    assert got[0] == ["https://example.org/p", "https://www.h.example/q", "https://bare.example/z", "https://star.example/"]
    assert len(got[1]) == 20 and not got[2] and got[3] == []
