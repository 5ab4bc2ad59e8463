import random
import time
from collections import Counter

import pytest

from tracefold.llm import html

FURNITURE = '<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></ul></nav><div class="cookie-notice">We use cookies, and more cookies.</div>'
END = '<aside class="sidebar"><p>Read also this and that and more of it.</p></aside><section id="comments"><h2>Comments</h2><p>Reader says hello to everybody here.</p></section><form><p>Sign up</p><input></form><footer>&copy; Site</footer>'


def page(body, host="h.example"):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{FURNITURE}{body}{END}<script>var a = '</p>';</script></body></html>"


CASES = {
    "article": ('<article class="post-12"><h1>Head &amp; line</h1><p>One <b>bo</b>ld\n word.<p>Two<br>lines &#8212; <a href="#">linked</a>.<div class="ad">Buy!</div></article>', "Head & line One bold word. Two lines — linked."),
    "div": ('<div class="content main-3"><p>First long paragraph of the text, with commas, here.</p><ul><li>item one<li>item two</ul></div>', "First long paragraph of the text, with commas, here. item one item two"),
    "nested": ("<main><article><header><h1>Title</h1></header><section><p>Part one is here now.</p></section><section><p>Part two is there too.</p></section></article></main>", "Title Part one is here now. Part two is there too."),
    "replies": ('<article class="post has-sidebar"><p>The story itself is told here, in a few words.</p></article><article class="comment c-2"><p>I think that this reply is longer than the story was, and by far.</p></article><ul class="breadcrumb"><li>Home<li>News</ul><div id="related-posts"><p>Another story that is related to it.</p></div><div role="alert"><p>Accept it all.</p></div><p hidden>Unseen</p>', "The story itself is told here, in a few words."),
    "open tags": ("<article><p><b>never closed<p>next & last", "never closed next & last"),
}


@pytest.mark.parametrize("name", CASES)
def test_main_text(name):
    body, want = CASES[name]
    text = page(body) if name != "open tags" else f"<body>{FURNITURE}{body}"
    assert html.Page(text).text_at(None) == want


LONG = "The body of the story goes on for very much longer than what stands above it. " * 12
WHOLE = {
    "lead and body": (f'<article><h1>Title</h1><p class="lead">A short lead.</p><div class="body"><p>{LONG}</p></div></article>', f"Title A short lead. {LONG.strip()}"),
    "two parts": (f'<main><div class="intro"><p>What it is about.</p></div><div class="content"><p>{LONG}</p></div></main>', f"What it is about. {LONG.strip()}"),
    "plain parts": (f'<div id="content"><div class="one"><p>What it is about.</p></div><div class="two"><p>{LONG}</p></div></div>', f"What it is about. {LONG.strip()}"),
    "list of links": (f'<div id="all"><div class="left"><ul><li><a href="/a">First</a><li><a href="/b">Second</a></ul></div><div class="text"><p>{LONG}</p></div></div>', LONG.strip()),
}


@pytest.mark.parametrize("name", WHOLE)
def test_all_parts_of_an_article_are_kept(name):
    body, want = WHOLE[name]
    assert html.Page(page(body)).text_at(None) == want


OPENED = {
    "widget": (f'<div class="widget-text"><article><p>{LONG}</p></article></div>', LONG.strip()),
    "search page": (f'<div class="search-results-page article-body"><p>{LONG}</p></div>', LONG.strip()),
    "form": (f'<form action="/"><input name="state"><article class="post"><h1>Head</h1><p>{LONG}</p><div class="ad">Buy!</div></article></form>', f"Head {LONG.strip()}"),
    "remarks longer than the article": (f'<article><p>The story.</p></article><div class="comments"><p>{LONG}</p></div>', "The story."),
    "remarks in the article": (f'<article><p>The story.</p><div id="disqus"><p>{LONG}</p></div></article>', "The story."),
}


@pytest.mark.parametrize("name", OPENED)
def test_one_word_does_not_empty_a_page(name):
    body, want = OPENED[name]
    assert html.Page(page(body)).text_at(None) == want


def test_long_pages_take_time_in_proportion():
    began = time.time()
    deep = html.Page("<body>" + "<div class='a'>" * 100_000 + "<p>Deep text of the page.</p>")
    assert deep.text_at(None) == "Deep text of the page." and len(deep.elements) <= html.DEEPEST + 2
    deep = html.Page("<body>" + "<div>word " * 50_000 + "</div>" * 50_000 + "<p>After it all.")
    assert deep.text_at(None).startswith("word word") and deep.text_at(None).count("word") == 50_000
    assert html.Page("<p>Text " + "<a href=x " * 100_000).text_at(None).startswith("Text <a")
    assert html.Page("<body><p>Text</p>" + '<a href="x ' * 100_000 + "<i>").text_at(None).startswith("Text")
    assert html.Page("<p>Text</p>" + "<li><ul><b>" * 20_000 + "</i></dd>" * 20_000).text_at(None) == "Text"
    assert html.Page("<p>Text</p>" + "<!--" * 100_000).text_at(None) == "Text"
    assert html.Page("<p>Text</p>" + "<script>" * 100_000).text_at(None) == "Text"
    assert html.Page("<p>2 < 3 and a<b").text_at(None) == "2 < 3 and a<b"
    assert time.time() - began < 20


def test_against_a_plain_reading_of_the_tree():
    """Random trees of containers: scores, sizes and texts as a quadratic walk over all ancestors has them."""
    rng = random.Random(12)
    for _ in range(60):
        text, parents, open_, blocks = "<body>", {0: None}, [0], []
        tags = {0: "body"}
        for k in range(1, rng.randrange(3, 40)):
            if rng.random() < 0.4 and len(open_) > 1:
                text += f"</{tags[open_.pop()]}>"
            tag = rng.choice(["div", "section", "article", "main", "blockquote"])
            parents[k], tags[k] = open_[-1], tag
            open_.append(k)
            own = f"w{k} " * rng.randrange(6)
            text += f"<{tag}>{own}"
            if own:
                blocks.append((k, own.strip()))
        score, held = dict.fromkeys(tags, 0.0), {k: [] for k in tags}
        for k, own in blocks:
            up, share = k, 1.0
            while up is not None:
                score[up] += share * len(own) * (1.5 if tags[up] in ("article", "main") else 1)
                held[up].append(own)
                up, share = parents[up], share / 2
        found = html.Page(text)
        assert [(e.tag, pytest.approx(e.score), found.text_of([e])) for e in found.containers] == [(tags[k], score[k], " ".join(held[k])) for k in sorted(tags) if held[k]]


def test_sent_and_joined_paths_give_the_same(spark):
    rng = random.Random(2)
    rows = [(k % 50, f"https://h{k % 4}.example/{k}", page("".join(f'<div class="{rng.choice("abcd")}"><p>{"word " * rng.randrange(1, 30)}</p></div>' for _ in range(3)))) for k in range(60)]
    pages = spark.createDataFrame([*rows, (None, None, None)], "page_id long, url string, html string")
    sent, joined = (sorted(map(str, html.extract(pages, n).collect())) for n in (html.MOST_SENT, 0))
    assert sent == joined and len(sent) == 61


def brute_force(rows):
    """Votes counted in plain dictionaries."""
    hosts = [(u or "").split("://")[-1].split("/")[0].lower() if "://" in (u or "") else "" for _, u, _ in rows]
    read = [html.Page(h or "") for _, _, h in rows]
    votes = Counter((host, p.main_part().path) for host, p in zip(hosts, read, strict=True) if p.containers)
    most = {}
    for (host, _), n in votes.items():
        most[host] = max(most.get(host, 0), n)
    out = []
    for (i, _, _), host, p in zip(rows, hosts, read, strict=True):
        won = [(votes[host, e.path], -html._place(host, e.path), e.path) for e in p.containers if votes[host, e.path] >= max(html.LEAST_VOTES, most.get(host, 0) * 0.1)]
        out.append((i, p.text_at(max(won)[2] if won else None)))
    return out


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(7)
    rows = []
    for k in range(120):
        parts = "".join(f'<{t} class="{rng.choice("abc")}{rng.randrange(9)}"><p>{"word " * rng.randrange(1, 40)}{k}</p></{t}>' for t in rng.choices(["div", "section", "article"], k=rng.randrange(1, 5)))
        rows.append((k, f"https://h{k % 3}.example/{k}", page(parts)))
    rows += [(200, None, None), (201, "x", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = html.op4_html_extraction(spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.text) for r in got) == sorted(brute_force(rows))
    assert all(r.n_chars == len(r.text) for r in got)


def test_a_path_that_one_page_votes_for_does_not_count(spark):
    names = ["".join("abcdefghij"[int(c)] for c in str(k)) for k in range(300)]
    rows = [(k, f"https://h.example/{k}", page(f'<div class="x{n}"><p>The story of page {k} is told here.</p></div>')) for k, n in enumerate(names)]
    rows += [(1000, "https://h.example/b", page(f'<div class="xa"><p>Short.</p></div><div class="y"><p>{LONG}</p></div>'))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert all(got[k] == f"The story of page {k} is told here." for k in range(300))
    assert got[1000] == LONG.strip()


def test_hosts_agree_on_paths(spark):
    good = '<div class="body-{}"><p>The story of page {} goes on for a while, and then it ends.</p></div>'
    odd = '<div class="body-9"><p>Tiny.</p></div><div class="promo2x"><p>A much longer text, that only this page of the host has, and no other one, here.</p></div>'
    rows = [(k, f"https://h.example/{k}", page(good.format(k, k)), "x") for k in range(8)]
    rows += [(50, "https://H.example/odd", page(odd), "x"), (51, "https://h.example/e", None, "x"), (52, None, "", "x"), (53, "rel", "plain text only", "x"), (None, "https://o.example/", page(CASES["article"][0]), None), (54, "https://h.example/z", page(good.format(1, "z" * 200_000)), "x"), (0, "https://h.example/0", page(good.format(0, 0)), "x")]
    out = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string"))
    got = {r.page_id: r.text for r in out.collect()}
    assert out.count() == len(rows)
    for k in range(8):
        assert got[k] == f"The story of page {k} goes on for a while, and then it ends."
    assert got[50] == "Tiny."
    assert (got[51], got[52], got[53]) == ("", "", "plain text only")
    assert got[None] == CASES["article"][1]
    assert len(got[54]) > 200_000


def test_empty_table(spark):
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
