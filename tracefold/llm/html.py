"""Main text of web pages by paths that the pages of a host agree on.

1. In each page the containers are scored by the prose below them, links apart. From the best one
   the page climbs to the article or main part that holds it, else as far as what is added is not
   mostly links; the path of tags and classes there, with digits generalised, is the page's vote.
2. Spark adds up the votes of each host; paths of two pages and a tenth of the best one's votes win.
3. Of the winning paths that a page has, the one with most votes on its host gives its text. A page
   that has none of them keeps its own choice.

What is in menus, footers, side bars, notices, adverts, forms, scripts or comments doesn't count,
by its tag, role or the words of its class and id. But an element outside of which next to nothing
is left can't be furniture: a form or a `widget` round the whole article is opened again.

A page is read in time and memory in proportion to its length: elements know their parent and a
hash of their path, blocks are held once, and sums go up the tree once. Elements more than
`DEEPEST` deep belong to the one they are in, as in browsers; their text is kept.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

# Names of HTML's tags and of usual page furniture.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
FURNITURE = {"nav", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "svg", "canvas", "object", "audio", "video", "head", "fieldset", "map", "math"} | RAW
CONTAINERS = {"article", "main", "section", "div", "td", "body", "center", "blockquote"}
WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "disclaimer", "disqus", "footer", "foot", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget", "widgets",
}
#: Tags of furniture that may turn out to hold the article.
SOFT = {"form", "fieldset"}
REMARKS = {"comment", "comments", "commentlist", "disqus", "replies", "respond"}
NO_ARTICLE = {"ad", "ads", "advert", "advertisement", "comment", "comments", "commentlist", "promo", "recommended", "related", "replies", "sponsor", "sponsored", "widget"}
HEADER_WORDS = {"header", "site-header", "head"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: An open element of these kinds ends where the next of its kind begins, inside the given scope.
ENDED_BY = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPES = {"article", "main", "section", "div", "td", "th", "table", "body", "html", "nav", "aside", "footer", "header", "form", "blockquote"}

#: Pages whose votes make a path count.
LEAST_VOTES = 2
DEEPEST = 512
#: Text outside an element, as a share of its own, below which it can't be furniture.
NEXT_TO_NOTHING = 0.1
#: Winning paths up to which they are sent to all tasks; more are joined.
MOST_SENT = 1 << 20

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r">|=\s*[\"']")
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_DIGITS = re.compile(r"[0-9]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
_NOT_WORD = re.compile(r"[^a-z]+")
_HARD, _SOFTLY, _REMARK = 3, 2, 1


class _Element:
    __slots__ = ("tag", "parent", "path", "kind", "link", "article", "out", "carry", "size", "prose", "first", "last", "score")

    def __init__(self, tag: str, parent, path: int, kind: int, link: bool, article: bool):
        self.tag, self.parent, self.path, self.kind, self.link, self.article = tag, parent, path, kind, link, article
        self.out, self.carry, self.size, self.prose, self.first, self.last, self.score = False, 0.0, 0, 0, -1, -1, 0.0


def _attributes(text: str) -> dict[str, str]:
    found = {}
    for name, value in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), references.unescape(value.strip("\"'")) if value else "")
    return found


def _furniture(tag: str, attributes: dict[str, str], article: bool) -> int:
    """How surely the element is furniture: 0 if not at all."""
    if tag in FURNITURE and tag not in SOFT or (tag == "header" and not article):
        return _HARD
    if attributes and tag not in ("html", "body", "main"):
        if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
            return _HARD
        words = set(_NOT_WORD.split(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()))
        if words & REMARKS:
            return _REMARK
        if tag == "article":  # a page's article may be named after its theme; replies and adverts are not articles
            return _SOFTLY if words & NO_ARTICLE else 0
        if words & WORDS or (not article and words & HEADER_WORDS) or attributes.get("role", "").lower() in ROLES:
            return _SOFTLY
    return _SOFTLY if tag in SOFT else 0


class Page:
    """Elements in page order and the blocks of text in them. A block is (owner, text, prose,
    links): white space is one space, and the numbers are of characters outside and in links."""

    def __init__(self, html: str):
        self.root = _Element("", None, 0, 0, False, False)
        self.elements, self.blocks = [self.root], []
        self._held: list[tuple[str, bool]] = []
        self._owner = None
        self._walk(html)
        self._close()
        self._weigh()

    def _close(self) -> None:
        if self._held:
            text = " ".join("".join(t for t, _ in self._held).split())
            if text:
                links = sum(len(t.strip()) for t, link in self._held if link)
                prose = sum(len(t.strip()) for t, link in self._held if not link)
                self.blocks.append((self._owner, text, prose, links))
            self._held = []
        self._owner = None

    def _walk(self, html: str) -> None:
        stack, at, size = [self.root], 0, len(html)
        last = {c: html.rfind(c) for c in ">\"'"}
        many, deeper = dict.fromkeys(("",), 1), {}
        elements, held = self.elements, self._held

        def cut(k: int) -> None:
            for e in stack[k:]:
                many[e.tag] -= 1
            del stack[k:]
            deeper.clear()

        def end_of_tag(k: int) -> int:
            while True:
                stop = _STOP.search(html, k)
                if stop is None:
                    return size
                if stop[0] == ">":
                    return stop.end()
                quote = stop[0][-1]
                if stop.end() > last[quote]:  # never closed: the value ends with the tag
                    return html.find(">", stop.end()) + 1 or size
                k = html.find(quote, stop.end()) + 1

        while at < size:
            low = html.find("<", at)
            if low > last[">"]:  # nothing ends here any more but a comment, at the page's end
                low = html.find("<!--", low)
            if low < 0:
                low = size
            if low > at:
                own = stack[-1]
                if self._owner is None or own.tag not in INLINE:
                    self._owner = own
                self._held.append((references.unescape(html[at:low]), own.link))
                at = low
                continue
            closing = html.startswith("</", at)
            name = _NAME.match(html, at + 1 + closing)
            if name is None:
                if html.startswith("<!--", at):
                    end = html.find("-->", at + 4)
                    at = size if end < 0 else end + 3
                elif html[at + 1 : at + 2] in ("!", "?", "/"):
                    at = html.find(">", at) + 1
                else:
                    self._held.append(("<", stack[-1].link))
                    self._owner = self._owner or stack[-1]
                    at += 1
                continue
            tag = name[0].lower()
            begin, at = name.end(), end_of_tag(name.end())
            if closing:
                if deeper.get(tag):
                    deeper[tag] -= 1
                elif many.get(tag):
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag == tag:
                            cut(k)
                            break
                        if tag in INLINE and stack[k].tag in SCOPES:
                            break
                if tag not in INLINE:
                    self._close()
                continue
            if tag in ENDS_P and many.get("p"):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        cut(k)
                        break
                    if stack[k].tag in SCOPES:
                        break
            if tag in ENDED_BY:
                ended, scope = ENDED_BY[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in scope:
                        break
                    if stack[k].tag in ended:
                        cut(k)
                        break
            parent = stack[-1]
            if tag in RAW:
                end = _RAW_END[tag].search(html, at)
                at = end.end() if end else size
                continue
            if tag not in INLINE:
                self._close()
            given = html[begin : at - 1]
            if tag in VOID or given.endswith("/") and tag not in CONTAINERS:
                continue
            if len(stack) > DEEPEST:
                deeper[tag] = deeper.get(tag, 0) + 1
                continue
            attributes = _attributes(given) if given and not given.isspace() else {}
            article = parent.article or tag in ("article", "main")
            names = sorted(set(_DIGITS.sub("0", attributes.get("class", "")).split()))
            path = xxhash.xxh64_intdigest(".".join([tag, *names]).encode(), parent.path)
            own = _Element(tag, parent, path, _furniture(tag, attributes, article), parent.link or tag == "a", article)
            elements.append(own)
            stack.append(own)
            many[tag] = many.get(tag, 0) + 1

    def _sum(self, counted) -> None:
        """Sums of the counted blocks, from the leaves up."""
        for e in self.elements:
            e.carry, e.size, e.prose, e.first, e.last = 0.0, 0, 0, -1, -1
        for k, (owner, _, prose, links) in enumerate(self.blocks):
            if counted(owner):
                owner.carry += prose
                owner.prose += prose
                owner.size += prose + links
                owner.first = k if owner.first < 0 else owner.first
                owner.last = k
        for e in reversed(self.elements):
            up = e.parent
            if up is None or e.first < 0:
                continue
            up.carry += e.carry / 2 if e.tag in CONTAINERS else e.carry
            up.prose += e.prose
            up.size += e.size
            up.first = e.first if up.first < 0 else min(up.first, e.first)
            up.last = max(up.last, e.last)

    def _weigh(self) -> None:
        """Decides what is furniture, then scores the containers."""
        hard: dict[int, bool] = {}
        remark: dict[int, bool] = {}
        for e in self.elements:
            up = e.parent
            hard[id(e)] = up is not None and (hard[id(up)] or e.kind == _HARD)
            remark[id(e)] = up is not None and (remark[id(up)] or e.kind == _REMARK)
        opened = self._opened(hard, remark) if any(0 < e.kind < _HARD for e in self.elements) else set()
        for e in self.elements:
            e.out = e.parent is not None and (e.parent.out or (e.kind > 0 and id(e) not in opened))
        self._sum(lambda e: not e.out)
        self.containers = [e for e in self.elements if e.tag in CONTAINERS and e.first >= 0 and not e.out]
        for e in self.containers:
            e.score = e.carry * (1.5 if e.tag in ("article", "main") else 1.0)

    def _opened(self, hard: dict[int, bool], remark: dict[int, bool]) -> set[int]:
        """The elements that can't be furniture, largest first: outside of them and of what is
        opened already next to nothing is left. Remarks are opened where there is nothing else."""
        whole = all(hard[id(e)] or remark[id(e)] or not prose for e, _, prose, _ in self.blocks)
        counted = lambda e: not hard[id(e)] and (whole or not remark[id(e)])
        self._sum(counted)
        nearest: dict[int, _Element | None] = {}
        for e in self.elements:
            mine = e.kind == _SOFTLY or (whole and e.kind == _REMARK)
            nearest[id(e)] = e if mine else nearest[id(e.parent)] if e.parent is not None else None
        own: dict[int | None, int] = {}
        for e, _, prose, _ in self.blocks:
            if counted(e):
                inner = nearest[id(e)]
                key = None if inner is None else id(inner)
                own[key] = own.get(key, 0) + prose
        plain, opened = own.get(None, 0), set()
        for e in sorted((e for e in self.elements if nearest[id(e)] is e and counted(e)), key=lambda e: -e.prose):
            outer = nearest[id(e.parent)]
            if e.prose and (outer is None or id(outer) in opened) and plain < NEXT_TO_NOTHING * e.prose:
                opened.add(id(e))
                plain += own.get(id(e), 0)
        return opened

    def main_part(self) -> _Element | None:
        """The whole text that the best-scored container belongs to: the nearest article or main,
        then outer ones, or without any the containers around it below the body, while less than
        half of the text that they add is links. Of equal scores the first in the page is best."""
        if not self.containers:
            return None
        own = max(self.containers, key=lambda e: e.score)
        up = own
        while up is not None and up.tag not in ("article", "main"):
            up = up.parent
        kinds = CONTAINERS - {"body"} if up is None else {"article", "main"}
        own = up or own
        up = own.parent
        while up is not None:
            if up.tag in kinds and up.size > own.size:
                if 2 * (up.prose - own.prose) <= up.size - own.size:
                    break
                own = up
            up = up.parent
        return own

    def text_of(self, parts: list[_Element]) -> str:
        """The blocks in the parts, each once, in page order."""
        out, after = [], 0
        for low, high in sorted((e.first, e.last + 1) for e in parts if e.first >= 0):
            out += [text for owner, text, _, _ in self.blocks[max(low, after) : high] if not owner.out]
            after = max(after, high)
        return " ".join(out)

    def text_at(self, path: int | None) -> str:
        """The text at a path, else the page's own choice, else all that is no furniture."""
        own = [e for e in self.containers if e.path == path]
        return self.text_of(own or [self.main_part() or self.root])


def _place(host: str, path: int) -> int:
    """A hash of host and path as a signed integer."""
    return (xxhash.xxh64_intdigest(path.to_bytes(8, "little"), xxhash.xxh64_intdigest(host.encode())) + (1 << 63)) % (1 << 64) - (1 << 63)


_VOTE = "host long, place long"


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, places = [], []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            best = Page(page.as_py()).main_part()
            if best is not None:
                hosts.append(_place(host, 0))
                places.append(_place(host, best.path))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array(places, pa.int64())], names=["host", "place"])


def winning_paths(pages: DataFrame, least_share: float = 0.1) -> DataFrame:
    """place (a hash of host and path) and votes of the paths that win on their hosts. `pages`:
    (host, html)."""
    votes = pages.select("host", "html").mapInArrow(_votes, _VOTE).groupBy("place", "host").agg(F.count(F.lit(1)).alias("votes"))
    votes = materialize(votes.filter(F.col("votes") >= LEAST_VOTES), "votes")
    most = votes.groupBy("host").agg(F.max("votes").alias("most"))
    return votes.join(most, "host").filter(F.col("votes") >= F.col("most") * least_share).select("place", "votes")


_TEXT = "page_id long, url string, text string"


def _texts(batch: pa.RecordBatch, chosen) -> pa.RecordBatch:
    """`chosen(k, host, page)` is the path for row k."""
    texts = []
    for k, (host, html) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3), strict=True)):
        page = Page(html.as_py())
        texts.append(page.text_at(chosen(k, host, page)))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _with_sent(sent):
    """Each page's winning path from a table in the task; pages stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, votes = sent.value

        def chosen(_, host: str, page: Page) -> int | None:
            paths = list(dict.fromkeys(e.path for e in page.containers))
            if not paths or not len(places):
                return None
            asked = np.array([_place(host, p) for p in paths], np.int64)
            at = np.minimum(np.searchsorted(places, asked), len(places) - 1)
            won = np.where(places[at] == asked, votes[at], 0)
            best = won.max()
            return None if not best else min((int(a), p) for a, p, w in zip(asked, paths, won, strict=True) if w == best)[1]

        for batch in batches:
            yield _texts(batch, chosen)

    return run


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], []]
        for k, (host, html) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
            for path in {e.path for e in Page(html.as_py()).containers}:
                for column, value in zip(out, (k, _place(host, path), path - (1 << 63)), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["page", "place", "path"])


def _with_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = batch.column(4).to_pylist()
        yield _texts(batch, lambda k, *_, own=paths: None if own[k] is None else own[k] + (1 << 63))


def _joined(rows: DataFrame, won: DataFrame) -> DataFrame:
    """As `_with_sent`, for any number of winning paths: by joins on places and on pages."""
    rows = rows.withColumn("page", F.xxhash64("page_id", "url", "html"))
    found = materialize(rows.select("page", "host", "html").mapInArrow(_paths, "page long, place long, path long"), "paths")
    first = F.min(F.struct((-F.col("votes")).alias("less"), "place", "path"))
    best = found.join(won, "place").groupBy("page").agg(first.alias("first")).select("page", F.col("first.path").alias("path"))
    # A table of its own, so that Spark may split a page of very many rows when it joins them.
    return rows.join(materialize(best, "best"), "page", "left").select("page_id", "url", "host", "html", "path").mapInArrow(_with_joined, _TEXT)


def extract(pages: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """page_id, url, text of every row of `pages` (page_id, url, html; other columns are ignored).

    Null html is empty, and an empty page's text is empty. A page without a container gives all
    text outside furniture. Pages with a null or relative url vote together. Rows with a null or
    repeated page_id stand for themselves; of paths with equal votes the one with the smallest
    hash comes first. A page may be of any length, with any number of open elements and tags that
    never end; it is read in time in proportion. An empty table gives an empty table.

    The winning paths, 16 bytes each, are sent to all tasks while there are at most `most_sent`.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    won = materialize(winning_paths(rows), "won")
    if won.count() > most_sent:
        return _joined(rows, won)
    table = won.toArrow()
    by = np.argsort(table.column("place").to_numpy())
    sent = pages.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy()[by] for c in ("place", "votes")))
    return rows.mapInArrow(_with_sent(sent), _TEXT)


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
