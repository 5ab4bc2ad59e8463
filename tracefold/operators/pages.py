"""What a page says of itself, what it shows and where it links, by one pass over its tags."""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import references as links_of
from ..functions import urls

# Elements whose content isn't shown, elements without content, elements of plain text,
# hosts to which a link says who a site's owner is.
DROPPED_TAGS = frozenset(["script", "style", "noscript", "template", "svg", "nav", "header", "footer", "head"])
VOID_TAGS = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"])
RAW_TAGS = frozenset(["script", "style", "title", "textarea"])
PROFILE_HOSTS = frozenset(["github.com", "gitlab.com", "mastodon.social", "reddit.com", "keybase.io", "medium.com", "dev.to", "stackoverflow.com", "bitbucket.org"])
MOST_PROFILES = 25
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class _Tags:
    """Pieces of a page in order: (text, "", "") or ("", tag, attributes); an end tag begins with `/`.

    Every search that finds nothing is made once, so that time is linear in unclosed comments, quotes
    and elements too."""

    def __init__(self, page: str):
        self.page, self.low = page, page.lower()
        self.none: dict[str, int] = {}

    def _find(self, what: str, at: int, lower: bool = False) -> int:
        if at >= self.none.get(what, len(self.page) + 1):
            return -1
        found = (self.low if lower else self.page).find(what, at)
        if found < 0:
            self.none[what] = min(at, self.none.get(what, at))
        return found

    def _end(self, at: int) -> int:
        """The place of the tag's closing bracket; brackets in quotes don't count."""
        while m := _STOP.search(self.page, at):
            if m[0] == ">":
                return m.start()
            close = self._find(m[0], m.end())
            at = close + 1 if close >= 0 else m.end()
        return -1

    def __iter__(self) -> Iterator[tuple[str, str, str]]:
        page, at, text = self.page, 0, 0
        while (at := self._find("<", at)) >= 0:
            if page.startswith("<!--", at):
                close = self._find("-->", at + 4)
                after = len(page) if close < 0 else close + 3
                tag = attributes = ""
            else:
                closing = page.startswith("/", at + 1)
                m = _NAME.match(page, at + 1 + closing)
                if not m and not page.startswith(("!", "?", "/"), at + 1):
                    at += 1
                    continue
                close = self._end(m.end() if m else at + 1)
                after = len(page) if close < 0 else close + 1  # a tag without an end takes the rest
                tag, attributes = ("/" * closing + m[0].lower(), page[m.end() : close]) if m and close >= 0 else ("", "")
            if text < at:
                yield page[text:at], "", ""
            if tag:
                yield "", tag, attributes
            at = text = after
            if tag in RAW_TAGS:
                close = self._find(f"</{tag}", at, lower=True)
                at = len(page) if close < 0 else close
                if text < at:
                    yield page[text:at], "", ""
                text = at
        if text < len(page):
            yield page[text:], "", ""


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        value = next((v for v in m.groups()[1:] if v is not None), "")
        out.setdefault(m[1].lower(), references.unescape(value))
    return out


def _one_line(text: str) -> str:
    return " ".join(text.split())


def scan(page: str) -> dict[str, object]:
    found: dict[str, object] = {k: None for k in ("title", "lang", "description", "generator", "site_name", "canonical")}
    links: list[str] = []
    shown: list[str] = []
    open_: list[str] = []
    counts: dict[str, int] = {}
    dropped = 0
    for text, tag, raw in _Tags(page):
        if text:
            if open_ and open_[-1] == "title" and not counts.get("svg"):
                found["title"] = found["title"] or _one_line(references.unescape(text))[:300] or None
            elif not dropped:
                shown.append(references.unescape(text))
            continue
        if tag[0] == "/":
            name = tag[1:]
            if counts.get(name):
                while True:
                    last = open_.pop()
                    counts[last] -= 1
                    dropped -= last in DROPPED_TAGS
                    if last == name:
                        break
            shown.append(" ")
            continue
        if tag in ("html", "meta", "link", "a"):
            a = _attributes(raw)
            if tag == "html":
                found["lang"] = found["lang"] or a.get("lang") or None
            elif tag == "a" and a.get("href"):
                links.append(a["href"])
            elif tag == "link" and a.get("rel") == "canonical" and a.get("href"):
                found["canonical"] = found["canonical"] or a["href"][:2048]
            elif tag == "meta":
                name, value = (a.get("name") or a.get("property") or "").lower(), a.get("content", "").strip()
                if value and name in ("description", "og:description"):
                    found["description"] = found["description"] or value[:500]
                elif value and name == "generator":
                    found["generator"] = value[:200]
                elif value and name == "og:site_name":
                    found["site_name"] = value[:200]
        shown.append(" ")
        if tag == "body":  # a head without its end ends here
            while open_ and open_[-1] != "html":
                last = open_.pop()
                counts[last] -= 1
                dropped -= last in DROPPED_TAGS
        if tag not in VOID_TAGS and not raw.rstrip().endswith("/"):
            open_.append(tag)
            counts[tag] = counts.get(tag, 0) + 1
            dropped += tag in DROPPED_TAGS
    profiles = set()
    for link in links:
        if link.startswith(("http://", "https://")):
            try:
                host = (urlsplit(link).hostname or "").removeprefix("www.")
            except ValueError:
                continue
            if host in PROFILE_HOSTS:
                profiles.add(link.split("?")[0][:500])
    return found | {"visible": _one_line("".join(shown)), "links": links, "profile_links": sorted(profiles)[:MOST_PROFILES]}


_FIELDS = [("title", pa.string()), ("lang", pa.string()), ("description", pa.string()), ("generator", pa.string()), ("site_name", pa.string()), ("canonical", pa.string()), ("visible", pa.string()), ("links", pa.list_(pa.string())), ("profile_links", pa.list_(pa.string()))]
_KINDS = "title string, lang string, description string, generator string, site_name string, canonical string, visible string, links array<string>, profile_links array<string>"


def scanned(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """`keys` of each page with title (300 letters at most), lang, description (500), generator (200),
    site_name (200), canonical (2048), null where the page has none; `visible`, the text outside markup
    and `DROPPED_TAGS` on one line, character references decoded; `links`, the targets of its anchors as
    written; `profile_links`, up to 25 of them that lead to profile hosts, in order.

    Null html is an empty page. Only style sheets can hide other text, and they aren't read.
    """
    schema = pa.schema(_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.RecordBatch.from_pylist([scan(x.as_py()) for x in batch.column(len(keys))], schema=schema)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *found.columns], names=[*batch.schema.names[: len(keys)], *schema.names])

    kinds = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    return pages.select(*keys, F.coalesce(html, F.lit("")).alias("__html")).mapInArrow(run, f"{kinds}, {_KINDS}")


def link_edges(pages: DataFrame) -> DataFrame:
    """(page_id, src, href, target, dst_host): each link of pages (page_id, url, html), resolved
    against the page's address; `src` and `dst_host` are hosts, null for what isn't on the web."""
    rows = scanned(pages, ["page_id", "url"]).select("page_id", "url", F.explode("links").alias("href"))
    rows = rows.withColumn("target", links_of.resolved(F.col("url"), F.col("href")))
    on_web = urls.scheme(F.col("target")).isin("http", "https")
    return rows.select("page_id", urls.host(F.col("url")).alias("src"), "href", "target", F.when(on_web, F.nullif(urls.host(F.col("target")), F.lit(""))).alias("dst_host"))


def http_metadata(responses: DataFrame) -> DataFrame:
    """Responses (url, final_url, status_code, redirects array, html) with what their pages say, and
    the number of redirects."""
    rows = responses.withColumn("redirect_count", F.coalesce(F.size("redirects"), F.lit(0)))
    own = ["url", "final_url", "status_code", "redirect_count"]
    said = scanned(rows, own)
    return said.select(*own, urls.host(F.col("final_url")).alias("hostname"), F.col("final_url").startswith("https://").alias("https"), "title", "description", "generator", "site_name", "canonical", "profile_links")


def profile_edges(metadata: DataFrame) -> DataFrame:
    """(src, dst, type, rule_key): each profile to which a site links (rows of `http_metadata`)."""
    rows = metadata.select(urls.website(F.col("final_url")).alias("src"), F.explode("profile_links").alias("dst")).distinct()
    return rows.select("src", "dst", F.lit("LINKS_TO").alias("type"), F.lit("site_links_profile").alias("rule_key"))
