"""References resolved against a base address, and the links that a text publishes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls
from .bound import bound

#: The generic syntax of references: scheme, authority, path, query, fragment. A fixed value.
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
# Hosts of generated badges.
BADGE_HOSTS = ["img.shields.io", "shields.io", "badgen.net", "badge.fury.io", "forthebadge.com", "komarev.com", "visitor-badge.laobi.icu", "visitor-badge.glitch.me", "github-readme-stats.vercel.app", "github-readme-streak-stats.herokuapp.com", "github-profile-trophy.vercel.app", "readme-typing-svg.herokuapp.com", "streak-stats.demolab.com", "codecov.io", "app.codecov.io", "travis-ci.org", "travis-ci.com", "api.codeclimate.com"]
#: Links of Markdown that are no images, links of HTML, addresses that stand alone.
MARKDOWN_LINK = r"(?:^|[^!])\[[^\]\[]*\]\(<?([^)\s>]+)"
HTML_LINK = r"<a [^>]*?href=[\"']([^\"']+)"
BARE_LINK = r"(?:^|[^\w(<\"'])(https?://[^\s<>()\[\]\"']+)"
MOST_LINKS = 20


def _parts(text: Column) -> Column:
    names = ("scheme", "authority", "path", "query", "fragment")
    return F.struct(*(F.regexp_extract(text, _PARTS, k + 1).alias(n) for k, n in enumerate(names)))


def without_dots(path: Column) -> Column:
    """The path with `.` and `..` steps taken."""

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == ".", done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    def taken(parts: Column) -> Column:
        ends = F.element_at(parts, -1).isin(".", "..")
        kept = F.aggregate(parts, F.array().cast("array<string>"), step)
        return F.concat(F.array_join(kept, "/"), F.when(ends & (F.size(kept) > 0), "/").otherwise(""))

    root = F.when(path.startswith("/"), "/").otherwise("")
    steps = F.split(F.regexp_replace(path, "^/", ""), "/")
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(root, bound(steps, taken))).otherwise(path)


def resolved(base: Column, reference: Column) -> Column:
    """The address that a reference names on a page at `base` (RFC 3986, section 5.2)."""

    def of(both: Column) -> Column:
        b, r = both["b"], both["r"]
        folder = F.regexp_extract(b["path"], "^(.*/)", 1)
        merged = F.concat(F.when((b["authority"] != "") & (b["path"] == ""), "/").otherwise(folder), r["path"])
        absolute, hosted, empty = r["scheme"] != "", r["authority"] != "", r["path"] == ""
        path = F.when(absolute | hosted | r["path"].startswith("/"), without_dots(r["path"])).when(empty, b["path"]).otherwise(without_dots(merged))
        authority = F.when(absolute | hosted, r["authority"]).otherwise(b["authority"])
        query = F.when(~absolute & ~hosted & empty & (r["query"] == ""), b["query"]).otherwise(r["query"])
        scheme = F.when(absolute, r["scheme"]).otherwise(b["scheme"])
        return F.concat(scheme, F.when(scheme != "", ":").otherwise(""), authority, path, query, r["fragment"])

    return bound(F.struct(_parts(base).alias("b"), _parts(F.trim(reference)).alias("r")), of)


def published_links(text: Column, own: Column | None = None, most: int = MOST_LINKS) -> Column:
    """Absolute web links of a text in Markdown or HTML, each once, in the order Markdown, HTML, bare;
    images, badges and the address `own` (host and path) are left out, and what is past `most`."""
    every = F.concat(*(F.regexp_extract_all(text, F.lit(p), 1) for p in (MARKDOWN_LINK, HTML_LINK, BARE_LINK)))
    clean = F.transform(every, lambda u: F.regexp_replace(F.trim(u), r"[.,;)]+$", ""))

    def wanted(u: Column) -> Column:
        place = F.lower(F.concat(urls.bare_host(u), F.regexp_replace(urls.path(u), "/+$", "")))
        kept = F.lower(u).rlike("^https?://") & (urls.bare_host(u) != "") & ~urls.bare_host(u).isin(BADGE_HOSTS)
        return kept if own is None else kept & (place != F.lower(own))

    return F.slice(F.array_distinct(F.filter(clean, wanted)), 1, most)
