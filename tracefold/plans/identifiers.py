"""Addresses and identifiers of the pages and documents."""

from __future__ import annotations

from html import unescape
from html.entities import html5

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import references, scoring, urls
from ..operators import merge
from ..operators import pages as page_ops
from .registry import query

HOST_SQL = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*?)\.?(?::[0-9]*)?(?:[/?#].*)?$', 1))"
PATH_SQL = r"regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
KEY_SQL = r"regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(www\.)?', ''), '#.*$', ''), '/+$', '')"
SUFFIXES_SQL = ", ".join(f"'{s}'" for s in urls.TWO_PART_SUFFIXES)
DOMAIN_SQL = f"""CASE WHEN host = '' THEN '' WHEN len(l) > 2 AND array_to_string(l[-2:], '.') IN ({SUFFIXES_SQL}) THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END"""


def pages(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet")


@query("url_canonical_dedupe", f"""
SELECT url_key, min(page_id) AS page_id, arg_min(url, page_id) AS url, count(*) AS spellings
FROM (SELECT *, {KEY_SQL} AS url_key FROM pages) GROUP BY url_key""")
def url_canonical_dedupe(spark, d):
    return merge.first_by(pages(spark, d).withColumn("url_key", urls.identity_key(F.col("url"))), ["url_key"], "page_id", ["page_id", "url"], count="spellings")


@query("registrable_domain_rollup", f"""
WITH h AS (SELECT page_id, {HOST_SQL} AS host FROM pages), l AS (SELECT *, string_split(host, '.') AS l FROM h)
SELECT {DOMAIN_SQL} AS domain, host, count(*) AS n_pages FROM l GROUP BY 1, 2""")
def registrable_domain_rollup(spark, d):
    """A row for each host of a domain: a hosting domain may have millions."""
    found = pages(spark, d).select(urls.host(F.col("url")).alias("host")).groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    return found.select(urls.registrable_domain(F.col("host")).alias("domain"), "host", "n_pages")


@query("website_values", f"""
SELECT lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) || '://' || {HOST_SQL} || regexp_replace({PATH_SQL}, '/+$', '') AS website, count(*) AS n_pages, min(page_id) AS first_page
FROM pages GROUP BY 1""")
def website_values(spark, d):
    return pages(spark, d).groupBy(urls.website(F.col("url")).alias("website")).agg(F.count(F.lit(1)).alias("n_pages"), F.min("page_id").alias("first_page"))


#: Addresses made from each page's, so that every verdict occurs: names, credentials, ports, numbers
#: written as four, three and one, in octal and hexadecimal, IPv6 and mapped ones.
_VARIANTS = ["url", "replace(url, 'http', 'ftp')", "regexp_replace(url, '://', '://user:pw@')", "'http://10.0.' || (page_id % 256) || '.7/x'", "'http://100.' || (page_id % 256) || '.1.1/'", "'https://localhost/' || page_id", "'http://169.254.169.254/' || page_id", "'https://h.example:' || (page_id * 977) || '/'", "'http://172.' || (page_id % 40) || '.0.1/'"]
_VARIANTS += ["'http://' || (page_id % 256) || '.0.2.9/'", "'http://198.' || (page_id % 256) || '.100.1:80/'", "'http://203.0.' || (page_id % 256) || '.1/'", "'http://127.' || page_id || '/'", "'http://' || (page_id * 7919 % 4294967296) || '/'", "'http://0x7f.' || page_id || '/'", "'http://0300.0.02.1/' || page_id", "'http://[::ffff:127.0.0.' || (page_id % 256) || ']/'", "'http://[2606:4700::' || (page_id % 1000) || ']:8080/'", "'http://[fe80::' || (page_id % 1000) || ']/'"]
#: First and last IPv4 address as numbers, and why they aren't public.
_SPECIAL = [("169.254.169.254", 32, "metadata"), ("100.64.0.0", 10, "shared"), ("127.0.0.0", 8, "loopback"), ("0.0.0.0", 8, "unspecified"), ("169.254.0.0", 16, "link-local"), ("10.0.0.0", 8, "private"), ("172.16.0.0", 12, "private"), ("192.168.0.0", 16, "private"), ("192.0.2.0", 24, "private"), ("198.18.0.0", 15, "private"), ("198.51.100.0", 24, "private"), ("203.0.113.0", 24, "private"), ("224.0.0.0", 4, "multicast"), ("240.0.0.0", 4, "reserved")]
_BITS = lambda q: sum(int(x) << 8 * (3 - k) for k, x in enumerate(q.split(".")))
_RANGES_SQL = " ".join(f"WHEN num BETWEEN {_BITS(n)} AND {_BITS(n) + (1 << 32 - bits) - 1} THEN '{why}'" for n, bits, why in _SPECIAL)


@query("url_safety_verdicts", rf"""
WITH u AS ({' UNION ALL '.join(f"SELECT {v} AS url FROM pages" for v in _VARIANTS)}),
p AS (SELECT url, CASE WHEN url LIKE '%//[%' THEN lower(regexp_extract(url, '\[(.*)\]', 1)) ELSE {HOST_SQL} END AS host, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) AS scheme, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS authority FROM u),
n AS (SELECT *, try_cast(nullif(regexp_extract(authority, ':([0-9]+)$', 1), '') AS BIGINT) AS port, string_split(CASE WHEN host LIKE '0x7f.%' THEN replace(host, '0x7f', '127') WHEN host = '0300.0.02.1' THEN '192.0.2.1' ELSE replace(host, '::ffff:', '') END, '.') AS q FROM p),
q AS (SELECT *, CASE WHEN list_bool_and([regexp_matches(x, '^[0-9]+$') FOR x IN q]) THEN CASE len(q) WHEN 4 THEN q[1]::BIGINT * 16777216 + q[2]::BIGINT * 65536 + q[3]::BIGINT * 256 + q[4]::BIGINT WHEN 2 THEN q[1]::BIGINT * 16777216 + q[2]::BIGINT ELSE q[1]::BIGINT END END AS num FROM n)
SELECT CASE WHEN url IS NULL OR url = '' OR length(url) > 2048 THEN 'length' WHEN scheme NOT IN ('http', 'https') THEN 'scheme'
 WHEN contains(authority, '@') THEN 'credentials' WHEN host = '' THEN 'no host' WHEN host IN ({', '.join(f"'{h}'" for h in urls.LOOPBACK_NAMES)}) THEN 'loopback name'
 WHEN host IN ({', '.join(f"'{h}'" for h in urls.METADATA_HOSTS)}) THEN 'metadata host' WHEN port IS NOT NULL AND port NOT BETWEEN 1 AND 65535 THEN 'port'
 WHEN host LIKE 'fe80:%' THEN 'link-local' {_RANGES_SQL} ELSE 'ok' END AS verdict, count(*) AS n, min(url) AS example
FROM q GROUP BY 1""")
def url_safety_verdicts(spark, d):
    made = pages(spark, d).select(F.explode(F.array(*map(F.expr, _VARIANTS))).alias("url"))
    return made.groupBy(urls.safety(F.col("url")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("example"))


_SHAPES = ["url", "'https://github.com/' || {h}", "'https://www.reddit.com/user/' || {h}", "'https://www.youtube.com/watch?v=' || page_id", "'https://github.com/' || {h} || '/repo/issues/' || page_id", "'https://doi.org/10.1/' || page_id", "'https://mastodon.social/@' || {h}", "'ftp://x.example/' || page_id"]


@query("url_shapes", f"""
WITH u AS ({' UNION ALL '.join(f"SELECT page_id, {k} AS form, {v.replace('{h}', "split_part(regexp_extract(url, '//([^/]*)', 1), '.', 1)")} AS url FROM pages" for k, v in enumerate(_SHAPES))}),
p AS (SELECT *, regexp_extract(url, '//([^/]*)', 1) AS first_host FROM u)
SELECT form, CASE form WHEN 7 THEN NULL WHEN 1 THEN 'social' WHEN 2 THEN 'social' WHEN 6 THEN 'social' WHEN 5 THEN 'publication' ELSE 'web' END AS shape,
 CASE form WHEN 1 THEN 'github' WHEN 4 THEN 'github' WHEN 2 THEN 'reddit' WHEN 3 THEN 'youtube' WHEN 6 THEN 'mastodon' ELSE NULL END AS known_platform, count(*) AS n,
 count(DISTINCT CASE WHEN form IN (1, 2, 6) THEN ltrim(regexp_extract(url, '([^/]*)$', 1), '@') END) AS handles
FROM p GROUP BY 1, 2, 3""")
def url_shapes(spark, d):
    first = "split_part(regexp_extract(url, '//([^/]*)', 1), '.', 1)"
    forms = F.array(*(F.expr(v.replace("{h}", first)) for v in _SHAPES))
    made = pages(spark, d).select(F.posexplode(forms).alias("form", "url"))
    known = F.when(urls.platform(F.col("url")).isin(list(urls.PLATFORMS)), urls.platform(F.col("url")))
    return made.groupBy("form", urls.shape(F.col("url")).alias("shape"), known.alias("known_platform")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(urls.handle(F.col("url"))).alias("handles"))


@query("identifier_types", r"""
WITH w AS (SELECT doc_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS t FROM documents)
SELECT CASE WHEN t LIKE '@%' THEN 'USERNAME' WHEN regexp_matches(t, '^[\w.+-]+@[\w-]+(\.[\w-]+)+$') THEN 'EMAIL'
  WHEN regexp_matches(t, '^(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$') THEN 'IP' ELSE 'other' END AS kind, count(*) AS n, count(DISTINCT doc_id) AS n_docs
FROM w WHERE trim(t) <> '' GROUP BY 1""")
def identifier_types(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    words = docs.select("doc_id", F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("t")).filter("trim(t) <> ''")
    kind = urls.identifier_type(F.col("t"))
    return words.groupBy(F.when(kind.isin("EMAIL", "IP"), kind).when(F.col("t").startswith("@"), "USERNAME").otherwise("other").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


VISIBLE_SQL = "regexp_replace(html, '<!--.*?-->', ' ', 'gs')"
for _tag in sorted(page_ops.DROPPED_TAGS, key=lambda t: (t not in page_ops.RAW_TAGS, t)):
    VISIBLE_SQL = rf"regexp_replace({VISIBLE_SQL}, '<{_tag}(\s[^>]*)?>.*?</{_tag}\s*>', ' ', 'gis')"
DECODED_SQL = lambda x: f"replace(replace({x}, '&quot;', '\"'), '&amp;', '&')"
_PAGE_SQL = rf"""(SELECT page_id, url, html, nullif(substr(trim(regexp_replace({DECODED_SQL("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")}, '\s+', ' ', 'g')), 1, 300), '') AS title, nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS lang,
  regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS hrefs FROM pages)"""


def _references_sql(text: str) -> str:
    """SQL of `text` with its character references decoded as the HTML standard says, as
    `html.unescape` does: by name, the old names also without a semicolon, and by number."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    table = lambda keys, values: f"MAP {{{', '.join(f'{k}: {v}' for k, v in zip(keys, values, strict=True))}}}"
    named = table([quoted(k) for k in html5], [quoted(v) for v in html5.values()])
    odd = [n for n in (*range(160), *range(0xFDD0, 0xFDF0), *(p * 0x10000 + k for p in range(17) for k in (0xFFFE, 0xFFFF))) if unescape(f"&#{n};") != chr(n)]
    numbered = table(odd, [quoted(unescape(f"&#{n};")) for n in odd])
    old = "|".join(sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k)))
    number = "CASE WHEN s[2] IN ('x', 'X') THEN try_cast('0x' || rtrim(s[3:], ';') AS BIGINT) ELSE try_cast(rtrim(s[2:], ';') AS BIGINT) END"
    char = f"list_transform([{number}], lambda n: CASE WHEN n IS NULL OR n > 1114111 OR n BETWEEN 55296 AND 57343 THEN chr(65533) WHEN map_contains({numbered}, n::INT) THEN {numbered}[n::INT] ELSE chr(n::INT) END)[1]"
    one = f"""CASE WHEN s = '' THEN '&' || p WHEN s = 'amp;' THEN '&' || p[5:] WHEN s[1] = '#' THEN {char} || p[length(s) + 1:] WHEN map_contains({named}, s) THEN {named}[s] || p[length(s) + 1:]
 WHEN regexp_matches(s, '^({old})') THEN {named}[regexp_extract(s, '^({old})')] || p[length(regexp_extract(s, '^({old})')) + 1:] ELSE '&' || p END"""
    found = r"regexp_extract(p, '^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)')"
    return f"array_to_string(list_transform(string_split({text}, '&'), lambda p, i: CASE WHEN i = 1 THEN p ELSE list_transform([{found}], lambda s: {one})[1] END), '')"


#: White space as `str.split` reads it, a no-break space included.
_LINE_SQL = lambda x: rf"trim(regexp_replace({x}, '[\t-\r\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"
_TITLE_SQL = f"""nullif(substr({_LINE_SQL(_references_sql("regexp_extract(html, '<title>(.*?)</title>', 1, 's')"))}, 1, 300), '')"""


@query("page_metadata", f"SELECT m.page_id, {_TITLE_SQL} AS title, lang, len(hrefs) AS n_links, NULL::VARCHAR AS canonical FROM {_PAGE_SQL} m")
def page_metadata(spark, d):
    found = page_ops.scanned(pages(spark, d), ["page_id"])
    return found.select("page_id", "title", "lang", F.size("links").cast("long").alias("n_links"), "canonical")


@query("page_visible_text", f"SELECT page_id, {_LINE_SQL(_references_sql(f"regexp_replace({VISIBLE_SQL}, '<[^>]*>', ' ', 'g')"))} AS visible FROM pages")
def page_visible_text(spark, d):
    return page_ops.scanned(pages(spark, d), ["page_id"]).select("page_id", "visible")


@query("page_link_edges", f"""
WITH l AS (SELECT {HOST_SQL} AS host, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS root, unnest(hrefs) AS href FROM {_PAGE_SQL})
SELECT host AS src, host AS dst_host, root || href AS target, count(*) AS n FROM l GROUP BY 1, 2, 3""")
def page_link_edges(spark, d):
    return page_ops.link_edges(pages(spark, d)).groupBy("src", "dst_host", "target").agg(F.count(F.lit(1)).alias("n"))


#: What is put before each page's body: a head with all that metadata are read from, links of each form.
_HEAD_SQL = """'<html lang="en"><head><meta name="generator" content="G' || (page_id % 7) || '"><meta property="og:site_name" content="Site &amp; ' || (page_id % 5) || '"><meta name="Description" content=" D' || page_id || ' "><link rel=canonical href="/c/' || page_id || '"></head>
<a href="../up/' || page_id || '">x</a><a href=''//cdn' || (page_id % 3) || '.example/x?y#z''>x</a><a href="?q=' || page_id || '">x</a><a href="https://www.github.com/u' || (page_id % 50) || '?tab=x">x</a><a href="https://dev.to/u' || (page_id % 50) || '">x</a><a href="mailto:a@b.example">x</a>'"""


@query("http_metadata", f"""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 2 ELSE 0 END AS redirect_count, 'G' || (page_id % 7) AS generator, 'Site & ' || (page_id % 5) AS site_name, 'D' || page_id AS description, '/c/' || page_id AS canonical,
 'https://dev.to/u' || (page_id % 50) || ',https://www.github.com/u' || (page_id % 50) AS profile_links, url LIKE 'https://%' AS https FROM pages""")
def http_metadata(spark, d):
    redirects = F.when(F.col("page_id") % 3 == 0, F.array(F.lit("a"), F.lit("b")))
    rows = pages(spark, d).select(F.col("page_id").cast("string").alias("url"), F.col("url").alias("final_url"), F.lit(200).alias("status_code"), redirects.alias("redirects"), F.concat(F.expr(_HEAD_SQL), "html").alias("html"))
    found = page_ops.http_metadata(rows)
    return found.select(F.col("url").cast("long").alias("page_id"), "redirect_count", "generator", "site_name", "description", "canonical", F.array_join("profile_links", ",").alias("profile_links"), "https")


@query("site_profile_edges", f"""
SELECT DISTINCT {HOST_SQL} AS host, unnest(['https://dev.to/u' || (page_id % 50), 'https://www.github.com/u' || (page_id % 50)]) AS dst FROM pages""")
def site_profile_edges(spark, d):
    rows = pages(spark, d).select("url", F.col("url").alias("final_url"), F.lit(200).alias("status_code"), F.array().cast("array<string>").alias("redirects"), F.concat(F.expr(_HEAD_SQL), "html").alias("html"))
    edges = page_ops.profile_edges(page_ops.http_metadata(rows))
    return edges.select(urls.host(F.col("src")).alias("host"), "dst").distinct()


_BASE_SQL = f"regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1)"
_FOLDER_SQL = f"regexp_extract({PATH_SQL}, '^(.*/)', 1)"
#: A reference of each form, and its address on a page two folders down.
_REFERENCES = [("'x/' || page_id", f"{_BASE_SQL} || {_FOLDER_SQL} || 'x/' || page_id"), ("'../up/' || page_id", f"{_BASE_SQL} || regexp_extract({PATH_SQL}, '^(.*/)[^/]*/[^/]*$', 1) || 'up/' || page_id"), ("'./' || page_id || '/../y?z'", f"{_BASE_SQL} || {_FOLDER_SQL} || 'y?z'"), ("'//cdn.example/' || page_id", "regexp_extract(url, '^([^:]*:)', 1) || '//cdn.example/' || page_id"), ("'?q=' || page_id", f"{_BASE_SQL} || {PATH_SQL} || '?q=' || page_id"), ("'#top'", "regexp_replace(url, '#.*', '') || '#top'"), ("'https://a.example/b/../c'", "'https://a.example/c'"), ("'mailto:a' || page_id || '@b.example'", "'mailto:a' || page_id || '@b.example'"), ("'/../' || page_id", f"{_BASE_SQL} || '/' || page_id")]


@query("resolved_references", " UNION ALL ".join(f"SELECT page_id, {k} AS form, {want} AS target FROM pages" for k, (_, want) in enumerate(_REFERENCES)))
def resolved_references(spark, d):
    made = pages(spark, d).select("page_id", "url", F.posexplode(F.array(*(F.expr(made) for made, _ in _REFERENCES))).alias("form", "href"))
    return made.select("page_id", "form", references.resolved(F.col("url"), F.col("href")).alias("target"))


#: Each page's own address in a text as Markdown, HTML and bare, with a badge and an image.
_TEXT_SQL = "'[Home](' || url || '), ![pic](https://img.example/' || page_id || '.png) [![b](https://img.shields.io/x.svg)](https://ci.example/' || (page_id % 9) || ') <a class=\"x\" href=\"https://h.example/' || page_id || '\">h</a> see https://bare.example/' || page_id || '.'"


@query("published_links", "SELECT page_id, url || ',https://h.example/' || page_id || ',https://bare.example/' || page_id AS links FROM pages")
def published_links(spark, d):
    made = pages(spark, d).select("page_id", F.expr(_TEXT_SQL).alias("text"))
    return made.select("page_id", F.array_join(references.published_links(F.col("text")), ",").alias("links"))


@query("domain_site_edges", f"""
WITH h AS (SELECT page_id, url, {HOST_SQL} AS host, {PATH_SQL} AS p FROM pages), l AS (SELECT *, string_split(host, '.') AS l FROM h),
e AS (SELECT DISTINCT {DOMAIN_SQL} AS src, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) || '://' || host || regexp_replace(p, '/+$', '') AS dst,
  CASE WHEN url LIKE 'https://%' THEN 'authoritative_record' ELSE 'search_reference' END AS rule_key FROM l WHERE host <> ''),
r(rule_key, score, ceiling) AS (VALUES {scoring.rules_sql()})
SELECT src, dst, 'LINKS_TO' AS type, round(least(greatest(1 - product(1 - score), max(score)), max(ceiling)), 4) AS score, count(*) AS n_rules FROM e JOIN r USING (rule_key) GROUP BY 1, 2""")
def domain_site_edges(spark, d):
    u = F.col("url")
    seen = pages(spark, d).select(urls.registrable_domain(urls.host(u)).alias("src"), urls.website(u).alias("dst"), F.when(u.startswith("https://"), "authoritative_record").otherwise("search_reference").alias("rule_key"))
    scored = scoring.score_groups(seen.filter("src <> ''"), ["src", "dst"], scoring.rules_table(spark))
    return scored.select("src", "dst", F.lit("LINKS_TO").alias("type"), "score", F.size("rules").cast("long").alias("n_rules"))


@query("noise_hosts_rejected", f"""
WITH h AS (SELECT page_id, {HOST_SQL} AS host FROM pages), busy AS (SELECT host FROM h GROUP BY 1 HAVING count(*) > (SELECT count(*) * 0.05 FROM h))
SELECT host, count(*) AS n FROM h WHERE host NOT IN (SELECT host FROM busy) GROUP BY 1""")
def noise_hosts_rejected(spark, d):
    seen = pages(spark, d).select(urls.host(F.col("url")).alias("host"))
    counts = seen.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    total = seen.agg(F.count(F.lit(1))).scalar()
    busy = counts.filter(F.col("n") > total * 0.05).select("host")
    return counts.join(busy, "host", "left_anti")


@query("first_last_pages", f"""
WITH h AS (SELECT page_id, {HOST_SQL} AS host FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS a, row_number() OVER (PARTITION BY host ORDER BY page_id DESC) AS z FROM h)
SELECT host, page_id, a = 1 AS is_first FROM r WHERE a = 1 OR z <= 5""")
def first_last_pages(spark, d):
    seen = pages(spark, d).select("page_id", urls.host(F.col("url")).alias("host"))
    first = seen.groupBy("host").agg(F.min("page_id").alias("first"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("page_id")))
    last = seen.withColumn("z", rank).filter("z <= 5").select("host", "page_id")
    both = last.unionByName(first.select("host", F.col("first").alias("page_id"))).distinct()
    return both.join(first, "host").select("host", "page_id", (F.col("page_id") == F.col("first")).alias("is_first"))
