"""Payloads made of the given tables, normalised."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import urls
from ..operators.tables import shared_folder
from ..sources import payloads as ops
from .identifiers import HOST_SQL
from .registry import query


def pages(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").withColumn("host", urls.host(F.col("url")))


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("dns_records", f"""WITH h AS (SELECT page_id, {HOST_SQL} AS host FROM pages),
r AS (SELECT host AS hostname, 'MX' AS record_type, CASE WHEN length(host) % 3 = 0 THEN '0 .' ELSE '10 mx' || (page_id % 4) || '.' || host || '.' END AS rec FROM h UNION ALL SELECT host, 'TXT', CASE WHEN page_id % 2 = 0 THEN 'v=spf1 -all' ELSE 'note ' || page_id END FROM h)
SELECT hostname, record_type, array_to_string(list_sort(list(DISTINCT rec)), '|') AS records, CASE WHEN record_type = 'MX' THEN array_to_string(list_sort(list(DISTINCT regexp_replace(split_part(rec, ' ', 2), '\\.$', '')) FILTER (rec <> '0 .')), '|') END AS mail_hosts,
 CASE WHEN record_type = 'MX' THEN bool_and(rec = '0 .') END AS null_mx, CASE WHEN record_type = 'TXT' THEN bool_or(rec LIKE 'v=spf1%') END AS has_spf FROM r GROUP BY 1, 2""")
def dns_records(spark, d):
    p = pages(spark, d)
    mx = F.when(F.length("host") % 3 == 0, F.lit("0 .")).otherwise(F.concat(F.lit("10 mx"), F.col("page_id") % 4, F.lit("."), "host", F.lit(".")))
    txt = F.when(F.col("page_id") % 2 == 0, F.lit("v=spf1 -all")).otherwise(F.concat(F.lit("note "), "page_id"))
    make = lambda kind, rec: p.select(F.to_json(F.struct(F.col("host").alias("hostname"), F.lit(kind).alias("type"), F.array(rec).alias("records"), F.lit(60).alias("ttl"))).alias("payload"))
    out = ops.dns(make("MX", mx).unionByName(make("TXT", txt)))
    text = lambda c: F.array_join(c, "|")
    # No mail host is an empty list here and no row of a list in SQL: both read as nothing.
    return out.select("hostname", "record_type", text("records").alias("records"), F.nullif(text("mail_hosts"), F.lit("")).alias("mail_hosts"), "null_mx", "has_spf")


@query("registrations", """SELECT lower('C' || c_custkey || '.example') AS domain, strftime(DATE '2000-01-01' + (c_custkey % 5000)::INT, '%Y-%m-%d') AS registered, CASE WHEN c_custkey % 2 = 0 THEN 'client hold' ELSE '' END AS notable_status, 'a.ns.example,b.ns.example' AS nameservers,
CASE WHEN c_custkey % 5 = 0 THEN 'REG-' || c_custkey ELSE 'Registrar ' || c_mktsegment END AS registrar, CASE WHEN c_custkey % 7 > 0 AND c_custkey % 11 > 0 THEN CASE WHEN c_custkey % 3 = 0 THEN c_name || ' Ltd' ELSE c_name END END AS registrant, c_custkey % 7 = 0 OR c_custkey % 11 = 0 AS privacy_service FROM customer""")
def registrations(spark, d):
    """Documents whose registrant stands below another entity for every fourth customer, whose
    organisation is a list of parts for every third, and whose remarks hide every eleventh."""
    c, key = table(spark, d, "customer"), F.col("c_custkey")
    date = F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), (key % 5000).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    name = F.when(key % 7 == 0, "Domains By Proxy, LLC").otherwise(F.col("c_name"))
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    org = F.when(key % 3 == 0, F.concat(F.lit(',["org",{},"text",["'), name, F.lit('","","Ltd"]]'))).otherwise(F.lit(""))
    owner = F.concat(F.lit('{"roles":["Registrant"],"vcardArray":["vcard",[["version",{},"text","4.0"],["fn",{"x":[1]},"text",'), quoted(name), F.lit("]"), org, F.lit("]]"), F.when(key % 11 == 0, ',"remarks":[{"title":"REDACTED FOR PRIVACY"}]').otherwise(""), F.lit("}"))
    seller = F.concat(F.lit('{"roles":["registrar"],"handle":"REG-'), key, F.lit('"'), F.when(key % 5 > 0, F.concat(F.lit(',"vcardArray":["vcard",[["fn",{},"text","Registrar '), "c_mktsegment", F.lit('"],["tel",{},"uri",5]]]'))).otherwise(""))
    entities = F.when(key % 4 == 0, F.concat(seller, F.lit(',"entities":['), owner, F.lit("]}"))).otherwise(F.concat(seller, F.lit("},"), owner))
    made = F.concat(
        F.lit('{"ldhName":"C'), key, F.lit('.example","status":['), F.when(key % 2 == 0, '"Client Hold",').otherwise(""), F.lit('"active"],"events":[{"eventAction":"registration","eventDate":"'), date,
        F.lit('"}],"nameservers":[{"ldhName":"B.NS.EXAMPLE."},{"ldhName":"a.ns.example"},{"x":1}],"entities":['), entities, F.lit("]}"),
    )
    out = ops.registration(c.select(made.alias("payload")))
    return out.select("domain", F.col("registered").cast("string").alias("registered"), F.array_join("notable_status", ",").alias("notable_status"), F.array_join("nameservers", ",").alias("nameservers"), "registrar", "registrant", "privacy_service")


#: Order keys as lines of an import: every seventh isn't JSON, others lack or overrun a field or name an
#: address that mustn't be fetched.
_IMPORT_SQL = """CASE WHEN o_orderkey % 7 = 0 THEN '{"target": "x' ELSE '{"target":"c' || o_custkey || '","query":"' || CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'q' END || '","url":"' || CASE WHEN o_orderkey % 5 = 0 THEN 'http://10.0.0.' || o_orderkey % 200 WHEN o_orderkey % 3 = 0 THEN 'https://e.example/' || o_orderkey % 50 ELSE 'e.example/' || o_orderkey % 50 END || '","title":"' || CASE WHEN o_orderkey % 13 = 0 THEN repeat('t', 501) ELSE 'T' || o_orderkey % 9 END || '"}' END"""


@query("imported_results", """WITH r AS (SELECT o_orderkey AS k, 'c' || o_custkey AS target, CASE WHEN o_orderkey % 7 = 0 THEN 'malformed' WHEN o_orderkey % 11 = 0 THEN 'query missing' WHEN o_orderkey % 13 = 0 THEN 'title too long' WHEN o_orderkey % 5 = 0 THEN 'address: private' END AS refused, 'https://e.example/' || o_orderkey % 50 AS url, 'T' || o_orderkey % 9 AS title FROM orders),
g AS (SELECT 'manual:' || target || ':' || url AS item, min(title) AS title, count(*) AS n FROM r WHERE refused IS NULL GROUP BY 1)
SELECT 'finding' AS part, item, title, n FROM g WHERE item NOT IN (SELECT 'manual:c' || c_custkey || ':https://e.example/1' FROM customer) UNION ALL SELECT 'refused', refused, NULL, count(*) FROM r WHERE refused IS NOT NULL GROUP BY 2""")
def imported_results(spark, d):
    path = f"{shared_folder(spark)}/imports-{uuid.uuid4().hex}"
    table(spark, d, "orders").select(F.expr(_IMPORT_SQL).alias("value")).write.text(path)
    stored = table(spark, d, "customer").select(F.concat(F.lit("manual:c"), "c_custkey", F.lit(":https://e.example/1")).alias("dedupe_key"))
    made, refused = ops.imported_results(ops.read_imports(spark, path, "json"), stored)
    made = made.select(F.lit("finding").alias("part"), F.col("dedupe_key").alias("item"), "title", F.col("n_rows").alias("n"))
    return made.unionByName(refused.groupBy(F.col("refused").alias("item")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("refused").alias("part"), "item", F.lit(None).cast("string").alias("title"), "n"))


_CERTS_SQL = "(SELECT lower(n_name) AS base, c_custkey AS id, 'C=US, O=' || c_mktsegment || ', CN=R3' AS issuer_name, lower('*.a' || (c_custkey % 9) || '.' || n_name || chr(10) || n_name || ',x.other') AS name_value, DATE '2020-01-01' + (c_custkey % 700)::INT AS not_before, c_mktsegment AS issuer FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def _certificates(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.lower("n_name").alias("base"), F.col("c_custkey").alias("id"), F.concat(F.lit("C=US, O="), "c_mktsegment", F.lit(", CN=R3")).alias("issuer_name"), F.lower(F.concat(F.lit("*.a"), F.col("c_custkey") % 9, F.lit("."), "n_name", F.lit("\n"), "n_name", F.lit(",x.other"))).alias("name_value"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 700).cast("int")).alias("not_before"))


@query("certificate_summary", f"""WITH c AS {_CERTS_SQL}, i AS (SELECT base, issuer, count(*) AS n, min(not_before) AS first FROM c GROUP BY 1, 2), h AS (SELECT base, 'a' || (id % 9) || '.' || base AS host FROM c UNION SELECT base, base FROM c),
k AS (SELECT base, count(*) AS hosts FROM h GROUP BY 1) SELECT i.base, sum(n)::BIGINT AS certificates, count(*) AS issuers, strftime(min(first), '%Y-%m-%d') AS earliest, array_to_string(list(issuer || '=' || n ORDER BY n DESC, issuer), ',') AS by_issuer, any_value(hosts) AS hosts FROM i JOIN k ON i.base = k.base GROUP BY 1""")
def certificate_summary(spark, d):
    return ops.certificates(_certificates(spark, d))[1].withColumns({"by_issuer": F.array_join("by_issuer", ","), "earliest": F.col("earliest").cast("string")})


@query("latest_certificates", f"SELECT base, id, rank FROM (SELECT base, id, row_number() OVER (PARTITION BY base ORDER BY not_before DESC, id) AS rank FROM {_CERTS_SQL}) WHERE rank <= 50")
def latest_certificates(spark, d):
    return ops.certificates(_certificates(spark, d))[0].select("base", "id", F.col("rank").cast("long").alias("rank"))


@query("certificate_subdomains", f"SELECT DISTINCT base, 'a' || (id % 9) || '.' || base AS host FROM {_CERTS_SQL}")
def certificate_subdomains(spark, d):
    return ops.subdomains(_certificates(spark, d))


@query("archive_coverage", """WITH r AS (SELECT 'h' || (o_custkey % 50) AS host, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN date_trunc('day', o_orderdate) WHEN o_orderkey % 3 = 1 THEN date_trunc('month', o_orderdate) ELSE date_trunc('second', o_orderdate) END AS t, 'u' || (o_orderkey % 40) AS original FROM orders)
SELECT host, min(t)::TIMESTAMP AS first_at, max(t)::TIMESTAMP AS last_at, count(*) AS snapshots, count(DISTINCT original) AS urls, array_to_string(list_sort(list(DISTINCT year(t))), ',') AS years, arg_min(original, (t::TIMESTAMP, original)) AS first_url FROM r GROUP BY 1""")
def archive_coverage(spark, d):
    return ops.archive_index(_snapshots(spark, d)).withColumns({"years": F.array_join(F.col("years").cast("array<string>"), ","), "first_at": F.col("first_at").cast("timestamp_ntz"), "last_at": F.col("last_at").cast("timestamp_ntz")})


def _snapshots(spark, d):
    o, key = table(spark, d, "orders"), F.col("o_orderkey")
    stamp = F.when(key % 3 == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(key % 3 == 1, F.date_format("o_orderdate", "yyyyMM")).otherwise(F.date_format("o_orderdate", "yyyyMMddHHmmss"))
    return o.select(F.concat(F.lit("h"), F.col("o_custkey") % 50).alias("host"), stamp.alias("stamp"), F.concat(F.lit("u"), key % 40).alias("original"))


@query("latest_snapshots", """WITH r AS (SELECT 'h' || (o_custkey % 50) AS host, CASE WHEN o_orderkey % 3 = 0 THEN date_trunc('day', o_orderdate) WHEN o_orderkey % 3 = 1 THEN date_trunc('month', o_orderdate) ELSE date_trunc('second', o_orderdate) END::TIMESTAMP AS "at", 'u' || (o_orderkey % 40) AS original FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY "at" DESC, original) AS rank FROM r) SELECT * FROM n WHERE rank <= 5""")
def latest_snapshots(spark, d):
    return ops.latest_snapshots(_snapshots(spark, d)).withColumns({"at": F.col("at").cast("timestamp_ntz"), "rank": F.col("rank").cast("long")})


@query("security_headers", f"""SELECT url, {HOST_SQL} AS hostname, trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 's')) AS title, CASE WHEN page_id % 2 = 0 THEN 'content-security-policy' ELSE 'strict-transport-security,content-security-policy' END AS present, (CASE WHEN page_id % 2 = 0 THEN 0.14 ELSE 0.29 END)::DOUBLE AS score FROM pages""")
def security_headers(spark, d):
    headers = F.when(F.col("page_id") % 2 == 0, F.create_map(F.lit("Content-Security-Policy"), F.lit("x"))).otherwise(F.create_map(F.lit("Content-Security-Policy"), F.lit("x"), F.lit("STRICT-Transport-Security"), F.lit("y")))
    out = ops.http_metadata(pages(spark, d).withColumn("headers", headers))
    return out.select("url", "hostname", "title", F.array_join("present", ",").alias("present"), "score")


@query("public_repositories", "WITH r AS (SELECT 's' || s_suppkey AS owner, 'r' || p_partkey AS full_name, p_type AS pushed_at FROM part JOIN supplier ON s_suppkey = p_partkey % 20 + 1 WHERE p_partkey % 4 > 0) SELECT owner, full_name FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY pushed_at DESC, full_name) AS k FROM r) WHERE k <= 30")
def public_repositories(spark, d):
    rows = table(spark, d, "part").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("p_partkey") % 20 + 1)
    one = F.struct(F.concat(F.lit("r"), "p_partkey").alias("full_name"), (F.col("p_partkey") % 4 == 0).alias("private"), F.struct(F.concat(F.lit("s"), "s_suppkey").alias("login")).alias("owner"), F.col("p_type").alias("pushed_at"))
    # An owner has every 20th part: pages of 50 repositories at most.
    lists = rows.groupBy("s_suppkey", F.floor(F.col("p_partkey") / 1000)).agg(F.to_json(F.collect_list(one)).alias("payload"))
    return ops.repositories(lists, most=30).select("owner", "full_name")


@query("commit_activity", """WITH r AS (SELECT 'r' || (user_id % 10) AS repo, event_type AS author, ts AS t FROM events), b AS (SELECT repo, author, count(*) AS n FROM r GROUP BY 1, 2), a AS (SELECT repo, array_to_string(list(author || '=' || n ORDER BY n DESC, author), ',') AS authors FROM b GROUP BY 1)
SELECT r.repo, count(*) AS commits, min(t) AS first_at, max(t) AS last_at, count(DISTINCT t::DATE) AS active_days, any_value(authors) AS authors FROM r JOIN a ON r.repo = a.repo GROUP BY 1""")
def commit_activity(spark, d):
    rows = table(spark, d, "events").select(F.concat(F.lit("r"), F.col("user_id") % 10).alias("repo"), F.col("event_type").alias("author"), F.col("ts").alias("at"))
    return ops.commit_activity(rows).withColumn("authors", F.array_join("authors", ","))


@query("breach_summary", """WITH r AS (SELECT user_id AS subject, 'B' || (event_id % 9) AS name, event_type AS class, CASE WHEN event_id % 3 = 0 THEN ts::DATE WHEN event_id % 3 = 1 THEN NULL ELSE ts::DATE END AS day FROM events)
SELECT subject, array_to_string(list_sort(list(DISTINCT name)), ',') AS names, strftime(max(day), '%Y-%m-%d') AS latest, array_to_string(list_sort(list(DISTINCT class)), ',') AS data_classes FROM r GROUP BY 1""")
def breach_summary(spark, d):
    e, key, day = table(spark, d, "events"), F.col("event_id"), F.date_format("ts", "yyyy-MM-dd")
    one = F.struct(F.concat(F.lit("B"), key % 9).alias("Name"), F.when(key % 3 == 0, day).when(key % 3 == 1, "unknown").alias("BreachDate"), F.concat(day, F.lit("T00:00:00Z")).alias("AddedDate"), F.array("event_type").alias("DataClasses"))
    lists = e.select(F.col("user_id").alias("subject"), F.to_json(F.array(one)).alias("payload"))
    out = ops.breaches(lists)
    return out.select("subject", F.array_join("names", ",").alias("names"), F.col("latest").cast("string").alias("latest"), F.array_join("data_classes", ",").alias("data_classes"))


@query("search_results", """WITH r AS (SELECT o_custkey AS query, 'u' || o_orderkey AS url, o_orderpriority AS title, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position FROM orders)
SELECT query, position, title, url, (CASE WHEN query % 3 = 0 AND position <= 3 THEN 0.5 ELSE 0.4 END)::DOUBLE AS confidence FROM r""")
def search_results(spark, d):
    o = table(spark, d, "orders")
    lists = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.concat(F.lit("u"), "o_orderkey").alias("u"), F.col("o_orderpriority").alias("title")))).alias("all"))
    results = lambda name: F.transform("all", lambda x: F.struct(x["title"].alias("title"), x["u"].alias(name)))
    key = F.col("o_custkey") % 3
    shape = F.when(key == 0, F.to_json(F.struct(F.struct(results("url").alias("results")).alias("web"), F.lit(True).alias("ranked")))).when(key == 1, F.to_json(F.struct(results("link").alias("items")))).otherwise(F.to_json(F.struct(results("url").alias("results"))))
    return ops.search_results(lists.select(F.col("o_custkey").alias("query"), shape.alias("payload"))).select("query", F.col("position").cast("long").alias("position"), "title", "url", "confidence")


@query("quarantined_payloads", "SELECT CASE WHEN conv_id % 3 = 0 THEN 'empty' ELSE 'malformed' END AS error_type, count(*) AS n FROM conversations WHERE conv_id % 3 < 2 GROUP BY 1")
def quarantined_payloads(spark, d):
    key = F.col("conv_id") % 3
    made = table(spark, d, "conversations").select(F.when(key == 0, "").when(key == 1, F.concat(F.lit('{"hostname": '), "role")).otherwise(F.to_json(F.struct(F.col("role").alias("hostname")))).alias("payload"))
    return ops.quarantine(made, "struct<hostname:string>")[1].groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))
