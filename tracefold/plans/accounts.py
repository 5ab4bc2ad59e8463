"""Canonical identifiers, nested payloads, accounts of runs and reports over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import targets, urls
from ..operators import accounts as ops
from ..operators import payloads, report
from ..operators.tables import spread
from .registry import query


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("canonical_targets", """WITH c AS (SELECT c_custkey, c_custkey::VARCHAR AS k, (c_custkey % 256)::VARCHAR AS b FROM customer),
t AS (SELECT c_custkey, unnest([{'kind': 'USERNAME', 'value': 'user_' || k || '.x'}, {'kind': 'DOMAIN', 'value': 'www.shop-' || k || '.example.com'}, {'kind': 'EMAIL', 'value': 'mail.' || k || '@example.org'}, {'kind': 'URL', 'value': 'https://example.com/A/' || k || '?q=' || k},
 {'kind': 'IP', 'value': '10.0.' || b || '.7'}, {'kind': 'REPOSITORY', 'value': 'github:owner' || k || '/repo'}, {'kind': 'SOCIAL_PROFILE', 'value': 'reddit:name_' || k}]) AS s FROM c)
SELECT c_custkey, s.kind AS kind, s.value AS value, CASE WHEN s.kind = 'REPOSITORY' THEN 3 ELSE 1 END AS spellings FROM t""")
def canonical_targets(spark, d):
    k, b = F.col("c_custkey").cast("string"), (F.col("c_custkey") % 256).cast("string")
    forms = [("@User_", k, ".X"), ("WWW.Shop-", k, ".Example.COM."), ("Mail.", k, "@Example.ORG"), ("10.0.", b, ".7"), ("git@GitHub.com:Owner", k, "/Repo.git"), ("github.com/Owner", k, "/Repo"), ("https://GitHub.com/owner", k, "/repo/issues"), ("https://www.reddit.com/u/Name_", k, "/")]
    said = [F.concat(F.lit(x), mid, F.lit(y)) for x, mid, y in forms] + [F.concat(F.lit("HTTPS://Example.com:443/A/"), k, F.lit("?q="), k, F.lit("#top"))]
    rows = spread(table(spark, d, "customer").select("c_custkey")).select("c_custkey", F.explode(F.array(*said)).alias("text")).withColumn("kind", urls.identifier_type(F.col("text")))
    return rows.groupBy("c_custkey", "kind", targets.canonical(F.col("kind"), F.col("text")).alias("value")).agg(F.count(F.lit(1)).alias("spellings"))


def _payloads(spark, d):
    """Customers as nested payloads: a list of objects three levels down, keys that would collide as
    plain paths, a secret where the balance is below zero, a note too long where it is above 9000."""
    balance = F.col("c_acctbal")
    note = F.when(balance < 0, F.lit("key ghp_" + "a1B2" * 9)).when(balance > 9000, F.repeat("c_mktsegment", 600)).otherwise(F.col("c_mktsegment"))
    phones = F.array(F.struct(F.lit("555 0100").alias("phone")), F.struct(F.lit("555 0101").alias("phone")))
    contact = F.struct(F.struct(phones.alias("lines"), F.col("c_name").alias("label")).alias("work"))
    size = F.struct(F.struct(F.struct(F.col("c_custkey").alias("size")).alias("c")).alias("b"))
    return table(spark, d, "customer").select("c_custkey", F.to_json(F.struct(note.alias("note"), contact.alias("contact"), F.lit("flat").alias("a.b"), size.alias("a"))).alias("payload"))


_NOTE_SQL = f"CASE WHEN c_acctbal < 0 THEN 'key ghp_{'a1B2' * 9}' WHEN c_acctbal > 9000 THEN repeat(c_mktsegment, 600) ELSE c_mktsegment END"


@query("payload_privacy", f"""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 3 ELSE 2 END AS level, 'contact.work.lines[0].phone,contact.work.lines[1].phone' || CASE WHEN c_acctbal < 0 THEN ',note' ELSE '' END AS redacted,
CASE WHEN c_acctbal < 0 THEN 'key [REDACTED SECRET]' WHEN length({_NOTE_SQL}) > 4000 THEN substr({_NOTE_SQL}, 1, 4000) || '…[truncated]' ELSE {_NOTE_SQL} END AS note, c_custkey::VARCHAR AS size, 'flat' AS flat, c_name AS label, 6 AS leaves FROM customer""")
def payload_privacy(spark, d):
    found = payloads.walked(spread(_payloads(spark, d)), "payload")
    leaf = lambda path: F.col("data")[path]
    return found.select("c_custkey", "level", F.array_join("redacted", ",").alias("redacted"), leaf("note").alias("note"), leaf("a.b.c.size").alias("size"), leaf(r"a\.b").alias("flat"), leaf("contact.work.label").alias("label"), F.size("data").alias("leaves"))


@query("payload_hashes", f"""SELECT c_custkey, sha256('{{"a":{{"b":{{"c":{{"size":' || c_custkey || '}}}}}},"a.b":"flat","contact":{{"work":{{"label":"' || c_name || '","lines":[{{"phone":"555 0100"}},{{"phone":"555 0101"}}]}}}},"note":"' || {_NOTE_SQL} || '"}}') AS sha256 FROM customer""")
def payload_hashes(spark, d):
    return _payloads(spark, d).select("c_custkey", payloads.payload_sha256(F.col("payload")).alias("sha256"))


@query("run_accounts", """WITH s AS (SELECT DISTINCT o_orderpriority AS source, c_mktsegment AS type FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'),
r AS (SELECT o_custkey AS target, o_orderpriority AS source, count(*) FILTER (o_totalprice > 200000) AS findings, bool_or(o_orderstatus = 'F') AS bad, bool_or(o_orderstatus = 'P') AS late FROM orders GROUP BY 1, 2)
SELECT c_custkey AS target, s.source, CASE WHEN r.target IS NULL THEN 'SKIPPED' WHEN late THEN 'TIMEOUT' WHEN NOT bad THEN 'SUCCESS' WHEN findings > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS status, coalesce(findings, 0) AS findings, CASE WHEN bad THEN 'refused' END AS error
FROM customer JOIN s ON c_mktsegment = type LEFT JOIN r ON r.target = c_custkey AND r.source = s.source""")
def run_accounts(spark, d):
    customers, orders = table(spark, d, "customer"), table(spark, d, "orders")
    due = customers.select(F.col("c_custkey").alias("target"), F.col("c_mktsegment").alias("type"))
    known = orders.filter("o_orderstatus <> 'P'").join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("o_orderpriority").alias("source")).agg(F.collect_set("c_mktsegment").alias("types"))
    status = F.col("o_orderstatus")
    runs = orders.select(F.col("o_custkey").alias("target"), F.col("o_orderpriority").alias("source"), (F.col("o_totalprice") > 200000).cast("long").alias("findings"), F.when(status == "F", "refused").alias("error"), (status == "P").alias("timed_out"))
    return ops.run_rows(due, known, runs)


@query("execution_counters", """SELECT user_id, count(*) FILTER (event_type = 'purchase') AS stored, count(*) FILTER (event_type = 'view') AS seen, count(*) FILTER (event_type NOT IN ('purchase', 'view')) AS duplicate, count(*) FILTER (value > 150) AS created,
count(*) FILTER (value > 100 AND value <= 150) AS updated, count(*) FILTER (value < 50) AS inferred, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1""")
def execution_counters(spark, d):
    events, kind, value = table(spark, d, "events"), F.col("event_type"), F.col("value")
    findings = events.select("user_id", F.when(kind == "purchase", "stored").when(kind == "view", "seen").otherwise("duplicate").alias("disposition"))
    entities = events.select("user_id", F.when(value > 150, "insert").when(value > 100, "update").otherwise("keep").alias("action"))
    runs = events.select("user_id", F.when(kind == "error", "FAILED").otherwise("SUCCESS").alias("status"))
    return ops.execution_counters(findings, entities, events.select("user_id", (value < 50).alias("inferred")), runs, "user_id")


@query("report_counts", """SELECT c_mktsegment, 'customers' AS section, count(*) AS items, count(*) FILTER (c_acctbal < 0) AS withheld, count(*) FILTER (c_acctbal > 9000) AS redacted FROM customer GROUP BY 1
UNION ALL SELECT c_mktsegment, 'orders', count(*), count(*) FILTER (o_orderstatus = 'P'), count(*) FILTER (o_totalprice > 400000) FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def report_counts(spark, d):
    customers, orders = table(spark, d, "customer"), table(spark, d, "orders")
    own = customers.select("c_mktsegment", (F.col("c_acctbal") < 0).alias("withheld"), (F.col("c_acctbal") > 9000).alias("redacted"))
    placed = customers.join(orders, F.col("c_custkey") == F.col("o_custkey")).select("c_mktsegment", (F.col("o_orderstatus") == "P").alias("withheld"), (F.col("o_totalprice") > 400000).alias("redacted"))
    return ops.report_counts({"customers": own, "orders": placed}, "c_mktsegment")


@query("candidate_groups", """WITH o AS (SELECT c_nationkey AS nation, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS k, o_orderpriority AS label FROM orders JOIN customer ON o_custkey = c_custkey),
known AS (SELECT c_nationkey AS nation, c_custkey AS k FROM customer WHERE c_acctbal > 0), n AS (SELECT nation, k, label, count(*) AS n FROM o GROUP BY ALL)
SELECT known.nation, known.k::VARCHAR AS "group", 'orders' AS kind, label, coalesce(n, 0) AS n FROM known LEFT JOIN n ON n.nation = known.nation AND n.k = known.k
UNION ALL SELECT nation, 'unattributed', 'orders', label, sum(n)::BIGINT FROM n WHERE k IS NULL OR (nation, k) NOT IN (SELECT (nation, k) FROM known) GROUP BY 1, 4""")
def candidate_groups(spark, d):
    customers, orders = table(spark, d, "customer"), table(spark, d, "orders")
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("nation"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("k"), "o_orderpriority")
    known = customers.filter("c_acctbal > 0").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("k"))
    return ops.candidate_groups(known, {"orders": (placed, "o_orderpriority")}, "nation", "k")


@query("ranked_candidates", """WITH a AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1), r AS (SELECT c_nationkey, c_custkey, coalesce(n, 0) AS n_anchors, row_number() OVER (PARTITION BY c_nationkey ORDER BY coalesce(n, 0) DESC, c_acctbal DESC, c_custkey) AS rank FROM customer LEFT JOIN a ON o_custkey = c_custkey)
SELECT * FROM r WHERE rank <= 25""")
def ranked_candidates(spark, d):
    anchors = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("o_orderpriority").alias("anchors"))
    rows = table(spark, d, "customer").join(anchors, "c_custkey", "left").withColumn("anchors", F.coalesce("anchors", F.array().cast("array<string>")))
    best = report.key_items(rows, ["c_nationkey"], [*ops.candidate_order(F.col("anchors"), F.col("c_acctbal")), F.col("c_custkey")])
    return best.select("c_nationkey", "c_custkey", F.size("anchors").cast("long").alias("n_anchors"), F.col("rank").cast("long").alias("rank"))


@query("recent_orders", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10")
def recent_orders(spark, d):
    return ops.most_recent(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 10)


@query("source_explanations", """SELECT event_id, event_type = 'signup' AS subject, CASE WHEN event_type = 'view' THEN 'investigator_imported' ELSE 'api_fetched' END AS class,
CASE event_type WHEN 'view' THEN 'Imported by hand from a public search for the query ''' || json_extract_string(props, '$.k') || '''.' WHEN 'error' THEN 'Returned by unknown.' ELSE 'Returned by ' || event_type || '.' END AS sentence FROM events""")
def source_explanations(spark, d):
    kind = F.col("event_type")
    source = F.when(kind == "view", " manual_search_recon").when(kind != "error", kind)
    asked = F.when(kind == "view", F.get_json_object("props", "$.k"))
    role = F.create_map(F.lit("role"), F.when(kind == "signup", "subject").when(kind == "purchase", "candidate"))
    return table(spark, d, "events").select("event_id", ops.is_subject(role).alias("subject"), ops.evidence_class(source).alias("class"), ops.explained(source, asked).alias("sentence"))


@query("band_labels", "SELECT CASE WHEN value >= 150 THEN 'Strong correlation' WHEN value >= 100 THEN 'Moderate correlation' WHEN value >= 50 THEN 'Name-level only' ELSE 'Not Yet Rated' END AS label, count(*) AS n FROM events GROUP BY 1")
def band_labels(spark, d):
    value = F.col("value")
    band = F.when(value >= 150, "LIKELY_MATCH").when(value >= 100, "PROBABLE_MATCH").when(value >= 50, "WEAK_ASSOCIATION").otherwise("NOT_YET_RATED")
    return table(spark, d, "events").groupBy(ops.band_label(band).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("drawable_images", "SELECT page_id, url LIKE 'https://%' AND page_id % 3 < 2 AS drawable, page_id % 2 = 0 AS noise FROM pages")
def drawable_images(spark, d):
    k = F.col("page_id")
    image = F.when(k % 3 < 2, F.concat(F.col("url"), F.lit("/a.png"))).otherwise("https://192.168.0.7/a.png")
    result = F.concat(F.when(k % 2 == 0, "https://www.google.com/search?q=").otherwise("https://maps.google.org/?q="), k.cast("string"))
    return table(spark, d, "pages").select("page_id", urls.drawable(image).alias("drawable"), urls.is_noise(result).alias("noise"))
