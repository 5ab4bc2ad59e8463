"""Scopes, purges, audit, quality of discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import admin as ops
from .registry import query


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("case_search", "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%0012%' AND lower(c_mktsegment) IN ('building', 'machinery')")
def case_search(spark, d):
    return table(spark, d, "customer").filter(F.col("c_name").ilike("%0012%") & F.lower("c_mktsegment").isin("building", "machinery") & ops.in_scope("c_mktsegment", None)).select("c_custkey", "c_name")


@query("workspace_scope", "SELECT 'all' AS scope, count(*) AS n FROM customer UNION ALL SELECT 'some', count(*) FILTER (c_mktsegment = 'BUILDING') FROM customer UNION ALL SELECT 'none', count(*) FILTER (false) FROM customer")
def workspace_scope(spark, d):
    rows = table(spark, d, "customer")
    counted = rows.agg(*(F.count_if(ops.in_scope("c_mktsegment", scope)).alias(name) for name, scope in (("all", None), ("some", ["BUILDING"]), ("none", []))))
    return counted.unpivot([], ["all", "some", "none"], "scope", "n")


@query("purge", "WITH doomed AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0), refused AS (SELECT k FROM doomed WHERE k IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')), gone AS (SELECT k FROM doomed WHERE k NOT IN (SELECT k FROM refused)) SELECT 'customer' AS name, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT k FROM gone) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT k FROM gone) UNION ALL SELECT 'refused', count(*) FROM refused")
def purge(spark, d):
    customers, orders = table(spark, d, "customer").withColumnRenamed("c_custkey", "k"), table(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    left, refused = ops.purged({"customer": customers, "orders": orders}, customers.filter("c_acctbal < 0"), orders.filter("o_orderstatus = 'P'"), "k")
    out = None
    for name, rows in (left | {"refused": refused}).items():
        n = rows.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@query("adopted_cases", "SELECT c_custkey AS case_id, CASE WHEN c_custkey % 5 = 0 THEN 'w0' ELSE c_mktsegment END AS workspace_id, c_custkey % 5 = 0 AS audited FROM customer")
def adopted_cases(spark, d):
    cases = table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")).alias("workspace_id"))
    now, audit = ops.adopted(cases, "w0")
    return now.join(audit.select("case_id", F.lit(True).alias("audited")), "case_id", "left").fillna(False, ["audited"])


@query("audit_visibility", "WITH a AS (SELECT event_id, user_id AS actor, CASE WHEN event_type <> 'error' THEN event_type END AS w FROM events) SELECT event_id FROM a WHERE w = 'signup' OR (w IS NULL AND actor IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 100))")
def audit_visibility(spark, d):
    events = table(spark, d, "events")
    audit = events.select("event_id", F.col("user_id").alias("actor"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("workspace_id"))
    members = events.filter("event_type = 'signup' AND value > 100").select(F.col("user_id").alias("actor"), F.col("event_type").alias("workspace_id"))
    return ops.visible_audit(audit, "signup", members).select("event_id")


@query("audit_metadata", """SELECT p_partkey, '{"brand":"' || p_brand || '","size":"' || p_size || '"}' AS kept, 2 AS dropped FROM part""")
def audit_metadata(spark, d):
    data = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("API_key"), F.col("p_name"), F.lit("size"), F.col("p_size").cast("string"), F.lit("Session-Id"), F.col("p_type"))
    kept, dropped = ops.audit_metadata(data)
    return table(spark, d, "part").select("p_partkey", F.to_json(kept).alias("kept"), dropped.alias("dropped"))


@query("applicable_sources", "SELECT p_partkey AS target, p_brand AS source FROM (SELECT p_partkey, split_part(p_type, ' ', 1) AS t FROM part) JOIN (SELECT DISTINCT p_brand, split_part(p_type, ' ', 1) AS t FROM part WHERE p_size > 45 AND p_brand <> 'Brand#11') USING (t)")
def applicable_sources(spark, d):
    part = table(spark, d, "part").withColumn("type", F.split_part("p_type", F.lit(" "), F.lit(1)))
    sources = part.filter("p_size > 45").groupBy(F.col("p_brand").alias("source")).agg(F.collect_set("type").alias("types"))
    return ops.applicable(part.select(F.col("p_partkey").alias("target"), "type"), sources, exclude=["Brand#11"]).select("target", "source")


@query("advisory_triage", """SELECT s_name AS package, 'A' || p_partkey AS advisory, CASE WHEN p_size > 40 THEN 'critical' WHEN p_size > 30 THEN 'high' ELSE 'low' END AS severity, CASE WHEN p_partkey % 10 = 0 THEN 'waived' WHEN p_size > 30 THEN 'blocking' ELSE 'informational' END AS state FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier)""")
def advisory_triage(spark, d):
    part, supplier = table(spark, d, "part"), table(spark, d, "supplier")
    n = supplier.agg(F.count(F.lit(1))).scalar()
    both = part.withColumn("s_suppkey", F.col("p_partkey") % n).join(supplier, "s_suppkey")
    severity = F.when(F.col("p_size") > 40, "CRITICAL").when(F.col("p_size") > 30, "High").otherwise("low")
    rows = both.select("s_name", F.concat(F.lit("A"), "p_partkey").alias("id"), severity.alias("severity"), "p_partkey")
    one = rows.filter("p_partkey % 2 = 0").groupBy("s_name").agg(F.collect_list(F.struct("id", "severity")).alias("vulns")).select(F.to_json(F.struct(F.array(F.struct(F.col("s_name").alias("name"), "vulns")).alias("dependencies"))).alias("report"))
    two = rows.filter("p_partkey % 2 = 1").select(F.to_json(F.struct(F.create_map("id", F.struct(F.col("s_name").alias("name"), "severity")).alias("vulnerabilities"))).alias("report"))
    waived = part.filter("p_partkey % 10 = 0").select(F.concat(F.lit("A"), "p_partkey").alias("advisory"))
    return ops.advisories(one.unionByName(two), waived)


@query("discovery_metrics", """WITH f AS (SELECT source, md5(text) AS k, length(text) > 500 AS useful FROM documents), known AS (SELECT DISTINCT source, md5(text) AS k FROM documents WHERE doc_id % 3 = 0 UNION SELECT DISTINCT source, md5(source || doc_id) FROM documents WHERE doc_id % 50 = 1),
decoy AS (SELECT DISTINCT source, k FROM f WHERE k LIKE 'a0%'), hit AS (SELECT DISTINCT source, k FROM f),
r AS (SELECT kn.source, count(*) AS known, count(h.k) AS found FROM known kn LEFT JOIN hit h ON kn.source = h.source AND kn.k = h.k GROUP BY 1), d AS (SELECT source, count(*) AS n FROM decoy GROUP BY 1),
a AS (SELECT source, count(*) AS rows, count(*) FILTER (useful) AS useful, count(DISTINCT k) AS dist FROM f GROUP BY 1)
SELECT r.source, round(found / known, 3) AS recall, round(useful / rows, 3) AS useful_share, coalesce(d.n, 0) AS false_hits, round(1 - dist / rows, 3) AS duplicate_rate, coalesce(d.n, 0) = 0 AS clean FROM r LEFT JOIN d USING (source) LEFT JOIN a USING (source)""")
def discovery_metrics(spark, d):
    docs = table(spark, d, "documents")
    found = docs.select("source", F.md5("text").alias("url_key"), (F.length("text") > 500).alias("useful"))
    known = docs.filter("doc_id % 3 = 0").select("source", F.md5("text").alias("url_key")).unionByName(docs.filter("doc_id % 50 = 1").select("source", F.md5(F.concat("source", "doc_id")).alias("url_key"))).distinct()
    return ops.discovery(found, known, found.filter("url_key LIKE 'a0%'").select("source", "url_key").distinct(), ["source"])
