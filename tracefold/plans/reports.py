"""Report sections over events, orders and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import report as ops
from .findings import FINDINGS_SQL, case_findings
from .registry import query

DECISIONS_SQL = "(SELECT user_id AS subject, ts AS decided_at, event_id AS seq, CASE WHEN event_type = 'signup' THEN 'CONFIRMED' WHEN event_type = 'purchase' THEN 'NEEDS_REVIEW' WHEN event_type = 'error' THEN 'REJECTED' END AS decision FROM events)"


def decisions(spark, d):
    kind = F.col("event_type")
    said = F.when(kind == "signup", "CONFIRMED").when(kind == "purchase", "NEEDS_REVIEW").when(kind == "error", "REJECTED")
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("subject"), F.col("ts").alias("decided_at"), F.col("event_id").alias("seq"), said.alias("decision"))


@query("latest_decisions", f"WITH l AS (SELECT subject, arg_max(seq, (decided_at, seq)) AS seq FROM {DECISIONS_SQL} GROUP BY 1) SELECT x.subject, decision, decided_at FROM {DECISIONS_SQL} x JOIN l ON x.seq = l.seq WHERE decision IS NOT NULL")
def latest_decisions(spark, d):
    return ops.latest_decisions(decisions(spark, d), ["subject"])


@query("decision_overlay", f"""WITH l AS (SELECT subject, arg_max(seq, (decided_at, seq)) AS seq FROM {DECISIONS_SQL} GROUP BY 1), o AS (SELECT x.subject, decision FROM {DECISIONS_SQL} x JOIN l ON x.seq = l.seq WHERE decision IS NOT NULL),
i AS (SELECT user_id AS subject, max(value) > 195 AS corroborated FROM events GROUP BY 1)
SELECT CASE WHEN decision IS NOT NULL THEN 'decision' WHEN corroborated THEN 'corroborated' ELSE 'unresolved lead' END AS basis, coalesce(decision = 'NEEDS_REVIEW', true) AS awaiting, count(*) AS n FROM i LEFT JOIN o USING (subject) GROUP BY 1, 2""")
def decision_overlay(spark, d):
    items = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("user_id").alias("subject")).agg((F.max("value") > 195).alias("corroborated"))
    seen = ops.overlaid(items, ops.latest_decisions(decisions(spark, d), ["subject"]), ["subject"])
    return seen.groupBy(ops.basis(F.col("decision"), F.col("corroborated")).alias("basis"), ops.awaiting(seen).alias("awaiting")).agg(F.count(F.lit(1)).alias("n"))


@query("key_findings", f"SELECT case_id, seq, confidence, rank FROM (SELECT case_id, seq, confidence, row_number() OVER (PARTITION BY case_id ORDER BY confidence DESC, observed_at DESC, seq) AS rank FROM {FINDINGS_SQL}) WHERE rank <= 25")
def key_findings(spark, d):
    return ops.key_items(case_findings(spark, d), ["case_id"], [F.desc("confidence"), F.desc("observed_at"), F.col("seq")]).select("case_id", "seq", "confidence", F.col("rank").cast("long").alias("rank"))


@query("place_rollup", "SELECT min(n_name) AS n_name, count(DISTINCT c_name) AS names, bool_or(c_acctbal > 9900) AS corroborated FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY lower(trim(n_name)) HAVING count(DISTINCT c_name) >= 5")
def place_rollup(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet").join(spark.read.parquet(f"{d}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("flag", F.col("c_acctbal") > 9900)
    return ops.rolled_up(rows, "n_name", "c_name", "flag", least=5)


@query("claims_by_source", "SELECT p_brand, p_size, arg_min(p_name, p_partkey) AS url, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2")
def claims_by_source(spark, d):
    return ops.claims_by_source(spark.read.parquet(f"{d}/part.parquet").withColumn("url", F.col("p_name")), "p_brand", "p_size", "p_partkey")


@query("channel_costs", """WITH c AS (SELECT user_id, event_type, floor(value / 10)::BIGINT AS searches, CASE WHEN user_id % 6 > 0 THEN 0.005 END AS price, length(props) AS tokens FROM events)
SELECT user_id, sum(searches)::BIGINT AS searches, CASE WHEN count(*) FILTER (price IS NULL) = 0 THEN round(sum(searches * price), 6) END::DOUBLE AS cost, sum(tokens)::BIGINT AS tokens,
 arg_max(CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'NO_RESULTS' ELSE 'OK' END, CASE event_type WHEN 'error' THEN 5 WHEN 'view' THEN 2 ELSE 1 END) AS worst,
 coalesce(CASE WHEN count(*) FILTER (price IS NULL) = 0 THEN round(sum(searches * price), 6) END >= 3.2, false) AS exhausted FROM c GROUP BY 1""")
def channel_costs(spark, d):
    kind = F.col("event_type")
    calls = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.floor(F.col("value") / 10).alias("searches"), F.when(F.col("user_id") % 6 > 0, 0.005).alias("unit_price"), F.length("props").alias("tokens"), F.when(kind == "error", "ERROR").when(kind == "view", "NO_RESULTS").otherwise("OK").alias("outcome"))
    return ops.costs(calls, ["user_id"], 3.2)


@query("report_documents", """SELECT case_id, 'customers' AS section, count(*) AS n FROM (SELECT c_mktsegment AS case_id FROM customer) GROUP BY 1 UNION ALL SELECT c_mktsegment, 'orders', count(*) FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def report_documents(spark, d):
    customers, orders = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("customer", "orders"))
    own = customers.select(F.col("c_mktsegment").alias("case_id"), "c_custkey", "c_name")
    placed = customers.join(orders, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_mktsegment").alias("case_id"), "o_orderkey")
    made = ops.documents({"customers": own, "orders": placed}, "case_id")
    return made.groupBy("case_id", "section").agg(F.count("item").alias("n"))


@query("contact_owners", """WITH o AS (SELECT l_partkey, arg_min(l_suppkey, (l_orderkey, l_linenumber, l_suppkey)) AS l_suppkey, list(DISTINCT l_suppkey) AS a FROM lineitem GROUP BY 1)
SELECT l_partkey, l_suppkey, array_to_string(list_sort(list_filter(a, lambda x: x <> l_suppkey)), ',') AS also_seen_in FROM o""")
def contact_owners(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_partkey", "l_suppkey", F.struct("l_orderkey", "l_linenumber").alias("seq"))
    out = ops.also_seen(rows, ["l_partkey"], "l_suppkey", "seq")
    return out.withColumn("also_seen_in", F.array_join(F.col("also_seen_in").cast("array<string>"), ","))


@query("status_pivot", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def status_pivot(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)


@query("attention_feed", """SELECT 'failed order' AS kind, o_orderkey AS id, c_name AS name, 1 AS severity FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND o_totalprice > 400000
UNION ALL SELECT 'idle customer', c_custkey, c_name, 2 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def attention_feed(spark, d):
    customers, orders = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("customer", "orders"))
    failed = orders.filter("o_orderstatus = 'F' AND o_totalprice > 400000").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.lit("failed order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("c_name").alias("name"), F.lit(1).alias("severity"))
    idle = customers.join(orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select(F.lit("idle customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(2).alias("severity"))
    return failed.unionByName(idle)
