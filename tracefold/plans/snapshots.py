"""States of subjects as a run saw them, and timelines with what their entries show."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import ledger
from ..operators import snapshots as ops
from .extraction import table
from .findings import FINDINGS_SQL, case_findings
from .registry import query


def observations(spark, d):
    """Findings of events, evidence of documents, entities of customers, relationships of orders."""
    t = lambda name: table(spark, d, name)
    at = lambda key: F.timestamp_seconds(F.lit(1704067200) + F.col(key) % 1000000)
    now = F.to_timestamp(F.lit("2024-06-01 00:00:00"))
    findings = case_findings(spark, d).withColumn("id", F.col("seq")).withColumn("title", F.concat_ws(" ", "kind", "k")).withColumn("classification", F.when(F.col("seq") % 3 > 0, "SENSITIVE")).withColumn("data", F.parse_json(F.to_json(F.struct("k", F.struct("value").alias("inner"))))).withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    evidence = t("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("collector"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("size_bytes"), F.when(F.col("doc_id") % 2 == 0, at("doc_id")).alias("retrieved_at"))
    entities = t("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("type"), F.col("c_name").alias("display_name"), (F.col("c_custkey") % 100 / 100).alias("confidence"))
    edges = t("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 > 0, "OWNS").alias("type"), F.col("o_custkey").alias("source_entity_id"), F.col("o_orderkey").alias("target_entity_id"), F.lit("").alias("collector"))
    kept = [ops.snapshots(rows, subject, []) for subject, rows in (("FINDING", findings), ("EVIDENCE", evidence), ("ENTITY", entities), ("RELATIONSHIP", edges))]
    return reduce(lambda a, b: a.unionByName(b), kept).withColumn("collector", F.lit("observer")).withColumn("observed_at", now)


@query("execution_snapshots", """SELECT 'FINDING' AS subject_type, event_id::VARCHAR AS subject_id, event_type || ' ' || json_extract_string(props, '$.k') AS label FROM events UNION ALL SELECT 'EVIDENCE', doc_id::VARCHAR, sha256(text) FROM documents
UNION ALL SELECT 'ENTITY', c_custkey::VARCHAR, c_name FROM customer UNION ALL SELECT 'RELATIONSHIP', o_orderkey::VARCHAR, o_custkey::VARCHAR FROM orders""")
def execution_snapshots(spark, d):
    part = lambda name: F.get_json_object("state", f"$.{name}")
    return observations(spark, d).select("subject_type", "subject_id", F.coalesce(part("title"), part("sha256"), part("display_name"), part("source_entity_id")).alias("label"))


@query("rehydrated_subjects", f"""SELECT 'FINDING' AS subject_type, seq::VARCHAR AS id, kind AS type, confidence, 'observer' AS collector, CASE WHEN seq % 3 > 0 THEN 'SENSITIVE' ELSE 'PUBLIC' END AS says, strftime(observed_at, '%Y-%m-%d %H:%M:%S') AS at, value AS measure FROM {FINDINGS_SQL}
UNION ALL SELECT 'EVIDENCE', doc_id::VARCHAR, NULL, NULL, coalesce(nullif(source, ''), 'observer'), coalesce(sha256(text), ''), CASE WHEN doc_id % 2 = 0 THEN strftime(to_timestamp(1704067200 + doc_id % 1000000) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') ELSE '2024-06-01 00:00:00' END, coalesce(octet_length(encode(text)), 0)::DOUBLE FROM documents
UNION ALL SELECT 'ENTITY', c_custkey::VARCHAR, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment ELSE 'PERSONA' END, c_custkey % 100 / 100.0, NULL, c_name, NULL, NULL FROM customer
UNION ALL SELECT 'RELATIONSHIP', o_orderkey::VARCHAR, CASE WHEN o_orderkey % 2 > 0 THEN 'OWNS' ELSE 'MENTIONS' END, 0.0, 'observer', 'WEAK_ASSOCIATION', NULL, NULL FROM orders""")
def rehydrated_subjects(spark, d):
    seen = observations(spark, d)
    text = lambda column: F.date_format(column, "yyyy-MM-dd HH:mm:ss")
    none = F.lit(None)
    row = lambda subject, type_, confidence, collector, says, at, measure: ops.rehydrated(seen, subject, ["subject_type"]).select("subject_type", "id", type_.cast("string").alias("type"), confidence.cast("double").alias("confidence"), collector.cast("string").alias("collector"), says.alias("says"), at.cast("string").alias("at"), measure.cast("double").alias("measure"))
    c = F.col
    parts = [
        row("FINDING", c("kind"), c("confidence"), c("collector"), c("classification"), text("observed_at"), F.try_variant_get("data", "$.inner.value", "double")),
        row("EVIDENCE", none, none, c("collector"), c("sha256"), text("retrieved_at"), c("size_bytes")),
        row("ENTITY", c("type"), c("confidence"), none, c("display_name"), none, none),
        row("RELATIONSHIP", c("type"), c("confidence"), c("collector"), c("strength"), none, none),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


#: Kinds of dated findings by the kind of event; their payloads show two parts of four.
_KINDS = {"signup": "DOMAIN_REGISTRATION", "purchase": "CERTIFICATE", "view": "ARCHIVE_SNAPSHOT", "click": "BREACH_NOTICE", "error": "REPOSITORY"}
_ENTRIES_SQL = f"""(SELECT event_id AS finding_id, 'case-' || (user_id % 20) AS case_id, CASE event_type WHEN 'signup' THEN 'domain_registration' WHEN 'purchase' THEN 'certificate' WHEN 'view' THEN 'archive_snapshot' WHEN 'click' THEN 'breach_notice' ELSE 'repository_created' END AS entry, ts AS occurred_at,
 'issuer=' || event_type || ',login=' || user_id AS shown FROM events)"""


def dated(spark, d):
    kind = F.lit(None).cast("string")
    for name, found in _KINDS.items():
        kind = F.when(F.col("event_type") == name, found).otherwise(kind)
    data = F.to_json(F.struct(F.col("user_id").alias("login"), F.col("props").alias("raw"), F.col("event_type").alias("issuer"), F.struct("value").alias("inner")))
    rows = table(spark, d, "events").select(F.concat(F.lit("case-"), F.col("user_id") % 20).alias("case_id"), F.col("event_id").alias("finding_id"), kind.alias("kind"), F.col("ts").alias("observed_at"), F.repeat("event_type", 80).alias("title"), data.alias("data"))
    return rows


def _shown(entries):
    pairs = F.array_sort(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return entries.withColumn("shown", F.array_join(pairs, ",")).withColumn("occurred_at", F.col("observed_at"))


@query("timeline_entries", f"SELECT finding_id, case_id, entry, occurred_at, shown FROM {_ENTRIES_SQL} WHERE entry IN ('certificate', 'breach_notice', 'repository_created') ORDER BY occurred_at DESC, finding_id DESC")
def timeline_entries(spark, d):
    some = ledger.timeline_entries(dated(spark, d), ["certificate", "breach_notice", "repository_created"])
    return ledger.in_order(_shown(some).select("finding_id", "case_id", "entry", "occurred_at", "shown"), "occurred_at", "finding_id", newest_first=True)


@query("timeline_preview", f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY occurred_at DESC, finding_id DESC) AS rank FROM {_ENTRIES_SQL}) SELECT case_id, rank, finding_id, entry, occurred_at, shown FROM r WHERE rank <= 4")
def timeline_preview(spark, d):
    newest = ledger.timeline_preview(ledger.timeline(dated(spark, d)), ["case_id"], "observed_at", "finding_id")
    return _shown(newest.withColumn("attributes", ledger.shown(F.col("data")))).select("case_id", "rank", "finding_id", "entry", "occurred_at", "shown")
