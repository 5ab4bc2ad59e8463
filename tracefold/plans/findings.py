"""Findings made of events, evidence made of documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scoring
from ..operators import findings as ops
from .privacy import redact_sql
from .registry import query

#: Rule and source of each type of event; events stand for runs of collectors and their findings.
RULE = {"click": "search_reference", "view": "weak_name_similarity", "purchase": "profile_links_site", "signup": "authoritative_record", "error": "same_common_username"}
SCORE = {k: next(s for n, s, _ in scoring.RULES if n == v) for k, v in RULE.items()}
FINDINGS_SQL = f"""(SELECT event_id AS seq, 'case-' || (user_id % 20) AS case_id, user_id, event_type AS kind, json_extract_string(props, '$.k') AS k,
 event_type || ':' || json_extract_string(props, '$.k') AS dedupe_key, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in RULE.items())} END AS rule_key,
 CASE event_type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in SCORE.items())} END::DOUBLE AS confidence, ts AS observed_at, value FROM events)"""


def case_findings(spark, d):
    ladder = score = None
    for kind, rule in RULE.items():
        hit = F.col("event_type") == kind
        ladder = F.when(hit, rule) if ladder is None else ladder.when(hit, rule)
        score = F.when(hit, SCORE[kind]) if score is None else score.when(hit, SCORE[kind])
    k = F.get_json_object("props", "$.k")
    return spark.read.parquet(f"{d}/events.parquet").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("case-"), F.col("user_id") % 20).alias("case_id"), "user_id", F.col("event_type").alias("kind"), k.alias("k"),
        F.concat_ws(":", "event_type", k).alias("dedupe_key"), ladder.alias("rule_key"), score.alias("confidence"), F.col("ts").alias("observed_at"), "value",
    )


@query("findings_page", f"""SELECT seq, case_id, kind, confidence FROM {FINDINGS_SQL} WHERE kind IN ('purchase', 'signup') AND confidence >= 0.5 ORDER BY confidence DESC, observed_at DESC, seq LIMIT 50 OFFSET 10""")
def findings_page(spark, d):
    rows = case_findings(spark, d).filter(F.col("kind").isin("purchase", "signup") & (F.col("confidence") >= 0.5))
    return rows.orderBy(F.desc("confidence"), F.desc("observed_at"), "seq").offset(10).limit(50).select("seq", "case_id", "kind", "confidence")


_SPLIT = "TIMESTAMP '2024-01-15 00:00:00'"


@query("finding_dedupe", f"""
WITH f AS {FINDINGS_SQL}, old AS (SELECT DISTINCT case_id, kind, dedupe_key FROM f WHERE observed_at < {_SPLIT}),
n AS (SELECT *, min(seq) OVER (PARTITION BY case_id, kind, dedupe_key) AS first FROM f WHERE observed_at >= {_SPLIT})
SELECT n.seq, n.case_id, n.dedupe_key, CASE WHEN o.case_id IS NOT NULL THEN 'seen' WHEN n.seq = first THEN 'stored' ELSE 'duplicate' END AS disposition
FROM n LEFT JOIN old o ON n.case_id = o.case_id AND n.kind = o.kind AND n.dedupe_key = o.dedupe_key""")
def finding_dedupe(spark, d):
    rows = case_findings(spark, d)
    return ops.dispositions(rows.filter(f"observed_at >= {_SPLIT}"), rows.filter(f"observed_at < {_SPLIT}"), "seq").select("seq", "case_id", "dedupe_key", "disposition")


@query("ingest_accounting", f"""
WITH f AS {FINDINGS_SQL}, old AS (SELECT DISTINCT case_id, kind, dedupe_key FROM f WHERE observed_at < {_SPLIT}),
n AS (SELECT *, min(seq) OVER (PARTITION BY case_id, kind, dedupe_key) AS first FROM f WHERE observed_at >= {_SPLIT}),
x AS (SELECT n.case_id, CASE WHEN o.case_id IS NOT NULL THEN 'seen' WHEN n.seq = first THEN 'stored' ELSE 'duplicate' END AS w
FROM n LEFT JOIN old o ON n.case_id = o.case_id AND n.kind = o.kind AND n.dedupe_key = o.dedupe_key)
SELECT case_id, count(*) AS n, count(*) FILTER (w = 'stored') AS stored, count(*) FILTER (w = 'duplicate') AS duplicate, count(*) FILTER (w = 'seen') AS seen FROM x GROUP BY 1""")
def ingest_accounting(spark, d):
    rows = case_findings(spark, d)
    marked = ops.dispositions(rows.filter(f"observed_at >= {_SPLIT}"), rows.filter(f"observed_at < {_SPLIT}"), "seq")
    return ops.accounting(marked, ["case_id"])


def artefacts(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("source").alias("case_id"), F.col("doc_id").alias("finding_id"), F.col("text").alias("content"))


EVIDENCE_SQL = f"""(WITH r AS (SELECT source AS case_id, doc_id, text, substr({redact_sql('text')}, 1, {ops.EVIDENCE_CAP}) AS content FROM documents)
SELECT case_id, sha256(content) AS sha256, arg_min(content, doc_id) AS content, bool_or(content <> text) AS redacted, min(doc_id) AS first_finding, count(*) AS n_artefacts FROM r GROUP BY 1, 2)"""


@query("evidence_store", f"""SELECT case_id, sha256, redacted, octet_length(encode(content)) AS size_bytes, substr(sha256, 1, 2) AS sha_prefix, first_finding, n_artefacts FROM {EVIDENCE_SQL}""")
def evidence_store(spark, d):
    return ops.store_evidence(artefacts(spark, d)).select("case_id", "sha256", "redacted", "size_bytes", "sha_prefix", "first_finding", "n_artefacts")


@query("evidence_links", f"""SELECT DISTINCT source AS case_id, sha256(substr({redact_sql('text')}, 1, {ops.EVIDENCE_CAP})) AS sha256, doc_id AS finding_id FROM documents""")
def evidence_links(spark, d):
    return ops.evidence_links(artefacts(spark, d))


@query("evidence_verify", f"""
WITH e AS {EVIDENCE_SQL}, s AS (SELECT case_id, sha256, CASE WHEN n_artefacts > 1 THEN content || '!' ELSE content END AS content, octet_length(encode(content)) AS n FROM e),
j AS (SELECT e.case_id, e.sha256, sha256(s.content) AS now FROM e LEFT JOIN s ON e.case_id = s.case_id AND e.sha256 = s.sha256 AND s.n < 9000)
SELECT case_id, count(*) AS total, count(*) FILTER (now = sha256) AS verified, count(*) FILTER (now IS NULL) AS missing, count(*) FILTER (now <> sha256) AS mismatched, count(*) FILTER (now = sha256) = count(*) AS intact FROM j GROUP BY 1""")
def evidence_verify(spark, d):
    kept = ops.store_evidence(artefacts(spark, d))
    stored = kept.filter("size_bytes < 9000").withColumn("content", F.when(F.col("n_artefacts") > 1, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return ops.verify_evidence(kept.select("case_id", "sha256"), stored)


@query("noisy_or_scores", f"""
WITH f AS (SELECT DISTINCT case_id, user_id, rule_key FROM {FINDINGS_SQL}), r(rule_key, score, ceiling) AS (VALUES {scoring.rules_sql()}),
g AS (SELECT case_id, user_id, least(greatest(1 - product(1 - score), max(score)), max(ceiling)) AS raw, list_sort(list(rule_key)) AS rules FROM f JOIN r USING (rule_key) GROUP BY 1, 2)
SELECT case_id, user_id, round(raw, 4) AS score, CASE WHEN raw >= 0.9 THEN 'LIKELY_MATCH' WHEN raw >= 0.7 THEN 'PROBABLE_MATCH' WHEN raw >= 0.5 THEN 'POSSIBLE_MATCH' ELSE 'WEAK_ASSOCIATION' END AS band, array_to_string(rules, ',') AS rules FROM g""")
def noisy_or_scores(spark, d):
    scored = scoring.score_groups(case_findings(spark, d), ["case_id", "user_id"], scoring.rules_table(spark))
    return scored.withColumn("rules", F.array_join("rules", ","))


@query("placement", f"""
WITH s AS (SELECT case_id, user_id, avg(confidence) * avg(value) / 200 AS score, count(*) FILTER (kind = 'signup' AND value > 150) AS anchors FROM {FINDINGS_SQL} GROUP BY 1, 2),
p AS (SELECT CASE WHEN user_id % 11 = 0 THEN 'PRIMARY' WHEN user_id % 7 = 0 THEN 'REJECTED' WHEN anchors > 0 OR score > 0.10 THEN 'PRIMARY' ELSE 'LOW_CONFIDENCE' END AS placement, user_id FROM s)
SELECT placement, count(*) AS n, min(user_id) AS first_user FROM p GROUP BY 1""")
def placement(spark, d):
    rows = case_findings(spark, d).groupBy("case_id", "user_id").agg((F.avg("confidence") * F.avg("value") / 200).alias("score"), F.collect_set(F.when((F.col("kind") == "signup") & (F.col("value") > 150), F.lit("orcid"))).alias("anchors"))
    decision = F.when(F.col("user_id") % 11 == 0, "CONFIRMED").when(F.col("user_id") % 7 == 0, "REJECTED")
    placed = rows.withColumn("placement", ops.placement(F.col("score"), F.col("anchors"), decision, 0.10))
    return placed.groupBy("placement").agg(F.count(F.lit(1)).alias("n"), F.min("user_id").alias("first_user"))


@query("case_counters", f"""SELECT case_id, count(*) AS findings, count(DISTINCT kind) AS collectors, max(observed_at) AS last_at,
 count(*) FILTER (confidence >= 0.8) AS high, count(*) FILTER (confidence >= 0.5 AND confidence < 0.8) AS medium, count(*) FILTER (confidence < 0.5) AS low, round(avg(confidence), 6) AS mean FROM {FINDINGS_SQL} GROUP BY 1""")
def case_counters(spark, d):
    c = F.col("confidence")
    return case_findings(spark, d).groupBy("case_id").agg(
        F.count(F.lit(1)).alias("findings"), F.count_distinct("kind").alias("collectors"), F.max("observed_at").alias("last_at"),
        F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.5) & (c < 0.8)).alias("medium"), F.count_if(c < 0.5).alias("low"), F.round(F.avg("confidence"), 6).alias("mean"),
    )


@query("confidence_histogram", "SELECT c_mktsegment, count(*) FILTER (c_acctbal >= 8000) AS high, count(*) FILTER (c_acctbal >= 5000 AND c_acctbal < 8000) AS medium, count(*) FILTER (c_acctbal < 5000) AS low FROM customer GROUP BY 1")
def confidence_histogram(spark, d):
    x = F.col("c_acctbal") / 10000
    return spark.read.parquet(f"{d}/customer.parquet").groupBy("c_mktsegment").agg(F.count_if(x >= 0.8).alias("high"), F.count_if((x >= 0.5) & (x < 0.8)).alias("medium"), F.count_if(x < 0.5).alias("low"))


@query("stable_dedupe_keys", """SELECT CASE WHEN length(p_name) % 2 = 0 THEN p_name ELSE sha256('{"brand":"' || p_brand || '","name":"' || p_name || '"}') END AS key, count(*) AS n FROM part GROUP BY 1""")
def stable_dedupe_keys(spark, d):
    payload = ops.canonical_map(F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand")))
    given = F.when(F.length("p_name") % 2 == 0, F.col("p_name"))
    return spark.read.parquet(f"{d}/part.parquet").groupBy(ops.stable_key(given, payload).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("snapshot_round_trip", "SELECT c_custkey, c_name, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END, 'UNKNOWN') AS segment FROM customer")
def snapshot_round_trip(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("segment"), "c_name")
    kept = rows.select("c_custkey", ops.snapshot(["c_name", "segment"]).alias("state"))
    schema = T.StructType([T.StructField("c_name", T.StringType()), T.StructField("segment", T.StringType())])
    return ops.rehydrated(kept, "state", schema, {"segment": "UNKNOWN"}).drop("state")


@query("search_provenance", f"""SELECT case_id, user_id, count(DISTINCT (kind, k)) AS provenances, array_to_string(list_sort(list(DISTINCT dedupe_key)), ',') AS queries FROM {FINDINGS_SQL} GROUP BY 1, 2""")
def search_provenance(spark, d):
    rows = case_findings(spark, d).select("case_id", "user_id", "kind", "k", "dedupe_key").distinct()
    return rows.groupBy("case_id", "user_id").agg(F.count(F.lit(1)).alias("provenances"), F.array_join(F.array_sort(F.collect_set("dedupe_key")), ",").alias("queries"))
