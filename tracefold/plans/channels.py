"""Search channels over events and pages: an event is a search, the front of the site whose
page has its id a result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import channels as ops
from .extraction import table
from .registry import query

#: Every third search was made by an earlier execution.
_EARLIER, _NOW = "event_id % 3 = 0", "event_id % 3 > 0"
_NOISE = urls.NOISE_HOSTS[0]
#: Forms in which a result may give its address; the third to fifth can't be stored.
_FORMS = ["base", "regexp_replace(base, '^https?://', '') || '#part'", "regexp_replace(base, '^https?', 'ftp')", "'http://127.0.0.1/' || page_id", f"'https://www.{_NOISE}/' || page_id", "' ' || base || '#x'"]
SEARCHES_SQL = "(SELECT 'case-' || (user_id % 3) AS case_id, strftime(ts, '%Y-%m-%d') AS run, event_id, ts, json_extract_string(props, '$.k') AS query, event_type = 'error' AS failed FROM events)"
CHANNEL_RUNS_SQL = f"(SELECT case_id, run, 'web' AS provider, min(event_id) % 7 > 0 AS configured, count(*) + min(event_id) % 3 AS planned, CASE min(event_id) % 5 WHEN 0 THEN 'budget_exhausted' WHEN 1 THEN 'rate_limited' ELSE 'ok' END AS outcome FROM {SEARCHES_SQL} GROUP BY 1, 2)"
#: What became of each result, from the form that its address was given.
JUDGED_SQL = f"""(WITH b AS (SELECT s.*, regexp_extract(url, '^https?://[^/]+/') AS base FROM {SEARCHES_SQL} s JOIN pages ON page_id = event_id WHERE NOT failed),
k AS (SELECT *, CASE (event_id // 3) % 6 WHEN 0 THEN base WHEN 5 THEN base WHEN 1 THEN 'https://' || regexp_replace(base, '^https?://', '') END AS key, CASE WHEN event_id % 4 > 0 THEN 'about ' || event_id END AS snippet FROM b),
old AS (SELECT DISTINCT case_id, key FROM k WHERE {_EARLIER} AND key IS NOT NULL), n AS (SELECT *, min(event_id) OVER (PARTITION BY case_id, key) AS first FROM k WHERE {_NOW})
SELECT n.case_id, n.run, n.event_id, n.key, n.snippet, CASE WHEN n.key IS NULL THEN 'rejected' WHEN old.key IS NOT NULL THEN 'seen' WHEN event_id = first THEN 'stored' ELSE 'duplicate' END AS disposition FROM n LEFT JOIN old ON old.case_id = n.case_id AND old.key = n.key)"""
ACCOUNTS_SQL = f"""(WITH s AS (SELECT case_id, run, count(*) FILTER (NOT failed) AS queries_run, count(DISTINCT query) FILTER (NOT failed) AS distinct_queries, count(*) FILTER (failed) AS failures FROM {SEARCHES_SQL} WHERE {_NOW} GROUP BY 1, 2),
g AS (SELECT case_id, run, count(*) AS results_seen, count(*) FILTER (disposition = 'stored') AS results_stored, count(*) FILTER (disposition IN ('duplicate', 'seen')) AS duplicates, count(*) FILTER (disposition = 'rejected') AS rejected_urls, count(*) FILTER (disposition = 'stored' AND snippet IS NULL) AS low_context_results FROM {JUDGED_SQL} GROUP BY 1, 2)
SELECT r.*, coalesce(queries_run, 0) AS queries_run, coalesce(distinct_queries, 0) AS distinct_queries, coalesce(failures, 0) AS failures, coalesce(results_seen, 0) AS results_seen, coalesce(results_stored, 0) AS results_stored, coalesce(duplicates, 0) AS duplicates, coalesce(rejected_urls, 0) AS rejected_urls, coalesce(low_context_results, 0) AS low_context_results
FROM {CHANNEL_RUNS_SQL} r LEFT JOIN s USING (case_id, run) LEFT JOIN g USING (case_id, run))"""


def searches(spark, d):
    case, run = F.concat(F.lit("case-"), F.col("user_id") % 3), F.date_format("ts", "yyyy-MM-dd")
    return table(spark, d, "events").select(case.alias("case_id"), run.alias("run"), "event_id", "ts", F.get_json_object("props", "$.k").alias("query"), (F.col("event_type") == "error").alias("failed"))


def channel_runs(spark, d):
    first = F.min("event_id")
    outcome = F.when(first % 5 == 0, "budget_exhausted").when(first % 5 == 1, "rate_limited").otherwise("ok")
    return searches(spark, d).groupBy("case_id", "run").agg(F.lit("web").alias("provider"), (first % 7 > 0).alias("configured"), (F.count(F.lit(1)) + first % 3).alias("planned"), outcome.alias("outcome"))


def judged(spark, d):
    """Results of this execution, held against those that their case had before."""
    base = F.regexp_extract("url", "^https?://[^/]+/", 0)
    found = searches(spark, d).filter("NOT failed").join(table(spark, d, "pages").select("page_id", base.alias("base")), F.col("event_id") == F.col("page_id"))
    form = F.element_at(F.array(*map(F.expr, _FORMS)), (F.floor(F.col("event_id") / 3) % 6 + 1).cast("int"))
    rows = found.select("case_id", "run", "event_id", "ts", F.col("event_id").alias("seq"), form.alias("url"), F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("about "), "event_id")).alias("snippet"))
    none = spark.createDataFrame([], "case_id string, key string")
    before = ops.judged(rows.filter(_EARLIER), none).filter("disposition = 'stored'")
    return ops.judged(rows.filter(_NOW), before)


def accounted(spark, d):
    return ops.accounts(channel_runs(spark, d), searches(spark, d).filter(_NOW), judged(spark, d))


@query("result_dispositions", f"SELECT case_id, event_id, key, disposition FROM {JUDGED_SQL}")
def result_dispositions(spark, d):
    return judged(spark, d).select("case_id", "event_id", "key", "disposition")


@query("channel_accounts", f"SELECT * FROM {ACCOUNTS_SQL}")
def channel_accounts(spark, d):
    return accounted(spark, d)


@query("channel_coverage", f"""SELECT case_id, run, CASE WHEN NOT configured THEN 'PROVIDER_NOT_CONFIGURED' WHEN queries_run = 0 AND outcome <> 'ok' THEN 'SKIPPED' WHEN queries_run = 0 AND failures > 0 THEN 'FAILED' WHEN queries_run = 0 THEN 'NOT_SEARCHED'
 WHEN results_stored > 0 THEN 'FOUND' WHEN outcome <> 'ok' THEN 'SKIPPED' ELSE 'NO_MATCH_RETURNED' END AS state, configured AND queries_run > 0 AND outcome <> 'ok' AS partial, results_stored AS findings, queries_run AS runs FROM {ACCOUNTS_SQL}""")
def channel_coverage(spark, d):
    return ops.coverage(accounted(spark, d)).select("case_id", "run", "state", "partial", F.col("results_stored").alias("findings"), F.col("queries_run").alias("runs"))


#: Payloads of records by the kind of event, and the source that each came from.
_RECORDS = {"signup": ('{"access": "reference_only"}', "orcid"), "purchase": ('{"evidence": "profile_exists_for_supplied_handle"}', "github"), "view": ("{}", "manual_search_recon"), "click": ('{"corroborated_by": ["employer", "username"]}', "github_people"), "error": ("{}", "crossref")}
_ROUTES_SQL = "(SELECT user_id, CASE event_type WHEN 'signup' THEN 'supplied_anchor' WHEN 'purchase' THEN 'handle_check' WHEN 'view' THEN 'manual_import' WHEN 'click' THEN CASE WHEN value > 60 THEN 'supplied_anchor' ELSE 'name_search' END ELSE 'api_record' END AS route FROM events)"
_RANKS_SQL = "CASE route " + " ".join(f"WHEN '{name}' THEN {k}" for k, name in enumerate(ops.ROUTES)) + " END"


@query("strongest_routes", f"WITH r AS (SELECT DISTINCT user_id, route, {_RANKS_SQL} AS rank FROM {_ROUTES_SQL}) SELECT user_id, arg_min(route, rank) AS strongest, array_to_string(list(route ORDER BY rank), ',') AS routes FROM r GROUP BY 1")
def strongest_routes(spark, d):
    kind = F.col("event_type")
    # Looked up, not branched on: the optimizer would push each test of the payload into each branch.
    told = F.when((kind == "click") & ~F.coalesce(F.col("value") > 60, F.lit(False)), "none").otherwise(kind)
    data = F.element_at(F.create_map(*(F.lit(x) for name, (payload, _) in _RECORDS.items() for x in (name, payload))), told)
    source = F.element_at(F.create_map(*(F.lit(x) for name, (_, origin) in _RECORDS.items() for x in (name, origin))), kind)
    rows = table(spark, d, "events").select("user_id", ops.route(F.try_parse_json(data), source).alias("route"))
    return ops.routes_of(rows, ["user_id"]).withColumn("routes", F.array_join("routes", ","))


@query("contact_standings", """WITH s AS (SELECT 'n' || s_nationkey AS case_id, s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'github' WHEN 1 THEN 'openalex' WHEN 2 THEN 'search' END AS source FROM supplier), c AS (SELECT *, CASE source WHEN 'github' THEN 'PUBLIC_SELF_PUBLISHED' WHEN 'openalex' THEN 'PUBLIC_PROFESSIONAL' ELSE 'UNVERIFIED_PUBLIC_REFERENCE' END AS standing FROM s)
SELECT *, CASE standing WHEN 'PUBLIC_PROFESSIONAL' THEN 1 WHEN 'PUBLIC_SELF_PUBLISHED' THEN 2 ELSE 3 END AS rank FROM c ORDER BY rank, s_suppkey""")
def contact_standings(spark, d):
    k = F.col("s_suppkey") % 4
    rows = table(spark, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("case_id"), "s_suppkey", F.when(k == 0, "github").when(k == 1, "openalex").when(k == 2, "search").alias("source"))
    return rows.withColumn("standing", ops.standing(F.col("source"))).withColumn("rank", ops.standing_rank(F.col("standing"))).orderBy("rank", "s_suppkey")
