"""Timelines, ledgers and coverage over events and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ledger as ops
from .findings import FINDINGS_SQL, case_findings
from .registry import query

STATUS = {"click": "SUCCESS", "view": "PARTIAL", "purchase": "SUCCESS", "signup": "SKIPPED", "error": "FAILED"}
RUNS_SQL = f"""(SELECT 'case-' || (user_id % 20) AS case_id, 'source-' || (user_id % 7) AS source, strftime(ts, '%Y-%m-%d') AS job, event_id, ts,
 CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items())} END AS status, CASE WHEN event_type IN ('click', 'view', 'purchase') AND value > 40 THEN floor(value / 40)::BIGINT ELSE 0 END AS findings FROM events)"""
STATE_SQL = "CASE WHEN status = 'SKIPPED' THEN 'SKIPPED' WHEN status IN ('FAILED', 'TIMEOUT') THEN 'FAILED' WHEN findings > 0 THEN 'FOUND' ELSE 'NO_MATCH_RETURNED' END"
RANK_SQL = "CASE state WHEN 'FOUND' THEN 1 WHEN 'NO_MATCH_RETURNED' THEN 2 WHEN 'SKIPPED' THEN 3 WHEN 'FAILED' THEN 4 ELSE 5 END"


def runs(spark, d):
    status = None
    for kind, name in STATUS.items():
        hit = F.col("event_type") == kind
        status = F.when(hit, name) if status is None else status.when(hit, name)
    found = F.when(F.col("event_type").isin("click", "view", "purchase") & (F.col("value") > 40), F.floor(F.col("value") / 40)).otherwise(0)
    return spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("case-"), F.col("user_id") % 20).alias("case_id"), F.concat(F.lit("source-"), F.col("user_id") % 7).alias("source"), F.date_format("ts", "yyyy-MM-dd").alias("job"), "event_id", "ts", status.alias("status"), found.alias("findings"))


@query("coverage_states", f"""WITH r AS (SELECT *, {STATE_SQL} AS state FROM {RUNS_SQL}) SELECT job, source, arg_min(state, {RANK_SQL}) AS state, count(*) AS runs, sum(findings)::BIGINT AS findings FROM r GROUP BY 1, 2""")
def coverage_states(spark, d):
    return ops.best_coverage(runs(spark, d), ["job", "source"])


@query("gap_summary", f"""WITH r AS (SELECT *, {STATE_SQL} AS state FROM {RUNS_SQL}), b AS (SELECT job, case_id, source, arg_min(state, {RANK_SQL}) AS state FROM r GROUP BY 1, 2, 3)
SELECT job, case_id, state, array_to_string(list_sort(list(source)), ',') AS sources FROM b WHERE state NOT IN ('FOUND', 'NO_MATCH_RETURNED') GROUP BY 1, 2, 3""")
def gap_summary(spark, d):
    covered = ops.best_coverage(runs(spark, d), ["job", "case_id", "source"])
    return ops.gaps(covered, ["job", "case_id"], "source")


@query("source_summary", f"""SELECT source, count(*) AS runs, count(*) FILTER (status IN ('SUCCESS', 'PARTIAL')) AS ok, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'SKIPPED') AS skipped, sum(findings)::BIGINT AS findings,
 arg_min(job, event_id) FILTER (findings > 0) AS attribution FROM {RUNS_SQL} GROUP BY 1""")
def source_summary(spark, d):
    s = F.col("status")
    return runs(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("runs"), F.count_if(s.isin("SUCCESS", "PARTIAL")).alias("ok"), F.count_if(s == "FAILED").alias("failed"), F.count_if(s == "SKIPPED").alias("skipped"), F.sum("findings").alias("findings"), F.min_by("job", F.when(F.col("findings") > 0, F.col("event_id"))).alias("attribution"))


@query("execution_summary", f"""WITH x AS (SELECT case_id, count(DISTINCT job) AS executions, max(job) AS latest FROM {RUNS_SQL} GROUP BY 1), l AS (SELECT r.* FROM {RUNS_SQL} r JOIN x ON r.case_id = x.case_id AND r.job = x.latest)
SELECT x.case_id, executions, latest, count(DISTINCT source) AS attempted, count(*) FILTER (status IN ('SUCCESS', 'PARTIAL')) AS ok, count(*) FILTER (status = 'SKIPPED') AS skipped, count(*) FILTER (status = 'FAILED') AS failed,
 CASE WHEN sum(findings) > 0 THEN 'recorded' ELSE 'empty' END AS ledger FROM x JOIN l ON x.case_id = l.case_id GROUP BY 1, 2, 3""")
def execution_summary(spark, d):
    rows = runs(spark, d)
    jobs = rows.groupBy("case_id").agg(F.count_distinct("job").alias("executions"))
    last, s = ops.latest_runs(rows, "case_id", "job", "job"), F.col("status")
    now = last.groupBy("case_id", F.col("job").alias("latest")).agg(F.count_distinct("source").alias("attempted"), F.count_if(s.isin("SUCCESS", "PARTIAL")).alias("ok"), F.count_if(s == "SKIPPED").alias("skipped"), F.count_if(s == "FAILED").alias("failed"), F.when(F.sum("findings") > 0, "recorded").otherwise("empty").alias("ledger"))
    return jobs.join(now, "case_id")


#: Customers as cases, days of their orders as jobs, orders as runs; every 17th order has no job.
_JOBS_SQL = """(SELECT c_nationkey AS case_id, strftime(o_orderdate, '%Y-%m') AS job, max(o_orderdate) AS created_at, CASE min(o_orderkey) % 5 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'RUNNING' ELSE 'COMPLETED' END AS state, min(o_orderkey) % 3 = 0 AS flagged FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
_JOB_RUNS_SQL = """(SELECT c_nationkey AS case_id, CASE WHEN o_orderkey % 17 > 0 THEN strftime(o_orderdate, '%Y-%m') END AS job, o_orderpriority AS source, CASE o_orderkey % 6 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'SKIPPED' WHEN 3 THEN 'FAILED' WHEN 4 THEN 'TIMEOUT' ELSE 'SUCCESS' END AS status, o_orderdate AS started_at, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE month(o_orderdate) <> 8)"""
_OUTCOMES_SQL = "count(DISTINCT source) AS attempted, count(*) FILTER (status IN ('SUCCESS', 'PARTIAL')) AS ok, count(*) FILTER (status = 'SKIPPED') AS skipped, count(*) FILTER (status IN ('FAILED', 'TIMEOUT')) AS failed"


def _placed(spark, d):
    t = lambda name: spark.read.parquet(f"{d}/{name}.parquet")
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("case_id"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice")


def case_jobs(spark, d):
    key = F.min("o_orderkey")
    state = F.when(key % 5 == 0, "FAILED").when(key % 5 == 1, "RUNNING").otherwise("COMPLETED")
    return _placed(spark, d).groupBy("case_id", F.col("month").alias("job")).agg(F.max("o_orderdate").alias("created_at"), state.alias("state"), (key % 3 == 0).alias("flagged"))


def job_runs(spark, d):
    key = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ("SUCCESS", "PARTIAL", "SKIPPED", "FAILED", "TIMEOUT", "SUCCESS"))), (key % 6 + 1).cast("int"))
    rows = _placed(spark, d).filter(F.month("o_orderdate") != 8)
    return rows.select("case_id", F.when(key % 17 > 0, F.col("month")).alias("job"), F.col("o_orderpriority").alias("source"), status.alias("status"), F.col("o_orderdate").alias("started_at"), "o_orderkey", "o_totalprice")


@query("execution_states", f"""WITH d AS (SELECT case_id, job, {_OUTCOMES_SQL} FROM {_JOB_RUNS_SQL} GROUP BY 1, 2), o AS (SELECT c_nationkey AS case_id, strftime(o_orderdate, '%Y-%m') AS job, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 350000 GROUP BY 1, 2)
SELECT j.case_id, j.job, state, coalesce(attempted, 0) AS attempted, coalesce(ok, 0) AS ok, coalesce(skipped, 0) AS skipped, coalesce(failed, 0) AS failed, coalesce(n, 0) AS observations,
 CASE WHEN n > 0 THEN 'recorded' WHEN flagged THEN 'empty' WHEN state IN ('FAILED', 'RUNNING') THEN 'incomplete' ELSE 'legacy' END AS ledger FROM {_JOBS_SQL} j LEFT JOIN d USING (case_id, job) LEFT JOIN o USING (case_id, job)""")
def execution_states(spark, d):
    observed = _placed(spark, d).filter("o_totalprice > 350000").select("case_id", F.col("month").alias("job"), "o_orderkey")
    return ops.executions(case_jobs(spark, d), job_runs(spark, d), observed).drop("created_at", "flagged")


@query("case_executions", f"""WITH j AS (SELECT case_id, count(*) AS n, arg_max(job, (created_at, job)) AS latest FROM {_JOBS_SQL} GROUP BY 1), r AS (SELECT case_id, count(*) AS historical_runs, bool_or(job IS NULL)::INT AS loose, list(job ORDER BY started_at DESC, job DESC NULLS LAST)[1] AS newest FROM {_JOB_RUNS_SQL} GROUP BY 1),
d AS (SELECT case_id, job, {_OUTCOMES_SQL} FROM {_JOB_RUNS_SQL} GROUP BY 1, 2), t AS (SELECT j.case_id, coalesce(historical_runs, 0) AS historical_runs, n + coalesce(loose, 0) AS executions, CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.case_id = j.case_id AND d.job = j.latest) THEN j.latest ELSE newest END AS latest FROM j LEFT JOIN r USING (case_id))
SELECT t.*, coalesce(attempted, 0) AS attempted, coalesce(ok, 0) AS ok, coalesce(skipped, 0) AS skipped, coalesce(failed, 0) AS failed FROM t LEFT JOIN d ON d.case_id = t.case_id AND d.job IS NOT DISTINCT FROM t.latest""")
def case_executions(spark, d):
    return ops.case_executions(case_jobs(spark, d), job_runs(spark, d))


@query("first_last_seen", """SELECT user_id, event_type, min(ts) AS first_at, max(ts) AS last_at, arg_min(strftime(ts, '%Y-%m-%d'), (ts, event_id)) AS first_job, arg_max(strftime(ts, '%Y-%m-%d'), (ts, event_id)) AS last_job, count(*) AS n FROM events GROUP BY 1, 2""")
def first_last_seen(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").withColumn("job", F.date_format("ts", "yyyy-MM-dd"))
    return ops.first_and_last(rows, ["user_id", "event_type"], "ts", "job", "event_id")


@query("ledger_touch", """WITH x AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS job, event_id, event_type AS stage, event_type = 'signup' AS first_seen, CASE WHEN value > 60 THEN 'u' || event_id END AS url FROM events)
SELECT job, user_id, arg_min(stage, event_id) AS stage, bool_or(first_seen) AS first_seen, arg_min(url, event_id) FILTER (url IS NOT NULL) AS url FROM x GROUP BY 1, 2""")
def ledger_touch(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("job"), "event_id", F.col("event_type").alias("stage"), (F.col("event_type") == "signup").alias("first_seen"), F.when(F.col("value") > 60, F.concat(F.lit("u"), "event_id")).alias("url"))
    return ops.touched(rows, ["job", "user_id"], "event_id")


@query("timeline", f"""SELECT case_id, seq AS finding_id, lower(kind) AS entry, observed_at FROM {FINDINGS_SQL} WHERE observed_at IS NOT NULL""")
def timeline(spark, d):
    return ops.timeline(case_findings(spark, d)).select("case_id", F.col("seq").alias("finding_id"), "entry", "observed_at")


@query("timeline_summary", """WITH k AS (SELECT o_custkey, o_orderstatus, count(*) AS n, min(o_orderdate) AS a, max(o_orderdate) AS z FROM orders GROUP BY 1, 2)
SELECT o_custkey, sum(n)::BIGINT AS count, min(a) AS first_at, max(z) AS last_at, floor((epoch(max(z)) - epoch(min(a))) / 86400)::BIGINT AS span_days, array_to_string(list_sort(list(o_orderstatus || '=' || n)), ',') AS kinds FROM k GROUP BY 1""")
def timeline_summary(spark, d):
    out = ops.timeline_summary(spark.read.parquet(f"{d}/orders.parquet"), ["o_custkey"], "o_orderdate", "o_orderstatus")
    return out.withColumn("kinds", F.array_join(F.transform("kinds", lambda x: F.concat(x["kind"], F.lit("="), x["n"])), ","))


@query("timeline_refresh", """WITH s AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1), c AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderkey % 4 > 0 GROUP BY 1)
SELECT coalesce(s.k, c.k) AS o_custkey, CASE WHEN s.k IS NULL THEN 'insert' WHEN c.k IS NULL THEN 'delete' WHEN s.v <> c.v THEN 'update' ELSE 'keep' END AS action FROM s FULL JOIN c ON s.k = c.k""")
def timeline_refresh(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    top = lambda rows: rows.groupBy("o_custkey").agg(F.max("o_totalprice").alias("v"))
    return ops.refreshed(top(orders.filter("o_orderkey % 3 > 0")), top(orders.filter("o_orderkey % 4 > 0")), ["o_custkey"], ["v"])


@query("first_last_n", """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS z FROM events)
SELECT user_id, min(event_id) FILTER (a = 1) AS first_event, array_to_string(list_sort(list(event_id) FILTER (z <= 5)), ',') AS last_five FROM r GROUP BY 1""")
def first_last_n(spark, d):
    # Spark keeps the first five of each sorted group while it ranks, and drops the rest there.
    events = spark.read.parquet(f"{d}/events.parquet")
    late = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    last = events.select("user_id", "event_id", late.alias("z")).filter("z <= 5").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("event_id")).cast("array<string>"), ",").alias("last_five"))
    return events.groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event")).join(last, "user_id")


@query("enrichment_budget", """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) SELECT event_id, CASE WHEN k <= 3 THEN 'selected' ELSE 'skipped_budget' END AS decision FROM r""")
def enrichment_budget(spark, d):
    return ops.budget(spark.read.parquet(f"{d}/events.parquet"), ["user_id"], "value", "event_id", 3).select("event_id", "decision")


@query("effective_job_states", """SELECT CASE WHEN o_orderstatus = 'O' AND o_orderkey % 5 > 0 THEN 'WAITING_FOR_WORKER' WHEN o_orderstatus = 'O' THEN 'QUEUED' ELSE o_orderstatus END AS state, count(*) AS n FROM orders GROUP BY 1""")
def effective_job_states(spark, d):
    state = F.when(F.col("o_orderstatus") == "O", "QUEUED").otherwise(F.col("o_orderstatus"))
    return spark.read.parquet(f"{d}/orders.parquet").groupBy(ops.effective_state(state, F.col("o_orderkey") % 5 == 0).alias("state")).agg(F.count(F.lit(1)).alias("n"))
