"""Timelines, execution ledgers, coverage: what was seen when, by which run, with what result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States of coverage, best first; kinds of timeline entries.
COVERAGE_ORDER = ["FOUND", "NO_MATCH_RETURNED", "SKIPPED", "FAILED", "NOT_SEARCHED", "MANUAL_REVIEW_AVAILABLE", "PROVIDER_NOT_CONFIGURED"]
TIMELINE_KINDS = {"DOMAIN_REGISTRATION": "domain_registration", "CERTIFICATE": "certificate", "ARCHIVE_SNAPSHOT": "archive_snapshot", "REPOSITORY": "repository_created", "COMMIT_ACTIVITY": "commit_activity", "CODE_PROFILE": "profile_created", "EXPOSURE_SUMMARY": "exposure", "SUBDOMAIN": "subdomain"}


def coverage_state(status: Column, found: Column) -> Column:
    """What one run says about its source. Absence is said only by a run that succeeded."""
    return F.when(status == "SKIPPED", "SKIPPED").when(status.isin("FAILED", "TIMEOUT"), "FAILED").when(status.isin("SUCCESS", "PARTIAL") & (found > 0), "FOUND").when(status.isin("SUCCESS", "PARTIAL"), "NO_MATCH_RETURNED").otherwise("NOT_SEARCHED")


def state_rank(state: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, COVERAGE_ORDER)), state)


def best_coverage(runs: DataFrame, keys: list[str]) -> DataFrame:
    """`runs`: (keys, status, findings). The best state of each group of runs."""
    state = coverage_state(F.col("status"), F.col("findings"))
    return runs.withColumn("state", state).groupBy(*keys).agg(F.min_by("state", state_rank(F.col("state"))).alias("state"), F.count(F.lit(1)).alias("runs"), F.sum("findings").alias("findings"))


def gaps(coverage: DataFrame, keys: list[str], source: str) -> DataFrame:
    """Sources of each state that is no answer, by name."""
    return coverage.filter(~F.col("state").isin("FOUND", "NO_MATCH_RETURNED")).groupBy(*keys, "state").agg(F.array_join(F.array_sort(F.collect_set(source)), ",").alias("sources"))


def first_and_last(rows: DataFrame, keys: list[str], at: str, job: str, seq: str) -> DataFrame:
    """When a subject was seen first and last, and by which jobs; ties by `seq`."""
    order = F.struct(at, seq)
    return rows.groupBy(*keys).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.min_by(job, order).alias("first_job"), F.max_by(job, order).alias("last_job"), F.count(F.lit(1)).alias("n"))


def touched(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """A ledger row of each job and subject: the earliest stage, whether it was new, the first known
    address."""
    return rows.groupBy(*keys).agg(F.min_by("stage", seq).alias("stage"), F.bool_or("first_seen").alias("first_seen"), F.min_by("url", F.when(F.col("url").isNotNull(), F.col(seq))).alias("url"))


def timeline(findings: DataFrame) -> DataFrame:
    """Dated findings (case_id, finding_id, kind, observed_at, ...) with the entry's kind."""
    named = F.lower("kind")
    for kind, name in TIMELINE_KINDS.items():
        named = F.when(F.col("kind") == kind, name).otherwise(named)
    return findings.filter("observed_at IS NOT NULL").withColumn("entry", named)


# Parts of a payload that an entry of the timeline shows.
SHOWN = ["hostname", "domain", "handle", "common_name", "issuer", "full_name", "repository", "timestamp", "archived_url", "login", "breach_count"]
TITLE_CAP = 300
PREVIEW = 4


def shown(data: Column) -> Column:
    """The parts of a JSON payload that a timeline shows, as a map of texts; inner documents stay JSON.
    Keys with a null keep it; what isn't an object shows nothing."""
    parts = F.from_json(data, "map<string,string>")
    return F.coalesce(F.map_filter(parts, lambda key, _: key.isin(SHOWN)), F.create_map().cast("map<string,string>"))


def timeline_entries(findings: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """`timeline` of (case_id, finding_id, kind, observed_at, title, data, ..) with titles cut at 300
    characters and `attributes`, the `shown` parts of `data`; only entries of `kinds` where given."""
    rows = timeline(findings)
    if kinds is not None:
        rows = rows.filter(F.col("entry").isin(kinds))
    return rows.withColumn("title", F.substring("title", 1, TITLE_CAP)).withColumn("attributes", shown(F.col("data"))).drop("data")


def in_order(entries: DataFrame, at: str, seq: str, newest_first: bool = False) -> DataFrame:
    return entries.orderBy(F.desc(at), F.desc(seq)) if newest_first else entries.orderBy(at, seq)


def timeline_preview(entries: DataFrame, keys: list[str], at: str, seq: str, most: int = PREVIEW) -> DataFrame:
    """The newest `most` entries of each group with their `rank`. Spark drops what ranks lower before
    it shuffles, so a group of any size costs a few rows a task."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(seq)))
    return entries.withColumn("rank", rank).filter(F.col("rank") <= most)


def timeline_summary(entries: DataFrame, keys: list[str], at: str, kind: str) -> DataFrame:
    by = entries.groupBy(*keys, kind).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("a"), F.max(at).alias("z"))
    out = by.groupBy(*keys).agg(F.sum("n").alias("count"), F.min("a").alias("first_at"), F.max("z").alias("last_at"), F.array_sort(F.collect_list(F.struct(F.col(kind).alias("kind"), "n"))).alias("kinds"))
    days = F.floor((F.unix_timestamp("last_at") - F.unix_timestamp("first_at")) / 86400)
    return out.withColumn("span_days", days)


def refreshed(stored: DataFrame, current: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """What a refresh does with each key: insert, update, keep or delete."""
    a, b = F.struct(*columns), F.struct(*columns)
    both = stored.select(*keys, a.alias("old")).join(current.select(*keys, b.alias("new")), keys, "full_outer")
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "update").otherwise("keep")
    return both.select(*keys, action.alias("action"))


def latest_runs(runs: DataFrame, key: str, job: str, created: str) -> DataFrame:
    """Runs of each case's latest job; runs without a job where it has none."""
    known = runs.filter(F.col(job).isNotNull()).groupBy(key).agg(F.max_by(job, F.struct(created, job)).alias("__job"))
    both = runs.join(known, key, "left")
    return both.filter(F.col(job).eqNullSafe(F.col("__job"))).drop("__job")


def budget(rows: DataFrame, keys: list[str], score: str, seq: str, most: int) -> DataFrame:
    """`rows` with `decision`: the best `most` of each group are selected, every other row says why
    it isn't. No row is dropped. `seq` names a row of its group; only the best rows are ranked in one
    place, and the join back is by the row."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), seq))
    best = rows.select(*keys, seq, rank.alias("__rank")).filter(F.col("__rank") <= most)
    marked = rows.join(best, [*keys, seq], "left")
    return marked.withColumn("decision", F.when(F.col("__rank").isNotNull(), "selected").otherwise("skipped_budget")).drop("__rank")


def effective_state(state: Column, available: Column) -> Column:
    return F.when((state == "QUEUED") & ~available, "WAITING_FOR_WORKER").otherwise(state)


# States of a job that never finished.
UNFINISHED = ["FAILED", "CANCELLED", "QUEUED", "RUNNING"]


def executions(jobs: DataFrame, runs: DataFrame, observed: DataFrame) -> DataFrame:
    """A row for each job of a case: its runs by outcome and what its ledger says.

    `jobs`: (case_id, job, state, created_at, flagged), where `flagged` tells that the job wrote a
    ledger; `runs`: (case_id, job, source, status); `observed`: a row (case_id, job, ..) for each
    subject that a ledger names. `ledger` is `recorded` with observations, `empty` where the job says
    that it wrote none, `incomplete` for a job that never finished, else `legacy`: older than ledgers.
    """
    s = F.col("status")
    done = runs.filter("job IS NOT NULL").groupBy("case_id", "job").agg(F.count_distinct("source").alias("attempted"), F.count_if(s.isin("SUCCESS", "PARTIAL")).alias("ok"), F.count_if(s == "SKIPPED").alias("skipped"), F.count_if(s.isin("FAILED", "TIMEOUT")).alias("failed"))
    seen = observed.groupBy("case_id", "job").agg(F.count(F.lit(1)).alias("observations"))
    out = jobs.join(done, ["case_id", "job"], "left").join(seen, ["case_id", "job"], "left").na.fill(0, ["attempted", "ok", "skipped", "failed", "observations"])
    says = F.when(F.col("observations") > 0, "recorded").when(F.coalesce("flagged", F.lit(False)), "empty").when(F.col("state").isin(UNFINISHED), "incomplete").otherwise("legacy")
    return out.withColumn("ledger", says)


def case_executions(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """(case_id, historical_runs, executions, latest, attempted, ok, skipped, failed) of each case that
    has a job or a run. Runs without a job count as one execution. The latest job's runs are told; where
    it has none, those of the newest run's job, which may be no job at all."""
    s, at = F.col("status"), F.col("started_at")
    newest = jobs.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_jobs"), F.max_by("job", F.struct("created_at", "job")).alias("latest"))
    every = runs.groupBy("case_id").agg(F.count(F.lit(1)).alias("historical_runs"), F.bool_or(F.col("job").isNull()).alias("loose"), F.max_by(F.struct("job"), F.struct(at, "job")).alias("newest_run"))
    by = runs.groupBy("case_id", "job").agg(F.count_distinct("source").alias("attempted"), F.count_if(s.isin("SUCCESS", "PARTIAL")).alias("ok"), F.count_if(s == "SKIPPED").alias("skipped"), F.count_if(s.isin("FAILED", "TIMEOUT")).alias("failed"))
    both = newest.join(every, "case_id", "full").select("case_id", F.coalesce("historical_runs", F.lit(0)).alias("historical_runs"), (F.coalesce("n_jobs", F.lit(0)) + F.coalesce("loose", F.lit(False)).cast("int")).cast("long").alias("executions"), "latest", "newest_run.job")
    ran = by.select("case_id", F.col("job").alias("latest")).filter("latest IS NOT NULL").withColumn("has_runs", F.lit(True))
    told = both.join(ran, ["case_id", "latest"], "left").withColumn("told", F.when(F.col("has_runs"), F.col("latest")).otherwise(F.col("job")))
    own = by.withColumnRenamed("job", "told").withColumnRenamed("case_id", "c")
    out = told.join(own, (F.col("case_id") == F.col("c")) & told["told"].eqNullSafe(own["told"]), "left").select("case_id", "historical_runs", "executions", told["told"].alias("latest"), "attempted", "ok", "skipped", "failed")
    return out.na.fill(0, ["attempted", "ok", "skipped", "failed"])
