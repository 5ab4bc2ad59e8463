"""Scopes, purges, audit tables, advisories, discovery quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parts of key names that never reach the audit log.
CREDENTIAL_PARTS = ["password", "passwd", "secret", "token", "apikey", "authorization", "cookie", "session", "credential", "privatekey"]


def in_scope(column: str, scope: list[str] | None) -> Column:
    """No scope is all rows; an empty scope is none."""
    return F.lit(True) if scope is None else F.col(column).isin(scope) if scope else F.lit(False)


def purged(tables: dict[str, DataFrame], doomed: DataFrame, active: DataFrame, key: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each table without the rows of doomed keys; keys with active jobs are refused and returned."""
    refused = doomed.select(key).distinct().join(active.select(key).distinct(), key, "left_semi")
    gone = doomed.select(key).distinct().join(refused, key, "left_anti")
    return {name: table.join(gone, key, "left_anti") for name, table in tables.items()}, refused


def adopted(cases: DataFrame, workspace: str) -> tuple[DataFrame, DataFrame]:
    """Cases without a workspace given to `workspace`, and an audit row for each of them."""
    orphan = F.col("workspace_id").isNull()
    now = cases.withColumn("workspace_id", F.coalesce("workspace_id", F.lit(workspace)))
    return now, cases.filter(orphan).select("case_id", F.lit("case.adopted").alias("event_type"), F.lit(workspace).alias("workspace_id"))


def visible_audit(audit: DataFrame, workspace: str, members: DataFrame) -> DataFrame:
    """Rows of the workspace, and rows without one whose actor is a member."""
    own = audit.filter(F.col("workspace_id") == workspace)
    free = audit.filter(F.col("workspace_id").isNull()).join(members.filter(F.col("workspace_id") == workspace).select("actor").distinct(), "actor", "left_semi")
    return own.unionByName(free.select(audit.columns))


def audit_metadata(data: Column, most: int = 20, longest: int = 500) -> tuple[Column, Column]:
    """Metadata that may be logged, and how many fields were dropped: no key like a credential, at
    most `most` keys in order, values cut at `longest`."""
    plain = lambda k: F.regexp_replace(F.lower(k), "[^a-z0-9]", "")
    bad = lambda k: plain(k).rlike("|".join(CREDENTIAL_PARTS))
    kept = F.slice(F.array_sort(F.map_entries(F.map_filter(data, lambda k, v: ~bad(k)))), 1, most)
    kept = F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"], F.substring(e["value"], 1, longest))))
    return kept, F.size(data) - F.size(kept)


def applicable(targets: DataFrame, sources: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(target, source) where the source supports the target's type. `sources`: (source, types), a
    bounded registry."""
    wanted = sources.select("source", F.explode("types").alias("type"))
    if include is not None:
        wanted = wanted.filter(F.col("source").isin(include))
    if exclude:
        wanted = wanted.filter(~F.col("source").isin(exclude))
    return targets.join(wanted, "type")


def advisories(reports: DataFrame, waived: DataFrame) -> DataFrame:
    """Advisories of reports (report JSON of either shape) with blocking, informational or waived."""
    shape = "struct<dependencies:array<struct<name:string,vulns:array<struct<id:string,severity:string>>>>,vulnerabilities:map<string,struct<name:string,severity:string>>>"
    parsed = reports.select(F.from_json("report", shape).alias("r"))
    one = parsed.select(F.explode("r.dependencies").alias("x")).select(F.col("x.name").alias("package"), F.explode("x.vulns").alias("v")).select("package", F.col("v.id").alias("advisory"), F.lower("v.severity").alias("severity"))
    two = parsed.select(F.explode("r.vulnerabilities").alias("advisory", "v")).select(F.col("v.name").alias("package"), "advisory", F.lower("v.severity").alias("severity"))
    both = one.unionByName(two).join(waived.select("advisory", F.lit(True).alias("__waived")).distinct(), "advisory", "left")
    state = F.when(F.col("__waived"), "waived").when(F.col("severity").isin("high", "critical"), "blocking").otherwise("informational")
    return both.withColumn("state", state).drop("__waived")


def discovery(found: DataFrame, known: DataFrame, decoys: DataFrame, keys: list[str]) -> DataFrame:
    """Recall of known keys, share of useful rows, decoys hit, duplicates, all in one row a group.
    `found`: (keys, url_key, useful, seen)."""
    hit = found.select(*keys, "url_key").distinct()
    recall = known.join(hit.withColumn("__hit", F.lit(1)), [*keys, "url_key"], "left").groupBy(*keys).agg(F.count(F.lit(1)).alias("known"), F.count("__hit").alias("found"))
    false = decoys.join(hit, [*keys, "url_key"], "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("false_hits"))
    rows = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count_if("useful").alias("useful"), F.count_distinct("url_key").alias("distinct"))
    out = recall.join(false, keys, "left").join(rows, keys, "left").fillna(0, ["false_hits", "rows", "useful", "distinct"])
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 3)
    return out.select(*keys, share("found", "known").alias("recall"), share("useful", "rows").alias("useful_share"), "false_hits", F.round(1 - F.coalesce(F.try_divide("distinct", "rows"), F.lit(1.0)), 3).alias("duplicate_rate"), (F.col("false_hits") == 0).alias("clean"))
