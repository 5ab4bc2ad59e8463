"""Sections of reports as tables: roll-ups, overlays of decisions, costs, documents of a case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ranks of outcomes, worst last.
OUTCOMES = ["OK", "NO_RESULTS", "RATE_LIMITED", "BLOCKED", "ERROR"]


def latest_decisions(events: DataFrame, keys: list[str]) -> DataFrame:
    """The last decision on each subject; a withdrawal leaves none. `events`: (keys, decided_at, seq,
    decision), where a null decision withdraws."""
    last = events.groupBy(*keys).agg(F.max_by(F.struct("decision", "decided_at"), F.struct("decided_at", "seq")).alias("d"))
    return last.select(*keys, "d.decision", "d.decided_at").filter("decision IS NOT NULL")


def overlaid(items: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Items with the decision on them; what was judged is never changed."""
    return items.join(decisions, keys, "left")


def awaiting(items: DataFrame) -> Column:
    return F.coalesce(F.col("decision") == "NEEDS_REVIEW", F.lit(True))


def basis(decision: Column, corroborated: Column) -> Column:
    return F.when(decision.isNotNull(), "decision").when(corroborated, "corroborated").otherwise("unresolved lead")


def key_items(rows: DataFrame, keys: list[str], order: list[Column], most: int = 25) -> DataFrame:
    """The first `most` rows of each group: the report's limit, by a rank that Spark prunes early."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= most)


def rolled_up(rows: DataFrame, value: str, name: str, flag: str, least: int = 1) -> DataFrame:
    """One row for each folded value: spelling, distinct names, whether any is corroborated. Values
    of fewer than `least` names are left out, so that no small group is singled out."""
    folded = rows.withColumn("__v", F.lower(F.trim(value))).filter("__v <> ''")
    per = folded.groupBy("__v").agg(F.min(value).alias(value), F.count_distinct(name).alias("names"), F.bool_or(flag).alias("corroborated"))
    return per.filter(F.col("names") >= least).drop("__v")


def claims_by_source(rows: DataFrame, value: str, source: str, seq: str) -> DataFrame:
    """Distinct (value, source) with the first address that says so."""
    return rows.groupBy(value, source).agg(F.min_by("url", seq).alias("url"), F.min(seq).alias(seq))


def costs(calls: DataFrame, keys: list[str], budget: float) -> DataFrame:
    """Searches, estimated cost (null where a call's price isn't known), tokens apart, the worst
    outcome. `calls`: (keys, searches, unit_price, tokens, outcome)."""
    rank = F.array_position(F.array(*map(F.lit, OUTCOMES)), F.col("outcome"))
    out = calls.groupBy(*keys).agg(
        F.sum("searches").alias("searches"),
        F.when(F.count_if(F.col("unit_price").isNull()) == 0, F.round(F.sum(F.col("searches") * F.col("unit_price")), 6)).alias("cost"),
        F.sum("tokens").alias("tokens"),
        F.max_by("outcome", rank).alias("worst"),
    )
    return out.withColumn("exhausted", F.coalesce(F.col("cost") >= budget, F.lit(False)))


def documents(sections: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, section, item): each row of a section as a struct in JSON, a row each, so that a case of
    any size fits. Writers partition them by case and section."""
    out = None
    for name, rows in sections.items():
        columns = [c for c in rows.columns if c != key]
        part = rows.select(key, F.lit(name).alias("section"), F.to_json(F.struct(*columns)).alias("item"))
        out = part if out is None else out.unionByName(part)
    return out


def also_seen(rows: DataFrame, keys: list[str], source: str, seq: str) -> DataFrame:
    """The first source owns a row, of equally early ones the smallest; the other ones are listed."""
    out = rows.groupBy(*keys).agg(F.min_by(source, F.struct(seq, source)).alias(source), F.collect_set(source).alias("__all"))
    return out.withColumn("also_seen_in", F.array_sort(F.array_except("__all", F.array(source)))).drop("__all")
