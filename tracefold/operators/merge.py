"""Merging rows that name one thing: first, last and longest by an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by(rows: DataFrame, keys: list[str], order: str | Column, columns: list[str], count: str | None = None) -> DataFrame:
    """The first row of each group by `order`, and how many rows the group has."""
    held = F.min_by(F.struct(*columns), order).alias("__first")
    counted = [F.count(F.lit(1)).alias(count)] if count else []
    return rows.groupBy(*keys).agg(held, *counted).select(*keys, "__first.*", *([count] if count else []))


def union_of(column: str) -> Column:
    """The distinct values of an array column over a group, in order."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(column))))


def merge_entities(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Rows (keys, seq, name, aliases array, attribute, finding_id) merged: the first attribute, the
    longest name (the first of those), all aliases, the number of findings. A thing may have any
    number of findings, so their ids stay rows: see `finding_bridge`."""
    return rows.groupBy(*keys).agg(
        F.max_by("name", F.struct(F.length("name"), -F.col(seq))).alias("display_name"),
        union_of("aliases").alias("aliases"),
        F.min_by("attribute", seq).alias("attribute"),
        F.count_distinct("finding_id").alias("n_findings"),
    )


def merge_edges(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Rows (keys, seq, attribute, finding_id) merged: the last attribute, the number of findings."""
    return rows.groupBy(*keys).agg(F.max_by("attribute", seq).alias("attribute"), F.count_distinct("finding_id").alias("n_findings"))


def finding_bridge(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, finding_id): the findings of each merged thing."""
    return rows.select(*keys, "finding_id").distinct()


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], keep_attribute: bool, most_reasons: int = 20) -> DataFrame:
    """Stored and new rows (keys, score, reasons array, attribute) as one: a better score brings its
    reasons; else reasons are joined, the stored ones first, at most `most_reasons`. Entities keep the
    stored attribute (`keep_attribute`), edges take the new one."""
    both = stored.select(*keys, F.struct("score", "reasons", "attribute").alias("old")).join(new.select(*keys, F.struct("score", "reasons", "attribute").alias("new")), keys, "full_outer")
    better = F.col("old").isNull() | (F.col("new.score") > F.col("old.score"))
    joined = F.slice(F.array_distinct(F.concat("old.reasons", F.coalesce("new.reasons", F.array().cast("array<string>")))), 1, most_reasons)
    first, second = ("old", "new") if keep_attribute else ("new", "old")
    return both.select(
        *keys,
        F.greatest("old.score", "new.score").alias("score"),
        F.when(better, F.col("new.reasons")).otherwise(joined).alias("reasons"),
        F.coalesce(F.col(f"{first}.attribute"), F.col(f"{second}.attribute")).alias("attribute"),
    )
