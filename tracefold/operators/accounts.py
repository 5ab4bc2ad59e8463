"""Accounts of runs and reports: a row for each run that was due, counters, roll-ups of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .admin import applicable

# The class of evidence a source gives; others are fetched from an interface.
EVIDENCE_CLASSES = {"manual_search_recon": "investigator_imported"}
FETCHED = "api_fetched"
# How strongly a stored band correlates, for readers.
BAND_LABELS = {"LIKELY_MATCH": "Strong correlation", "PROBABLE_MATCH": "Moderate correlation", "POSSIBLE_MATCH": "Weak correlation", "WEAK_ASSOCIATION": "Name-level only"}
UNATTRIBUTED = "unattributed"


def run_rows(targets: DataFrame, sources: DataFrame, runs: DataFrame) -> DataFrame:
    """(target, source, status, findings, error): a row for each target and each source that takes
    its type, run or not. `targets`: (target, type), `sources`: (source, types), `runs`: (target,
    source, findings, error, timed_out). Without a run it was skipped; an error beside findings is a
    partial run, alone a failed one. Of several runs of one pair the counts add up."""
    due = applicable(targets, sources, exclude=[]).select("target", "source")
    done = runs.groupBy("target", "source").agg(F.sum("findings").alias("findings"), F.max("error").alias("error"), F.bool_or("timed_out").alias("timed_out"), F.lit(True).alias("ran"))
    both = due.join(done, ["target", "source"], "left")
    status = F.when(F.col("ran").isNull(), "SKIPPED").when(F.col("timed_out"), "TIMEOUT").when(F.col("error").isNull(), "SUCCESS").when(F.col("findings") > 0, "PARTIAL").otherwise("FAILED")
    return both.select("target", "source", status.alias("status"), F.coalesce("findings", F.lit(0)).alias("findings"), "error")


def execution_counters(findings: DataFrame, entities: DataFrame, edges: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """(key, stored, seen, duplicate, created, updated, inferred, errors) of each execution, zeros
    included. `findings`: (key, disposition), `entities`: (key, action) as `ledger.refreshed` gives
    them, `edges`: (key, inferred), `runs`: (key, status)."""
    one = lambda rows, what: rows.select(key, what.alias("what"))
    marks = one(findings, F.col("disposition")).unionByName(one(entities, F.when(F.col("action") == "insert", "created").when(F.col("action") == "update", "updated")))
    marks = marks.unionByName(one(edges, F.when(F.col("inferred"), "inferred"))).unionByName(one(runs, F.when(F.col("status").isin("FAILED", "TIMEOUT"), "errors")))
    names = ("stored", "seen", "duplicate", "created", "updated", "inferred", "errors")
    return marks.groupBy(key).agg(*(F.count_if(F.col("what") == n).alias(n) for n in names))


def report_counts(sections: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, section, items, withheld, redacted): what each section holds and what policy took. Rows
    of a section: (key, withheld, redacted)."""
    out = None
    for name, rows in sections.items():
        n = rows.groupBy(key).agg(F.lit(name).alias("section"), F.count(F.lit(1)).alias("items"), F.count_if("withheld").alias("withheld"), F.count_if("redacted").alias("redacted"))
        out = n if out is None else out.unionByName(n)
    return out


def candidate_groups(candidates: DataFrame, children: dict[str, tuple[DataFrame, str]], case: str, key: str) -> DataFrame:
    """(case, group, kind, label, n): how many children of each kind and label (a platform, a type of
    contact) each candidate of a case has; a kind it has none of is one row with a null label and 0.
    Children whose candidate is null or unknown are the group `unattributed`, so none is lost.
    `children`: kind -> (rows (case, key, label...), label column). Members stay rows of their table."""
    known = candidates.select(case, key).distinct()
    out = None
    for kind, (rows, label) in children.items():
        counted = rows.groupBy(case, key, F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
        own = known.join(counted.filter(F.col(key).isNotNull()), [case, key], "left").select(case, F.col(key).cast("string").alias("group"), F.lit(kind).alias("kind"), "label", F.coalesce("n", F.lit(0)).alias("n"))
        loose = counted.join(known, [case, key], "left_anti").groupBy(case, "label").agg(F.sum("n").alias("n"))
        both = own.unionByName(loose.select(case, F.lit(UNATTRIBUTED).alias("group"), F.lit(kind).alias("kind"), "label", "n"))
        out = both if out is None else out.unionByName(both)
    return out


def candidate_order(anchors: Column, score: Column) -> list[Column]:
    """Candidates by what they share with the anchors, then by score."""
    return [F.desc(F.size(anchors)), F.desc(score)]


def most_recent(rows: DataFrame, at: str, seq: str, most: int) -> DataFrame:
    """The last `most` rows: the feed's limit."""
    return rows.orderBy(F.desc(at), F.desc(seq)).limit(most)


def is_subject(data: Column) -> Column:
    """Whether a decision is about the subject itself, not about a candidate."""
    return F.coalesce(data["role"] == "subject", F.lit(False))


def evidence_class(source: Column) -> Column:
    ladder = F.lit(FETCHED)
    for name, kind in EVIDENCE_CLASSES.items():
        ladder = F.when(F.trim(source) == name, kind).otherwise(ladder)
    return ladder


def explained(source: Column, query: Column) -> Column:
    """A sentence on how a record was found; the query is named where there is one."""
    name = F.coalesce(F.nullif(F.trim(source), F.lit("")), F.lit("unknown"))
    asked = F.when(query.isNotNull() & (query != ""), F.concat(F.lit(" for the query '"), query, F.lit("'"))).otherwise("")
    return F.when(name == "manual_search_recon", F.concat(F.lit("Imported by hand from a public search"), asked, F.lit("."))).otherwise(F.concat(F.lit("Returned by "), name, asked, F.lit(".")))


def band_label(band: Column) -> Column:
    """What readers see of a stored band; an unknown one in words."""
    out = F.initcap(F.replace(F.lower(band), F.lit("_"), F.lit(" ")))
    for name, label in BAND_LABELS.items():
        out = F.when(band == name, label).otherwise(out)
    return out
