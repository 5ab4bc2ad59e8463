"""Findings, evidence and their accounting; every key begins with the case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import privacy

KEY = ["case_id", "kind", "dedupe_key"]
EVIDENCE_CAP = 2 << 20


DECODED_CAP = 128 * 1024


def decoded(coded: Column, cap: int = DECODED_CAP) -> Column:
    """The text of base64 up to `cap` bytes, cut between characters; empty for what isn't base64."""
    data = F.try_to_binary(coded, F.lit("base64"))
    continues = lambda k: F.conv(F.hex(F.substring(data, k, 1)), 16, 10).cast("int").bitwiseAND(0xC0) == 0x80
    end = F.when(~continues(cap + 1), cap).when(~continues(cap), cap - 1).when(~continues(cap - 1), cap - 2).otherwise(cap - 3)
    kept = F.when(F.octet_length(data) <= cap, data).otherwise(F.substring(data, F.lit(1), end))
    return F.coalesce(F.decode(kept, "utf-8"), F.lit(""))


def stable_key(given: Column, payload: Column) -> Column:
    """The given key up to 128 characters, else the SHA-256 of the payload's canonical text."""
    return F.when(given.isNotNull() & (given != "") & (F.length(given) <= 128), given).otherwise(F.sha2(payload, 256))


def canonical_map(data: Column) -> Column:
    """A map of strings as text with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(data))))


def dispositions(incoming: DataFrame, stored: DataFrame, seq: str) -> DataFrame:
    """`incoming` with `disposition`: `stored` for the first row of a new key, `duplicate` for a
    later row of the batch, `seen` where the key is stored already."""
    first = incoming.groupBy(*KEY).agg(F.min(seq).alias("__first"))
    known = stored.select(*KEY).distinct().withColumn("__known", F.lit(True))
    marked = incoming.join(first, KEY).join(known, KEY, "left")
    what = F.when(F.col("__known"), "seen").when(F.col(seq) == F.col("__first"), "stored").otherwise("duplicate")
    return marked.withColumn("disposition", what).drop("__first", "__known")


def accounting(marked: DataFrame, keys: list[str]) -> DataFrame:
    names = ("stored", "duplicate", "seen")
    return marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("disposition") == x).alias(x) for x in names))


def _hashed(artefacts: DataFrame, cap: int) -> DataFrame:
    clean = F.substring(privacy.redact_secrets(F.col("content")), 1, cap)
    rows = artefacts.select("case_id", "finding_id", clean.alias("content"), (clean != F.col("content")).alias("redacted"))
    return rows.withColumn("sha256", F.sha2("content", 256))


def evidence_links(artefacts: DataFrame, cap: int = EVIDENCE_CAP) -> DataFrame:
    """(case_id, sha256, finding_id): which findings a piece of evidence supports, a row each."""
    return _hashed(artefacts, cap).select("case_id", "sha256", "finding_id").distinct()


def store_evidence(artefacts: DataFrame, cap: int = EVIDENCE_CAP) -> DataFrame:
    """One row for each case and content: secrets out, cut at `cap` characters, hashed.
    `artefacts`: (case_id, finding_id, content). The findings it supports are `evidence_links`."""
    rows = _hashed(artefacts, cap)
    kept = rows.groupBy("case_id", "sha256").agg(F.min_by("content", "finding_id").alias("content"), F.bool_or("redacted").alias("redacted"), F.min("finding_id").alias("first_finding"), F.count(F.lit(1)).alias("n_artefacts"))
    return kept.withColumn("size_bytes", F.octet_length("content").cast("long")).withColumn("sha_prefix", F.substring("sha256", 1, 2))


def write_evidence(evidence: DataFrame, path: str) -> None:
    evidence.write.mode("overwrite").partitionBy("case_id", "sha_prefix").parquet(path)


def verify_evidence(index: DataFrame, stored: DataFrame) -> DataFrame:
    """Per case: rows of the index (case_id, sha256) whose stored content (case_id, sha256,
    content) is there and hashes to it."""
    both = index.join(stored.select("case_id", "sha256", F.sha2("content", 256).alias("now")), ["case_id", "sha256"], "left")
    out = both.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("now") == F.col("sha256")).alias("verified"),
        F.count_if(F.col("now").isNull()).alias("missing"),
        F.count_if(F.col("now") != F.col("sha256")).alias("mismatched"),
    )
    return out.withColumn("intact", F.col("verified") == F.col("total"))


def snapshot(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns))


def rehydrated(rows: DataFrame, column: str, schema: T.StructType, defaults: dict[str, object]) -> DataFrame:
    """`rows` with the snapshot's fields as columns, defaults where they are missing."""
    parsed = rows.withColumn("__s", F.from_json(column, schema))
    fields = [F.coalesce(F.col(f"__s.{f.name}"), F.lit(defaults.get(f.name))).alias(f.name) if f.name in defaults else F.col(f"__s.{f.name}").alias(f.name) for f in schema.fields]
    return parsed.select(*rows.columns, *fields)


def placement(score: Column, anchors: Column, decision: Column, threshold: float, anchors_supplied: bool = True) -> Column:
    """PRIMARY, LOW_CONFIDENCE or REJECTED: a decision outranks all, then anchors, then the score."""
    ladder = F.when(decision == "CONFIRMED", "PRIMARY").when(decision == "REJECTED", "REJECTED")
    if threshold <= 0:
        return ladder.otherwise("PRIMARY")
    return ladder.when(F.size(anchors) > 0, "PRIMARY").when(score > threshold, "PRIMARY").otherwise("LOW_CONFIDENCE")
