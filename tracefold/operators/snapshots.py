"""What a run saw, kept as it was: states of findings, evidence, entities and relationships as JSON
and back. A later run may rescore the row itself; the state of an earlier one doesn't change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The parts of a state by type of subject, and what a missing or empty part means.
# `collector` and `retrieved_at` fall back to those of the observation.
STATES = {
    "FINDING": "id string, kind string, title string, summary string, collector string, source_url string, confidence double, confidence_reasons array<string>, classification string, redacted boolean, dedupe_key string, observed_at timestamp, target_id string, data variant, evidence_sha256 array<string>",
    "EVIDENCE": "id string, collector string, source_url string, sha256 string, content_type string, size_bytes bigint, retrieved_at timestamp, redacted boolean",
    "ENTITY": "id string, type string, display_name string, canonical_value string, confidence double, confidence_reasons array<string>, attributes variant",
    "RELATIONSHIP": "id string, type string, source_entity_id string, target_entity_id string, confidence double, confidence_reasons array<string>, strength string, collector string, attributes variant",
}
DEFAULTS = {
    "FINDING": {"kind": "SEARCH_RESULT", "title": "", "classification": "PUBLIC", "dedupe_key": ""},
    "EVIDENCE": {"sha256": ""},
    "ENTITY": {"type": "PERSONA", "display_name": "", "canonical_value": ""},
    "RELATIONSHIP": {"type": "MENTIONS", "strength": "WEAK_ASSOCIATION"},
}
_NUMBERS = {"double": 0.0, "bigint": 0, "boolean": False}


def parts(subject: str) -> dict[str, str]:
    """Names and types of a subject's state, in order."""
    return dict(part.split(" ", 1) for part in STATES[subject].split(", "))


def _written(name: str, kind: str, column: Column) -> Column:
    if name == "confidence":
        return F.round(column.cast("double"), 6)
    if kind == "variant":
        return F.coalesce(column, F.parse_json(F.lit("{}")))
    if kind == "array<string>":
        listed = F.coalesce(column, F.array().cast(kind))
        return F.array_sort(listed) if name == "evidence_sha256" else listed
    # With its zone, so that a session of another zone reads the same moment.
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") if kind == "timestamp" else column.cast(kind)


def snapshots(rows: DataFrame, subject: str, keys: list[str]) -> DataFrame:
    """(keys, subject_type, subject_id, state): each row's state as JSON. Columns that `rows` lacks
    are missing in the state; what a state doesn't name isn't kept. `data` and `attributes` are
    VARIANT."""
    known = [(name, kind) for name, kind in parts(subject).items() if name in rows.columns]
    state = F.to_json(F.struct(*(_written(name, kind, F.col(name)).alias(name) for name, kind in known)))
    return rows.select(*keys, F.lit(subject).alias("subject_type"), F.col("id").cast("string").alias("subject_id"), state.alias("state"))


def rehydrated(observations: DataFrame, subject: str, keep: list[str]) -> DataFrame:
    """`observations` (subject_type, state, collector, observed_at, ..) of one type of subject: `keep`
    and the parts of the state, with defaults where they are missing. A state that isn't JSON comes
    back with defaults alone."""
    names = parts(subject)
    schema = ", ".join(f"{name} {'string' if kind == 'timestamp' else kind}" for name, kind in names.items())
    mine = observations.filter(F.col("subject_type") == subject).withColumn("__s", F.from_json("state", schema))
    defaults = DEFAULTS[subject] | {name: _NUMBERS[kind] for name, kind in names.items() if kind in _NUMBERS}

    def read(name: str, kind: str) -> Column:
        value = F.col(f"__s.{name}")
        if kind == "timestamp":
            at = F.try_to_timestamp(value)
            return F.coalesce(at, F.col("observed_at")) if name == "retrieved_at" else at
        if kind == "variant":
            return F.coalesce(value, F.parse_json(F.lit("{}")))
        if kind == "array<string>":
            return F.coalesce(value, F.array().cast(kind))
        value = F.nullif(value, F.lit("")) if kind == "string" and (name in defaults or name == "collector") else value
        if name == "collector":
            return F.coalesce(value, F.col("collector"))
        return F.coalesce(value, F.lit(defaults[name])) if name in defaults else value

    return mine.select(*keep, *(read(name, kind).alias(name) for name, kind in names.items()))
