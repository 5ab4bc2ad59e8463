"""Nested payloads leaf by leaf, within their row: what may be stored of each, which paths were
redacted, and their canonical text.

A payload is parsed once, as VARIANT, and opened level by level by column expressions: no row is
made for a leaf, nothing is shuffled, and rows that repeat a key don't meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import privacy
from ..functions.bound import bound

DEEPEST = 12
TOO_DEEP = "[TRUNCATED: structure too deep]"

_LEAVES = "array<struct<path:string,name:string,value:string>>"


def _object(e: Column) -> Column:
    return F.map_entries(F.try_variant_get(e, "$", "map<string,variant>"))


def _list(e: Column) -> Column:
    return F.try_variant_get(e, "$", "array<variant>")


def _key_path(path: Column, key: Column) -> Column:
    """The path of a key below `path`: dots, brackets and backslashes of the key are escaped and an
    empty key is `\\e`, so that no two leaves share a path."""
    safe = F.when(key == "", "\\e").otherwise(F.regexp_replace(key, r"([\\.\[\]])", r"\\$1"))
    return F.when(path == "", safe).otherwise(F.concat(path, F.lit("."), safe))


def _name(key: Column) -> Column:
    """The part of a key that rules read: behind its last dot, before a bracket."""
    return F.substring_index(F.substring_index(key, ".", -1), "[", 1)


def leaves(payload: Column) -> Column:
    """Array of (path, name, value) of the scalars of a VARIANT, such as `contact.phone[0]` with the
    name `phone`. Each value deeper than 12 levels is a marker. Empty containers have no leaves; null
    gives an empty array."""
    node = lambda path, name, value, leaf: F.struct(path.alias("path"), name.alias("name"), value.alias("value"), F.lit(leaf).alias("leaf"))
    same = lambda x: x

    def opened(end):
        def of(e: Column) -> Column:
            keys = F.transform(_object(e["value"]), lambda kv: node(_key_path(e["path"], kv["key"]), _name(kv["key"]), end(kv["value"]), False))
            items = F.transform(_list(e["value"]), lambda x, k: node(F.concat(e["path"], F.lit("["), k, F.lit("]")), e["name"], end(x), False))
            own = F.array(node(e["path"], e["name"], e["value"] if end is same else F.try_variant_get(e["value"], "$", "string"), True))
            return F.when(e["leaf"], own).otherwise(F.coalesce(keys, items, own))

        return of

    def level(nodes: Column) -> Column:
        """A level less, unless all are leaves."""
        return F.when(F.forall(nodes, lambda e: e["leaf"]), nodes).otherwise(F.flatten(F.transform(nodes, opened(same))))

    nodes = F.array(node(F.lit(""), F.lit(""), payload, False))
    for _ in range(DEEPEST):
        nodes = bound(nodes, level)
    nodes = F.flatten(F.transform(nodes, opened(lambda _: F.lit(TOO_DEEP))))
    nodes = F.transform(nodes, lambda e: F.struct(e["path"].alias("path"), e["name"].alias("name"), e["value"].alias("value")))
    return F.coalesce(F.when(payload.isNotNull(), nodes), F.array().cast(_LEAVES))


def walked(rows: DataFrame, payload: str) -> DataFrame:
    """`rows` with the JSON text `payload` replaced by `data`, its leaves as they may be stored, a map
    from path to value; `level`, the highest of any leaf, where a secret raises it to the top;
    `redacted`, the paths from which something was removed, in order.

    Text that isn't JSON, or repeats a key in one object, is one leaf with an empty path. A null
    payload has no leaves and level 0.
    """
    parsed = F.try_parse_json(payload)
    plain = F.when(F.col(payload).isNotNull(), F.array(F.struct(F.lit("").alias("path"), F.lit("").alias("name"), F.col(payload).alias("value"))))
    found = rows.withColumn("__leaves", F.coalesce(F.when(parsed.isNotNull(), leaves(parsed)), plain, F.array().cast(_LEAVES)))
    judged = F.transform("__leaves", lambda x: F.struct(x["path"].alias("path"), privacy.stored(x["name"], x["value"]).alias("kept")))
    found = found.withColumn("__judged", judged).select(*(c for c in rows.columns if c != payload), "__judged")
    level = F.coalesce(F.array_max(F.transform("__judged", lambda x: x["kept"]["level"])), F.lit(0))
    redacted = F.array_sort(F.transform(F.filter("__judged", lambda x: x["kept"]["redacted"]), lambda x: x["path"]))
    data = F.map_from_entries(F.transform("__judged", lambda x: F.struct(x["path"], x["kept"]["value"])))
    return found.withColumns({"data": data, "level": level, "redacted": redacted}).drop("__judged")


def canonical_json(text: Column) -> Column:
    """JSON text of any nesting without white space, each object's keys in order; null for what
    isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def payload_sha256(text: Column) -> Column:
    """SHA-256 of the canonical text; of the text as it stands where that isn't JSON."""
    return F.sha2(F.coalesce(canonical_json(text), text), 256)
