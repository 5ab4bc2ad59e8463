"""Names of organisations, places and records as comparable keys."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Legal forms and connecting words that don't tell organisations apart.
LEGAL_FORMS = ["inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "gmbh", "plc", "sa", "bv", "ag", "co"]
STOP_WORDS = ["the", "of", "and", "for", "at", "in", "de", "la"]
#: How much a kind of spelling may say, as the rule it fires. Fixed values.
NAME_RULES = {"EXACT": "same_person_name", "EXTENDED": "same_person_name", "FORMATTING": "name_variant_hyphenation", "INITIALIZED": "name_variant_initial", "TOKEN_REDUCED": "name_variant_reduced", "PARTIAL": "name_variant_partial"}


@F.pandas_udf(T.StringType())
def _folded(names: pd.Series) -> pd.Series:
    return names.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def fold(name: Column, ascii_only: bool = False) -> Column:
    """Lower case without marks, punctuation as spaces, spaces collapsed. Names of plain ASCII stay
    in the JVM where `ascii_only` says that all are."""
    plain = name if ascii_only else _folded(name)
    return F.trim(F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N}]+", " "))


def organisation(name: Column) -> Column:
    """The name without punctuation and legal forms."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9 ]+", ""), rf"\b({'|'.join(LEGAL_FORMS)})\b", "")
    bare = F.trim(F.regexp_replace(bare, " +", " "))
    return F.when(bare == "", F.lower(F.trim(name))).otherwise(bare)


def organisation_key(name: Column) -> Column:
    """The distinct words of an organisation's name in order."""
    tokens = F.split(organisation(F.regexp_replace(name, r"[,;(].*$", "")), " ")
    return F.array_join(F.array_sort(F.array_distinct(F.filter(tokens, lambda t: (t != "") & ~t.isin(STOP_WORDS)))), " ")


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != ""))


def holds(observed: Column, wanted: Column) -> Column:
    """All words of `wanted`, of which there is one at least, are in `observed`."""
    return (F.size(wanted) > 0) & (F.size(F.array_except(wanted, observed)) == 0)


def relation(observed: Column, canonical: Column) -> Column:
    """How an observed spelling relates to a name, by their folded forms and word sets."""
    a, b = fold(observed, ascii_only=True), fold(canonical, ascii_only=True)
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    extra, lost = F.size(F.array_except(x, y)), F.size(F.array_except(y, x))
    initials = F.transform(y, lambda t: F.substring(t, 1, 1))
    shortened = (F.size(x) == F.size(y)) & (extra > 0) & (F.size(F.array_except(x, F.array_union(y, initials))) == 0)
    return (
        F.when(F.coalesce(a, F.lit("")) == "", "PARTIAL")
        .when(F.lower(F.trim(observed)) == F.lower(F.trim(canonical)), "EXACT")
        .when(a == b, "FORMATTING")
        .when(shortened, "INITIALIZED")
        .when((lost == 0) & (extra > 0), "EXTENDED")
        .when((extra == 0) & (lost > 0), "TOKEN_REDUCED")
        .otherwise("PARTIAL")
    )


def stated_facts(text: Column, labels: list[str], most: int = 24) -> Column:
    """`label: value` lines of Markdown outside code fences, distinct, the first `most`."""
    outside = F.filter(F.split(text, r"(?m)^[ \t]*```.*$"), lambda _, i: i % 2 == 0)
    lines = F.flatten(F.transform(outside, lambda x: F.split(x, "\n")))
    plain = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"[*_`>#]+|!\[[^\]]*\]\([^)]*\)", "")))
    pattern = rf"(?i)^({'|'.join(labels)})\s*:\s*(.+)$"
    found = F.transform(F.filter(plain, lambda p: p.rlike(pattern)), lambda p: F.concat(F.lower(F.regexp_extract(p, pattern, 1)), F.lit("="), F.trim(F.regexp_extract(p, pattern, 2))))
    return F.slice(F.array_distinct(found), 1, most)
