"""Records held against the anchors of their group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, scoring, urls

# Kinds of anchors in the order they are tried, and the rule each fires.
ANCHOR_RULES = {"profile_url": "context_profile_url_match", "orcid": "anchor_orcid_match", "github_username": "anchor_github_match", "username": "context_username_match", "website": "anchor_website_match", "affiliation": "context_affiliation_match", "occupation": "anchor_occupation_match", "location": "context_location_match"}
#: A kind that says nothing where a stronger one of the same record matched. Fixed values.
IMPLIED = {"website": ["profile_url"], "username": ["github_username"]}


def anchor_matches(observed: DataFrame, anchors: DataFrame) -> DataFrame:
    """(subject_id, record, kind, rule_key): anchors that a record states too, each kind once.

    Both sides are rows (subject_id, [record,] kind, value) with normalised values, so one equi-join
    serves all kinds; a kind implied by a stronger match is left out."""
    met = observed.join(anchors.select("subject_id", "kind", "value").distinct(), ["subject_id", "kind", "value"]).select("subject_id", "record", "kind").distinct()
    kinds = met.groupBy("subject_id", "record").agg(F.collect_set("kind").alias("kinds"))
    rows = kinds.select("subject_id", "record", "kinds", F.explode("kinds").alias("kind"))
    implied = F.lit(False)
    for weak, strong in IMPLIED.items():
        implied = implied | ((F.col("kind") == weak) & F.arrays_overlap("kinds", F.array(*map(F.lit, strong))))
    rule = F.create_map(*(F.lit(x) for kv in ANCHOR_RULES.items() for x in kv))[F.col("kind")]
    return rows.filter(~implied).select("subject_id", "record", "kind", rule.alias("rule_key")).filter("rule_key IS NOT NULL")


def conflicts(observed: DataFrame, anchors: DataFrame) -> DataFrame:
    """(subject_id, record, kind): a record states a value of a kind that has anchors, and none of
    its values is one of them. Silence is never a conflict."""
    has = anchors.select("subject_id", "kind").distinct()
    said = observed.join(has, ["subject_id", "kind"], "left_semi").filter("value IS NOT NULL AND value <> ''")
    agree = said.join(anchors.select("subject_id", "kind", "value").distinct(), ["subject_id", "kind", "value"], "left_semi")
    return said.select("subject_id", "record", "kind").distinct().join(agree.select("subject_id", "record", "kind").distinct(), ["subject_id", "record", "kind"], "left_anti")


def organisations_matched(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of organisations with one word set. `left`: (a, name), `right`: (b, name); each key
    meets as classes, so pairs are (a, key) rows joined to one row a key."""
    key = names.organisation_key(F.col("name"))
    classes = right.withColumn("key", key).filter("key <> ''").groupBy("key").agg(F.min("b").alias("b"), F.count(F.lit(1)).alias("members"))
    return left.withColumn("key", key).join(classes, "key").select("a", "b", "key", "members")


def places_matched(stated: DataFrame, places: DataFrame) -> DataFrame:
    """Pairs (a, place) where the text states all words of the place. `stated`: (a, stated),
    `places`: (place). A place is looked up by its rarest word alone, the one that the fewest places
    have; its other words are held against the text within the row, so nothing is grouped by pair and
    a word that all places share makes no rows."""
    known = places.distinct().select("place", names.words(F.col("place")).alias("needed"))
    words = known.select("place", "needed", F.explode("needed").alias("word"))
    spread = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rarest = words.join(spread, "word").groupBy("place").agg(F.min(F.struct("n", "word", "needed")).alias("r")).select("place", F.col("r.word").alias("word"), F.col("r.needed").alias("needed"))
    said = stated.select("a", names.words(F.col("stated")).alias("said")).select("a", "said", F.explode("said").alias("word"))
    return said.join(rarest, "word").filter(names.holds(F.col("said"), F.col("needed"))).select("a", "place")


def assessed(observed: DataFrame, anchors: DataFrame, name_rules: DataFrame, rules: DataFrame) -> DataFrame:
    """(subject_id, record, score, band, rules, conflicts): each record's name rule and its anchors
    combined under the rules' ceilings; conflicts are listed and change no score. `name_rules`:
    (subject_id, record, rule_key)."""
    keys = ["subject_id", "record"]
    signals = name_rules.select(*keys, "rule_key").unionByName(anchor_matches(observed, anchors).select(*keys, "rule_key"))
    against = conflicts(observed, anchors).groupBy(*keys).agg(F.array_sort(F.collect_set("kind")).alias("conflicts"))
    out = scoring.score_groups(signals, keys, rules).join(against, keys, "left")
    return out.withColumn("conflicts", F.coalesce("conflicts", F.array().cast("array<string>")))


def owners(results: DataFrame, candidates: DataFrame) -> DataFrame:
    """Results with the candidate whose page they are, by the addresses' identity. `results`: (url,
    ...), `candidates`: (candidate, page_url)."""
    key = lambda c: urls.identity_key(F.col(c))
    own = candidates.select(key("page_url").alias("url_key"), "candidate").groupBy("url_key").agg(F.min("candidate").alias("candidate"))
    return results.withColumn("url_key", key("url")).join(own, "url_key", "left")
