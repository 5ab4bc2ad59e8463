"""Named confidence rules, scores with ceilings, bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rule, score, ceiling.
RULES = [
    ("verified_link", 0.95, 1.0),
    ("site_links_profile", 0.90, 1.0),
    ("profile_links_site", 0.90, 1.0),
    ("authoritative_record", 0.95, 1.0),
    ("same_username_shared_website", 0.85, 0.85),
    ("same_username_matching_bio", 0.70, 0.70),
    ("same_unique_username", 0.50, 0.60),
    ("same_common_username", 0.25, 0.40),
    ("shared_infrastructure", 0.60, 0.65),
    ("certificate_covers_host", 0.85, 1.0),
    ("dns_resolution", 0.95, 1.0),
    ("same_organization_name", 0.40, 0.55),
    ("same_person_name", 0.15, 0.30),
    ("name_variant_hyphenation", 0.14, 0.28),
    ("name_variant_initial", 0.12, 0.24),
    ("name_variant_reduced", 0.08, 0.18),
    ("name_variant_partial", 0.05, 0.12),
    ("context_profile_url_match", 0.85, 0.90),
    ("anchor_orcid_match", 0.88, 0.92),
    ("anchor_github_match", 0.80, 0.88),
    ("anchor_website_match", 0.60, 0.75),
    ("anchor_occupation_match", 0.20, 0.35),
    ("independent_corroboration", 0.55, 0.80),
    ("context_username_match", 0.65, 0.80),
    ("context_affiliation_match", 0.50, 0.70),
    ("context_location_match", 0.25, 0.45),
    ("weak_name_similarity", 0.25, 0.40),
    ("search_reference", 0.40, 0.55),
    ("self_declared_membership", 0.90, 1.0),
    ("commit_authorship", 0.85, 1.0),
    ("archive_record", 0.80, 1.0),
]
#: Least score and name of the bands, then the name below them. Fixed values.
BANDS = [(0.90, "LIKELY_MATCH"), (0.70, "PROBABLE_MATCH"), (0.50, "POSSIBLE_MATCH")]
LOWEST_BAND = "WEAK_ASSOCIATION"
MERGE_SUGGESTION = 0.95


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_key string, score double, ceiling double")


def rules_sql() -> str:
    return ", ".join(f"('{k}', {s}, {c})" for k, s, c in RULES)


def band(score: Column) -> Column:
    ladder = None
    for least, name in BANDS:
        ladder = F.when(score >= least, name) if ladder is None else ladder.when(score >= least, name)
    return ladder.otherwise(LOWEST_BAND)


def combined(score: Column, ceiling: Column) -> Column:
    """Noisy-or of the scores in a group, no less than the best and no more than the highest
    ceiling."""
    return F.least(F.greatest(1 - F.product(1 - score), F.max(score)), F.max(ceiling))


def score_groups(signals: DataFrame, keys: list[str], rules: DataFrame) -> DataFrame:
    """keys, score (4 decimals), band, rules: from `signals` (keys, rule_key). A rule counts once
    a group; unknown rules are left out. `rules` is the bounded rule table."""
    named = signals.select(*keys, "rule_key").distinct().join(F.broadcast(rules), "rule_key")
    raw = named.groupBy(*keys).agg(combined(F.col("score"), F.col("ceiling")).alias("raw"), F.array_sort(F.collect_set("rule_key")).alias("rules"))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("raw")))
    return raw.select(*keys, F.round(clamped, 4).alias("score"), band(clamped).alias("band"), "rules")
