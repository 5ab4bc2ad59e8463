"""Rows of entities and edges from rows of findings and pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def entity(kind: str, value: Column, name: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("type"), value.alias("value"), F.coalesce(name, value).alias("name") if name is not None else value.alias("name"))


def edge(src_type: str, src: Column, kind: str, dst_type: str, dst: Column, rule: str) -> Column:
    return F.struct(F.lit(src_type).alias("src_type"), src.alias("src"), F.lit(kind).alias("type"), F.lit(dst_type).alias("dst_type"), dst.alias("dst"), F.lit(rule).alias("rule_key"))


#: kind of finding -> (data) -> arrays of entities and of edges. Data is a map of strings.
Extractor = Callable[[Column], tuple[Column, Column]]
EXTRACTORS: dict[str, Extractor] = {}


def extractor(kind: str) -> Callable[[Extractor], Extractor]:
    def add(f: Extractor) -> Extractor:
        EXTRACTORS[kind] = f
        return f

    return add


def _simple(kind: str, src: tuple[str, str], edge_type: str, dst: tuple[str, str], rule: str) -> None:
    @extractor(kind)
    def build(data: Column) -> tuple[Column, Column]:
        a, b = F.lower(F.trim(data[src[1]])), F.lower(F.trim(data[dst[1]]))
        return F.array(entity(src[0], a), entity(dst[0], b)), F.array(edge(src[0], a, edge_type, dst[0], b, rule))


# kind, source type and field, edge, target type and field, rule.
for _row in [
    ("DNS_ADDRESS", ("DOMAIN", "hostname"), "RESOLVES_TO", ("IP_ADDRESS", "record"), "dns_resolution"),
    ("DNS_MX", ("DOMAIN", "hostname"), "HAS_MX", ("DOMAIN", "record"), "dns_resolution"),
    ("DNS_NS", ("DOMAIN", "hostname"), "HOSTED_ON", ("DOMAIN", "record"), "shared_infrastructure"),
    ("DOMAIN_REGISTRATION", ("ORGANIZATION", "registrant"), "OWNS_DOMAIN", ("DOMAIN", "domain"), "authoritative_record"),
    ("HTTP_METADATA", ("DOMAIN", "hostname"), "LINKS_TO", ("WEBSITE", "url"), "site_links_profile"),
    ("SUBDOMAIN", ("DOMAIN", "hostname"), "SUBDOMAIN_OF", ("DOMAIN", "domain"), "certificate_covers_host"),
    ("CERTIFICATE", ("CERTIFICATE", "serial"), "ISSUED_FOR", ("DOMAIN", "hostname"), "certificate_covers_host"),
    ("ARCHIVE_SNAPSHOT", ("WEBSITE", "url"), "ARCHIVED_AS", ("DOCUMENT", "archived_url"), "archive_record"),
    ("CODE_PROFILE", ("SOCIAL_ACCOUNT", "profile_url"), "USES_USERNAME", ("USERNAME", "login"), "authoritative_record"),
    ("REPOSITORY", ("USERNAME", "owner"), "CONTRIBUTED_TO", ("REPOSITORY", "full_name"), "commit_authorship"),
    ("ORGANIZATION_MEMBERSHIP", ("USERNAME", "login"), "MEMBER_OF", ("ORGANIZATION", "organization"), "self_declared_membership"),
    ("COMMIT_ACTIVITY", ("USERNAME", "author"), "CONTRIBUTED_TO", ("REPOSITORY", "repository"), "commit_authorship"),
    ("USERNAME_PRESENCE", ("USERNAME", "handle"), "SAME_USERNAME", ("SOCIAL_ACCOUNT", "profile_url"), "same_common_username"),
    ("EMAIL", ("EMAIL", "address"), "REFERENCED_BY", ("DOMAIN", "domain"), "search_reference"),
    ("SEARCH_RESULT", ("DOMAIN", "hostname"), "LINKS_TO", ("WEBSITE", "url"), "search_reference"),
    ("CANDIDATE_RECORD", ("WEBSITE", "url"), "POSSIBLY_SAME_ENTITY", ("PERSONA", "subject"), "weak_name_similarity"),
]:
    _simple(*_row)


def _clean(value: Column) -> Column:
    return F.lower(F.trim(value))


def _also(kind: str, src: tuple[str, str], edge_type: str, dst: tuple[str, str], rule: str) -> None:
    """One more edge, and the entity at its end, of a kind that has an extractor."""
    before = EXTRACTORS[kind]

    @extractor(kind)
    def build(data: Column) -> tuple[Column, Column]:
        nodes, lines = before(data)
        a, b = _clean(data[src[1]]), _clean(data[dst[1]])
        return F.concat(nodes, F.array(entity(dst[0], b))), F.concat(lines, F.array(edge(src[0], a, edge_type, dst[0], b, rule)))


def _each(kind: str, src: tuple[str, str], edge_type: str, dst: tuple[str, str], rule: str, whole: str = "array<string>") -> None:
    """An edge, and the entity at its end, for each value of a field that holds a JSON list, or for each
    key of a JSON map; in either direction."""
    before = EXTRACTORS[kind]

    @extractor(kind)
    def build(data: Column) -> tuple[Column, Column]:
        nodes, lines = before(data)
        many, one, forth = (src, dst, False) if src[1].endswith("*") else (dst, src, True)
        listed = F.from_json(data[many[1].rstrip("*")], whole)
        values = F.coalesce(F.map_keys(listed) if whole.startswith("map") else listed, F.array().cast("array<string>"))
        values = F.array_distinct(F.transform(values, _clean))
        own = _clean(data[one[1]])
        more = F.transform(values, lambda v: edge(src[0], own if forth else v, edge_type, dst[0], v if forth else own, rule))
        return F.concat(nodes, F.transform(values, lambda v: entity(many[0], v))), F.concat(lines, more)


_also("CODE_PROFILE", ("SOCIAL_ACCOUNT", "profile_url"), "LINKS_TO", ("WEBSITE", "website"), "site_links_profile")
_also("REPOSITORY", ("REPOSITORY", "full_name"), "LINKS_TO", ("WEBSITE", "homepage"), "authoritative_record")
_also("CANDIDATE_RECORD", ("WEBSITE", "url"), "REFERENCED_BY", ("WEBSITE", "found_on"), "search_reference")
# Answers of several records, certificates of several names, pages of several profiles, all authors.
for _kind, _type, _edge, _rule in [("DNS_ADDRESS", "IP_ADDRESS", "RESOLVES_TO", "dns_resolution"), ("DNS_MX", "DOMAIN", "HAS_MX", "dns_resolution"), ("DNS_NS", "DOMAIN", "HOSTED_ON", "shared_infrastructure")]:
    _each(_kind, ("DOMAIN", "hostname"), _edge, (_type, "records*"), _rule)
_each("CERTIFICATE", ("CERTIFICATE", "serial"), "ISSUED_FOR", ("DOMAIN", "hostnames*"), "certificate_covers_host")
_each("HTTP_METADATA", ("WEBSITE", "url"), "LINKS_TO", ("SOCIAL_ACCOUNT", "profile_links*"), "site_links_profile")
_each("COMMIT_ACTIVITY", ("USERNAME", "authors*"), "CONTRIBUTED_TO", ("REPOSITORY", "repository"), "commit_authorship", "map<string,string>")


def extracted(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (case_id, finding_id, type, value, name) and edges (case_id, finding_id, src_type,
    src, type, dst_type, dst, rule_key) of findings (case_id, finding_id, kind, data map).

    A kind without an extractor makes none. Empty values make no entity, and no edge where either
    end is empty or both ends are one."""
    kind, nodes, lines = F.col("kind"), F.lit(None), F.lit(None)
    for name, build in EXTRACTORS.items():  # one expression each, so that findings are read once
        some, more = build(F.col("data"))
        nodes, lines = F.when(kind == name, some).otherwise(nodes), F.when(kind == name, more).otherwise(lines)
    entities = findings.select("case_id", "finding_id", F.inline(nodes))
    edges = findings.select("case_id", "finding_id", F.inline(lines))
    entities = entities.filter("value IS NOT NULL AND value <> ''")
    edges = edges.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> '' AND dst <> '' AND NOT (src = dst AND src_type = dst_type)")
    return entities, edges
