"""Records of bibliographic and code-host registries in one schema, and answers of search models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .payloads import quarantine, register_normalizer

#: Source of a statement by the item or host it refers to. Fixed values.
IMPORTED_FROM = {"Q5188229": "crossref", "Q51044": "orcid", "Q364": "github", "orcid.org": "orcid", "api.crossref.org": "crossref", "github.com": "github"}
FIELDS = ["source", "name", "url", "affiliations", "identifiers"]


def _record(source: str, name: Column, url: Column, affiliations: Column, identifiers: Column) -> list[Column]:
    return [F.lit(source).alias("source"), name.alias("name"), url.alias("url"), F.array_sort(F.array_distinct(F.array_compact(affiliations))).alias("affiliations"), identifiers.alias("identifiers")]


@register_normalizer("works")
def works(payloads: DataFrame) -> DataFrame:
    """Authors of works; the one whose name was asked for is the record."""
    good, _ = quarantine(payloads, "struct<DOI:string,author:array<struct<given:string,family:string,affiliation:array<struct<name:string>>>>>")
    rows = good.select("asked", "p.DOI", F.explode("p.author").alias("a"))
    name = F.concat_ws(" ", "a.given", "a.family")
    return rows.filter(F.lower(name) == F.lower("asked")).select(*_record("crossref", name, F.concat(F.lit("https://doi.org/"), "DOI"), F.col("a.affiliation.name"), F.create_map(F.lit("doi"), F.lower("DOI"))))


@register_normalizer("authors")
def authors(payloads: DataFrame) -> DataFrame:
    good, _ = quarantine(payloads, "struct<id:string,display_name:string,orcid:string,last_known_institutions:array<struct<display_name:string,country_code:string>>>")
    p = good.select("p.*")
    ids = F.map_filter(F.create_map(F.lit("openalex"), F.element_at(F.split("id", "/"), -1), F.lit("orcid"), F.element_at(F.split("orcid", "/"), -1)), lambda _, v: v.isNotNull())
    return p.select(*_record("openalex", F.col("display_name"), F.col("id"), F.col("last_known_institutions.display_name"), ids))


@register_normalizer("items")
def items(payloads: DataFrame, labels: DataFrame) -> DataFrame:
    """Items that are humans (P31 is Q5), their employers' labels by a join to `labels` (id, label)."""
    good, _ = quarantine(payloads, "struct<id:string,label:string,instance_of:array<string>,employers:array<string>,orcid:string>")
    p = good.select("p.*").filter(F.array_contains("instance_of", "Q5"))
    named = p.select("id", F.explode_outer("employers").alias("employer")).join(labels.withColumnRenamed("id", "employer"), "employer", "left").groupBy("id").agg(F.collect_set("label").alias("affiliations"))
    ids = F.map_filter(F.create_map(F.lit("wikidata"), F.col("id"), F.lit("orcid"), F.col("orcid")), lambda _, v: v.isNotNull())
    return p.join(named, "id").select(*_record("wikidata", p["label"], F.concat(F.lit("https://www.wikidata.org/wiki/"), "id"), F.col("affiliations"), ids))


@register_normalizer("profiles")
def profiles(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Code-host profiles, and the sites that they publish themselves."""
    good, _ = quarantine(payloads, "struct<login:string,html_url:string,name:string,company:string,blog:string,created_at:string,public_repos:int>")
    p = good.select("p.*")
    site = F.when(F.trim("blog") != "", F.when(F.col("blog").contains("://"), F.trim("blog")).otherwise(F.concat(F.lit("https://"), F.trim("blog"))))
    rows = p.select(F.lower("login").alias("login"), F.col("html_url").alias("profile_url"), "name", F.regexp_replace(F.trim("company"), "^@", "").alias("company"), F.try_to_timestamp("created_at").alias("created_at"), "public_repos")
    return rows, p.select(F.lower("login").alias("login"), site.alias("url")).filter("url IS NOT NULL")


@register_normalizer("memberships")
def memberships(payloads: DataFrame) -> DataFrame:
    good, _ = quarantine(payloads, "array<struct<login:string,description:string>>")
    return good.select("login", F.explode("p").alias("o")).select("login", F.col("o.login").alias("organization"), F.col("o.description").alias("description"))


def candidates(*parts: DataFrame) -> DataFrame:
    """The records of all registries under one schema."""
    out = parts[0].select(*FIELDS)
    for part in parts[1:]:
        out = out.unionByName(part.select(*FIELDS))
    return out


def imported_from(statements: DataFrame, keys: list[str]) -> DataFrame:
    """Where each claim came from, by its references. `statements`: (keys, references array)."""
    known = F.create_map(*(F.lit(x) for kv in IMPORTED_FROM.items() for x in kv))
    host = F.regexp_replace(F.regexp_extract("r", "^[a-z]+://([^/]+)", 1), "^www\\.", "")
    rows = statements.select(*keys, F.explode_outer("references").alias("r")).withColumn("from", F.coalesce(known[F.col("r")], known[host]))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set("from")).alias("imported_from"))


def answered_queries(answers: DataFrame, planned: DataFrame) -> DataFrame:
    """Queries that a model's answer really ran, each with the longest planned variant in it.
    `answers`: (answer_id, payload: content blocks), `planned`: (answer_id, variant)."""
    good, _ = quarantine(answers, "struct<content:array<struct<type:string,id:string,tool_use_id:string,input:struct<query:string>,results:array<struct<url:string>>>>>")
    blocks = good.select("answer_id", F.explode("p.content").alias("b")).select("answer_id", "b.*")
    asked = blocks.filter("type = 'tool_use'").select("answer_id", "id", F.col("input.query").alias("query"))
    got = blocks.filter("type = 'tool_result'").select("answer_id", F.col("tool_use_id").alias("id"), F.size("results").alias("n_results"))
    both = asked.join(got, ["answer_id", "id"], "left").withColumn("outcome", F.when(F.col("n_results").isNull(), "ERROR").when(F.col("n_results") == 0, "NO_RESULTS").otherwise("OK"))
    held = both.join(planned, "answer_id").filter(F.contains(F.lower("query"), F.lower("variant")))
    best = held.groupBy("answer_id", "id").agg(F.max_by("variant", F.struct(F.length("variant"), "variant")).alias("variant"))
    return both.join(best, ["answer_id", "id"], "left").select("answer_id", "id", "query", "outcome", "variant")
