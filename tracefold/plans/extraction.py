"""Entities and edges of findings that tables stand for, merged and scored; registry records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names, privacy, scoring
from ..operators import extract, findings, ledger, merge, report
from ..sources import registry_records as records
from .findings import FINDINGS_SQL, case_findings
from .registry import query


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Orders and suppliers as findings: each row of a table stands for one payload of a kind.
KINDS_SQL = """(SELECT 'case-' || (o_custkey % 10) AS case_id, 2 * o_orderkey AS finding_id, CASE WHEN o_orderkey % 3 = 0 THEN 'DNS_ADDRESS' WHEN o_orderkey % 3 = 1 THEN 'SUBDOMAIN' ELSE 'REPOSITORY' END AS kind,
 CASE WHEN o_orderkey % 3 = 0 THEN 'DOMAIN' WHEN o_orderkey % 3 = 1 THEN 'DOMAIN' ELSE 'USERNAME' END AS st, 'h' || (o_custkey % 70) AS src, CASE WHEN o_orderkey % 3 = 0 THEN 'RESOLVES_TO' WHEN o_orderkey % 3 = 1 THEN 'SUBDOMAIN_OF' ELSE 'CONTRIBUTED_TO' END AS type,
 CASE WHEN o_orderkey % 3 = 0 THEN 'IP_ADDRESS' WHEN o_orderkey % 3 = 1 THEN 'DOMAIN' ELSE 'REPOSITORY' END AS dt, 'h' || (o_orderkey % 90) AS dst, CASE WHEN o_orderkey % 3 = 0 THEN 'dns_resolution' WHEN o_orderkey % 3 = 1 THEN 'certificate_covers_host' ELSE 'commit_authorship' END AS rule_key FROM orders)"""


def kinds(spark, d):
    key = F.col("o_orderkey")
    kind = F.when(key % 3 == 0, "DNS_ADDRESS").when(key % 3 == 1, "SUBDOMAIN").otherwise("REPOSITORY")
    a, b = F.concat(F.lit(" H"), F.col("o_custkey") % 70), F.concat(F.lit("h"), key % 90)
    data = F.create_map(F.lit("hostname"), a, F.lit("owner"), a, F.lit("record"), b, F.lit("domain"), b, F.lit("full_name"), b)
    return table(spark, d, "orders").select(F.concat(F.lit("case-"), F.col("o_custkey") % 10).alias("case_id"), (key * 2).alias("finding_id"), kind.alias("kind"), data.alias("data"))


@query("extracted_entities", f"""SELECT case_id, type, value, count(*) AS mentions FROM (SELECT case_id, st AS type, src AS value FROM {KINDS_SQL} UNION ALL SELECT case_id, dt, dst FROM {KINDS_SQL}) GROUP BY 1, 2, 3""")
def extracted_entities(spark, d):
    entities, _ = extract.extracted(kinds(spark, d))
    return entities.groupBy("case_id", "type", "value").agg(F.count(F.lit(1)).alias("mentions"))


@query("extracted_edges", f"""WITH e AS (SELECT DISTINCT case_id, st AS src_type, src, type, dt AS dst_type, dst, rule_key FROM {KINDS_SQL} WHERE NOT (st = dt AND src = dst)), r(rule_key, score, ceiling) AS (VALUES {scoring.rules_sql()})
SELECT case_id, src_type, src, type, dst_type, dst, round(least(greatest(1 - product(1 - score), max(score)), max(ceiling)), 4) AS score FROM e JOIN r USING (rule_key) GROUP BY ALL""")
def extracted_edges(spark, d):
    _, edges = extract.extracted(kinds(spark, d))
    keys = ["case_id", "src_type", "src", "type", "dst_type", "dst"]
    return scoring.score_groups(edges, keys, scoring.rules_table(spark)).select(*keys, "score")


#: Each kind with its fields, and the edges that it makes: types and ends, of which `*` marks each
#: value of a list. A kind's first field is `h` and a number of the customer, the others of the order.
ALL_KINDS = {
    "DNS_ADDRESS": (["hostname", "record", "records"], [("DOMAIN", "hostname", "RESOLVES_TO", "IP_ADDRESS", "record", "dns_resolution"), ("DOMAIN", "hostname", "RESOLVES_TO", "IP_ADDRESS", "records*", "dns_resolution")]),
    "DNS_MX": (["hostname", "records"], [("DOMAIN", "hostname", "HAS_MX", "DOMAIN", "records*", "dns_resolution")]),
    "DNS_NS": (["hostname", "record"], [("DOMAIN", "hostname", "HOSTED_ON", "DOMAIN", "record", "shared_infrastructure")]),
    "DOMAIN_REGISTRATION": (["registrant", "domain"], [("ORGANIZATION", "registrant", "OWNS_DOMAIN", "DOMAIN", "domain", "authoritative_record")]),
    "HTTP_METADATA": (["hostname", "url", "profile_links"], [("DOMAIN", "hostname", "LINKS_TO", "WEBSITE", "url", "site_links_profile"), ("WEBSITE", "url", "LINKS_TO", "SOCIAL_ACCOUNT", "profile_links*", "site_links_profile")]),
    "SUBDOMAIN": (["hostname", "domain"], [("DOMAIN", "hostname", "SUBDOMAIN_OF", "DOMAIN", "domain", "certificate_covers_host")]),
    "CERTIFICATE": (["serial", "hostname", "hostnames"], [("CERTIFICATE", "serial", "ISSUED_FOR", "DOMAIN", "hostname", "certificate_covers_host"), ("CERTIFICATE", "serial", "ISSUED_FOR", "DOMAIN", "hostnames*", "certificate_covers_host")]),
    "ARCHIVE_SNAPSHOT": (["url", "archived_url"], [("WEBSITE", "url", "ARCHIVED_AS", "DOCUMENT", "archived_url", "archive_record")]),
    "CODE_PROFILE": (["profile_url", "login", "website"], [("SOCIAL_ACCOUNT", "profile_url", "USES_USERNAME", "USERNAME", "login", "authoritative_record"), ("SOCIAL_ACCOUNT", "profile_url", "LINKS_TO", "WEBSITE", "website", "site_links_profile")]),
    "REPOSITORY": (["owner", "full_name", "homepage"], [("USERNAME", "owner", "CONTRIBUTED_TO", "REPOSITORY", "full_name", "commit_authorship"), ("REPOSITORY", "full_name", "LINKS_TO", "WEBSITE", "homepage", "authoritative_record")]),
    "ORGANIZATION_MEMBERSHIP": (["login", "organization"], [("USERNAME", "login", "MEMBER_OF", "ORGANIZATION", "organization", "self_declared_membership")]),
    "COMMIT_ACTIVITY": (["author", "repository", "authors"], [("USERNAME", "author", "CONTRIBUTED_TO", "REPOSITORY", "repository", "commit_authorship"), ("USERNAME", "authors*", "CONTRIBUTED_TO", "REPOSITORY", "repository", "commit_authorship")]),
    "USERNAME_PRESENCE": (["handle", "profile_url"], [("USERNAME", "handle", "SAME_USERNAME", "SOCIAL_ACCOUNT", "profile_url", "same_common_username")]),
    "EMAIL": (["address", "domain"], [("EMAIL", "address", "REFERENCED_BY", "DOMAIN", "domain", "search_reference")]),
    "SEARCH_RESULT": (["hostname", "url"], [("DOMAIN", "hostname", "LINKS_TO", "WEBSITE", "url", "search_reference")]),
    "CANDIDATE_RECORD": (["url", "subject", "found_on"], [("WEBSITE", "url", "POSSIBLY_SAME_ENTITY", "PERSONA", "subject", "weak_name_similarity"), ("WEBSITE", "url", "REFERENCED_BY", "WEBSITE", "found_on", "search_reference")]),
}


def _end_sql(fields: list[str], field: str) -> str:
    k = fields.index(field.rstrip("*"))
    if field.endswith("*"):
        return f"unnest(['l{k}-' || (o_orderkey % 5), 'l{k}-' || (o_orderkey % 7)])"
    return "'h' || (o_custkey % 70)" if k == 0 else f"'v{k}-' || (o_orderkey % 90)"


ALL_EDGES_SQL = " UNION ALL ".join(
    f"SELECT 'case-' || (o_custkey % 10) AS case_id, '{st}' AS src_type, {_end_sql(fields, a)} AS src, '{edge}' AS type, '{dt}' AS dst_type, {_end_sql(fields, b)} AS dst, '{rule}' AS rule_key FROM orders WHERE o_orderkey % 16 = {k}"
    for k, (kind, (fields, edges)) in enumerate(ALL_KINDS.items())
    for st, a, edge, dt, b, rule in edges
)


def all_kinds(spark, d):
    """Every kind of finding, a sixteenth of the orders each."""
    key = F.col("o_orderkey")
    data = F.lit(None).cast("map<string,string>")
    for k, (kind, (fields, edges)) in enumerate(ALL_KINDS.items()):
        lists = {f.rstrip("*") for e in edges for f in (e[1], e[4]) if f.endswith("*")}
        pairs = []
        for i, field in enumerate(fields):
            a, b = (F.concat(F.lit(f"L{i}-"), (key % n).cast("string")) for n in (5, 7))
            many = F.to_json(F.map_from_arrays(F.array_distinct(F.array(a, b)), F.when(a == b, F.array(F.lit("1"))).otherwise(F.array(F.lit("1"), F.lit("2"))))) if field == "authors" else F.to_json(F.array(a, b))
            one = F.concat(F.lit(" H"), F.col("o_custkey") % 70) if i == 0 else F.concat(F.lit(f"V{i}-"), key % 90, F.lit(" "))
            pairs += [F.lit(field), many if field in lists else one]
        data = F.when(key % 16 == k, F.create_map(*pairs)).otherwise(data)
    names = F.element_at(F.array(*map(F.lit, ALL_KINDS)), (key % 16 + 1).cast("int"))
    return table(spark, d, "orders").select(F.concat(F.lit("case-"), F.col("o_custkey") % 10).alias("case_id"), key.alias("finding_id"), names.alias("kind"), data.alias("data"))


@query("all_extracted_edges", f"""WITH e AS (SELECT DISTINCT * FROM ({ALL_EDGES_SQL}) WHERE NOT (src_type = dst_type AND src = dst)), r(rule_key, score, ceiling) AS (VALUES {scoring.rules_sql()})
SELECT case_id, src_type, src, type, dst_type, dst, round(least(greatest(1 - product(1 - score), max(score)), max(ceiling)), 4) AS score FROM e JOIN r USING (rule_key) GROUP BY ALL""")
def all_extracted_edges(spark, d):
    edges = extract.extracted(all_kinds(spark, d))[1]
    keys = ["case_id", "src_type", "src", "type", "dst_type", "dst"]
    return scoring.score_groups(edges, keys, scoring.rules_table(spark)).select(*keys, "score")


@query("all_extracted_entities", f"SELECT case_id, type, value FROM (SELECT case_id, src_type AS type, src AS value FROM ({ALL_EDGES_SQL}) UNION SELECT case_id, dst_type, dst FROM ({ALL_EDGES_SQL}))")
def all_extracted_entities(spark, d):
    return extract.extracted(all_kinds(spark, d))[0].select("case_id", "type", "value").distinct()


@query("merge_entities", """SELECT n_name AS value, arg_max(c_name, (length(c_name), -c_custkey)) AS display_name, arg_min(c_mktsegment, c_custkey) AS attribute, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS aliases, count(*) AS n_findings FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def merge_entities(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.col("n_name").alias("value"), F.col("c_custkey").alias("seq"), F.col("c_name").alias("name"), F.array("c_mktsegment").alias("aliases"), F.col("c_mktsegment").alias("attribute"), F.col("c_custkey").alias("finding_id"))
    out = merge.merge_entities(rows, ["value"])
    return out.select("value", "display_name", "attribute", F.array_join("aliases", ",").alias("aliases"), "n_findings")


@query("merge_edges", "SELECT l_suppkey, l_partkey, arg_max(l_returnflag, (l_orderkey, l_linenumber)) AS attribute, count(DISTINCT l_orderkey) AS n_findings FROM lineitem GROUP BY 1, 2")
def merge_edges(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", F.struct("l_orderkey", "l_linenumber").alias("seq"), F.col("l_returnflag").alias("attribute"), F.col("l_orderkey").alias("finding_id"))
    return merge.merge_edges(rows, ["l_suppkey", "l_partkey"]).select("l_suppkey", "l_partkey", "attribute", "n_findings")


@query("entity_upsert", """WITH o AS (SELECT l_partkey, max(l_discount) AS score, list_sort(list(DISTINCT l_returnflag)) AS reasons, min(l_linestatus) AS attribute FROM lineitem WHERE l_quantity <= 25 GROUP BY 1), n AS (SELECT l_partkey, max(l_discount) AS score, list_sort(list(DISTINCT l_linestatus)) AS reasons, min(l_returnflag) AS attribute FROM lineitem WHERE l_quantity > 25 GROUP BY 1)
SELECT coalesce(o.l_partkey, n.l_partkey) AS l_partkey, greatest(o.score, n.score) AS score, array_to_string(CASE WHEN o.l_partkey IS NULL OR n.score > o.score THEN n.reasons ELSE list_concat(o.reasons, list_filter(coalesce(n.reasons, []::VARCHAR[]), lambda x: NOT list_contains(o.reasons, x))) END, ',') AS reasons, coalesce(o.attribute, n.attribute) AS attribute FROM o FULL JOIN n ON o.l_partkey = n.l_partkey""")
def entity_upsert(spark, d):
    lines = table(spark, d, "lineitem")
    part = lambda rows, reason, attribute: lines.filter(rows).groupBy("l_partkey").agg(F.max("l_discount").alias("score"), F.array_sort(F.collect_set(reason)).alias("reasons"), F.min(attribute).alias("attribute"))
    return merge.upsert(part("l_quantity <= 25", "l_returnflag", "l_linestatus"), part("l_quantity > 25", "l_linestatus", "l_returnflag"), ["l_partkey"], keep_attribute=True).withColumn("reasons", F.array_join("reasons", ","))


@query("redacted_skips", f"""SELECT source, count(*) AS n, count(*) FILTER (contains(clean, '{privacy.SECRET}')) AS redacted, count(*) FILTER (NOT contains(clean, '{privacy.SECRET}') AND length(clean) < 20) AS malformed FROM (SELECT source, regexp_replace(text, '(?i)\\btoken = "[^"]+"', '{privacy.SECRET}', 'g') AS clean FROM documents) GROUP BY 1""")
def redacted_skips(spark, d):
    clean = F.regexp_replace("text", r'(?i)\btoken = "[^"]+"', privacy.SECRET)
    rows = table(spark, d, "documents").select("source", clean.alias("clean"))
    hidden = privacy.is_redacted(F.col("clean"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(hidden).alias("redacted"), F.count_if(~hidden & (F.length("clean") < 20)).alias("malformed"))


@query("finding_evidence_bridge", "SELECT l_partkey AS entity, count(DISTINCT o_orderkey) AS findings, count(DISTINCT o_custkey) AS evidence, max(o_orderdate) AS last_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def finding_evidence_bridge(spark, d):
    bridge = table(spark, d, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("o_orderkey")).distinct()
    return bridge.join(table(spark, d, "orders"), "o_orderkey").groupBy("entity").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("o_custkey").alias("evidence"), F.max("o_orderdate").alias("last_at"))


@query("candidate_records", """WITH c AS (SELECT * FROM customer), a AS (SELECT 'crossref' AS source, c_name AS name, 'https://doi.org/10.1/' || c_custkey AS url, c_mktsegment AS affiliation, 'doi=10.1/' || c_custkey AS ids FROM c WHERE c_custkey % 3 = 0
UNION ALL SELECT 'openalex', c_name, 'https://openalex.org/A' || c_custkey, c_mktsegment, 'openalex=A' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN ',orcid=0000-' || c_custkey ELSE '' END FROM c WHERE c_custkey % 3 = 1
UNION ALL SELECT 'wikidata', c_name, 'https://www.wikidata.org/wiki/Q' || c_custkey, n_name, 'wikidata=Q' || c_custkey FROM c JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 6 = 2) SELECT * FROM a""")
def candidate_records(spark, d):
    c, key = table(spark, d, "customer"), F.col("c_custkey")
    other = F.struct(F.lit("Someone").alias("given"), F.lit("Else").alias("family"), F.array(F.struct(F.lit("X").alias("name"))).alias("affiliation"))
    own = F.struct(F.lit(None).cast("string").alias("given"), F.col("c_name").alias("family"), F.array(F.struct(F.col("c_mktsegment").alias("name"))).alias("affiliation"))
    works = records.works(c.filter(key % 3 == 0).select(F.upper("c_name").alias("asked"), F.to_json(F.struct(F.concat(F.lit("10.1/"), key).alias("DOI"), F.array(other, own).alias("author"))).alias("payload")))
    orcid = F.when(key % 2 == 0, F.concat(F.lit("https://orcid.org/0000-"), key))
    authors = records.authors(c.filter(key % 3 == 1).select(F.to_json(F.struct(F.concat(F.lit("https://openalex.org/A"), key).alias("id"), F.col("c_name").alias("display_name"), orcid.alias("orcid"), F.array(F.struct(F.col("c_mktsegment").alias("display_name"), F.lit("no").alias("country_code"))).alias("last_known_institutions"))).alias("payload")))
    human = F.when(key % 6 == 2, "Q5").otherwise("Q43229")
    items = records.items(c.filter(key % 3 == 2).select(F.to_json(F.struct(F.concat(F.lit("Q"), key).alias("id"), F.col("c_name").alias("label"), F.array(human).alias("instance_of"), F.array(F.concat(F.lit("N"), "c_nationkey")).alias("employers"))).alias("payload")), table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.col("n_name").alias("label")))
    out = records.candidates(works, authors, items)
    ids = F.array_join(F.transform(F.array_sort(F.map_entries("identifiers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return out.select("source", "name", "url", F.array_join("affiliations", ",").alias("affiliation"), ids.alias("ids"))


@query("claim_provenance", """SELECT o_custkey, array_to_string(list_sort(list(DISTINCT CASE o_orderkey % 4 WHEN 0 THEN 'crossref' WHEN 1 THEN 'orcid' WHEN 2 THEN 'github' END) FILTER (o_orderkey % 4 < 3)), ',') AS imported_from FROM orders GROUP BY 1""")
def claim_provenance(spark, d):
    key = F.col("o_orderkey") % 4
    reference = F.when(key == 0, "Q5188229").when(key == 1, "https://orcid.org/0").when(key == 2, "https://www.github.com/x").otherwise("https://other.example/")
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(reference).alias("references"))
    return records.imported_from(rows, ["o_custkey"]).select("o_custkey", F.nullif(F.array_join("imported_from", ","), F.lit("")).alias("imported_from"))


@query("code_profiles", "SELECT lower(replace(s_name, '#', '-')) AS login, 'https://s' || s_suppkey || '.example' AS url FROM supplier WHERE s_suppkey % 3 > 0")
def code_profiles(spark, d):
    key = F.col("s_suppkey")
    blog = F.when(key % 3 == 0, " ").when(key % 3 == 1, F.concat(F.lit("s"), key, F.lit(".example"))).otherwise(F.concat(F.lit("https://s"), key, F.lit(".example")))
    made = table(spark, d, "supplier").select(F.to_json(F.struct(F.replace("s_name", F.lit("#"), F.lit("-")).alias("login"), blog.alias("blog"), F.lit("2020-01-01T00:00:00Z").alias("created_at"))).alias("payload"))
    return records.profiles(made)[1]


@query("memberships", "SELECT DISTINCT l_suppkey AS login, 'o' || l_partkey AS organization FROM lineitem")
def memberships(spark, d):
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    lists = lines.groupBy(F.col("l_suppkey").alias("login")).agg(F.to_json(F.collect_list(F.struct(F.concat(F.lit("o"), "l_partkey").alias("login")))).alias("payload"))
    return records.memberships(lists).select("login", "organization")


@query("answered_queries", """SELECT o_orderkey AS answer_id, 'find ' || lower(o_orderpriority) || ' now' AS query, CASE WHEN o_orderkey % 3 = 0 THEN 'ERROR' WHEN o_orderkey % 3 = 1 THEN 'NO_RESULTS' ELSE 'OK' END AS outcome, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS variant FROM orders""")
def answered_queries(spark, d):
    o, key = table(spark, d, "orders"), F.col("o_orderkey")
    block = lambda **f: F.struct(*(f.get(k, F.lit(None).cast(t)).alias(k) for k, t in (("type", "string"), ("id", "string"), ("tool_use_id", "string"), ("input", "struct<query:string>"), ("results", "array<struct<url:string>>"))))
    ask = block(type=F.lit("tool_use"), id=F.lit("t1"), input=F.struct(F.concat(F.lit("find "), F.lower("o_orderpriority"), F.lit(" now")).alias("query")))
    some = F.when(key % 3 == 2, F.array(F.struct(F.lit("http://x.example").alias("url")))).otherwise(F.array().cast("array<struct<url:string>>"))
    got = block(type=F.lit("tool_result"), tool_use_id=F.lit("t1"), results=some)
    content = F.when(key % 3 == 0, F.array(ask)).otherwise(F.array(ask, got))
    answers = o.select(key.alias("answer_id"), F.to_json(F.struct(content.alias("content"))).alias("payload"))
    planned = o.filter(key % 5 > 0).select(key.alias("answer_id"), F.explode(F.array(F.col("o_orderpriority"), F.substring("o_orderpriority", 1, 3), F.lit("nothing"))).alias("variant"))
    return records.answered_queries(answers, planned).select("answer_id", "query", "outcome", "variant")


@query("rescored_as_observed", f"""WITH f AS (SELECT case_id, user_id, rule_key, min(observed_at) AS t FROM {FINDINGS_SQL} GROUP BY 1, 2, 3), r(rule_key, score, ceiling) AS (VALUES {scoring.rules_sql()}), x AS (SELECT * FROM f JOIN r USING (rule_key))
SELECT a.case_id, a.user_id, a.t AS seen_at, round(least(greatest(1 - product(1 - b.score), max(b.score)), max(b.ceiling)), 4) AS score FROM x a JOIN x b ON a.case_id = b.case_id AND a.user_id = b.user_id AND b.t <= a.t GROUP BY a.case_id, a.user_id, a.rule_key, a.t""")
def rescored_as_observed(spark, d):
    # A subject has no more first sightings than there are rules, so its frame is bounded.
    first = case_findings(spark, d).groupBy("case_id", "user_id", "rule_key").agg(F.min("observed_at").alias("seen_at")).join(F.broadcast(scoring.rules_table(spark)), "rule_key")
    so_far = Window.partitionBy("case_id", "user_id").orderBy("seen_at")
    held = first.select("case_id", "user_id", "seen_at", F.collect_list(F.struct("score", "ceiling")).over(so_far).alias("s"))
    left = F.aggregate("s", F.lit(1.0), lambda acc, x: acc * (1 - x["score"]))
    return held.select("case_id", "user_id", "seen_at", F.round(F.least(F.greatest(1 - left, F.array_max("s.score")), F.array_max("s.ceiling")), 4).alias("score"))


@query("claim_pool", "SELECT p_brand, kind, value FROM (SELECT p_brand, kind, value, row_number() OVER (PARTITION BY p_brand ORDER BY kind, seq) AS k FROM (SELECT p_brand, kind, arg_min(value, seq) AS value, min(seq) AS seq FROM (SELECT p_brand, 'a' AS kind, split_part(p_type, ' ', 1) AS value, p_partkey AS seq FROM part UNION ALL SELECT p_brand, 'b', split_part(p_name, ' ', 1), p_partkey FROM part) GROUP BY p_brand, kind, lower(value))) WHERE k <= 4")
def claim_pool(spark, d):
    part = table(spark, d, "part")
    word = lambda c: F.split_part(c, F.lit(" "), F.lit(1))
    rows = part.select("p_brand", F.lit("a").alias("kind"), word("p_type").alias("value"), F.col("p_partkey").alias("seq")).unionByName(part.select("p_brand", F.lit("b").alias("kind"), word("p_name").alias("value"), F.col("p_partkey").alias("seq")))
    pool = merge.first_by(rows.withColumn("folded", F.lower("value")), ["p_brand", "kind", "folded"], "seq", ["value", "seq"])
    return report.key_items(pool, ["p_brand"], [F.col("kind"), F.col("seq")], 4).select("p_brand", "kind", "value")


@query("stated_facts", "SELECT p_partkey, 'brand=' || replace(p_brand, '#', '') || ';type=' || p_type AS facts FROM part")
def stated_facts(spark, d):
    profile = F.concat(F.lit("# "), "p_name", F.lit("\nBrand: "), "p_brand", F.lit("\n```\nType: in a fence\n```\n* **Type**: "), "p_type", F.lit("\n> brand: "), "p_brand")
    return table(spark, d, "part").select("p_partkey", F.array_join(names.stated_facts(profile, ["brand", "type"]), ";").alias("facts"))


@query("published_address_domains", rf"""WITH a AS (SELECT doc_id, unnest(regexp_extract_all(text, '{privacy.EMAIL}')) AS mail FROM documents) SELECT split_part(mail, '@', 2) AS domain, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM a GROUP BY 1""")
def published_address_domains(spark, d):
    mails = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(privacy.EMAIL), 0)).alias("mail"))
    return mails.groupBy(F.split_part("mail", F.lit("@"), F.lit(2)).alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query("decoded_documents", """WITH c AS (SELECT doc_id, text, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE strlen(text) > 131072),
k AS (SELECT doc_id, text, string_agg(c, '' ORDER BY i) AS kept FROM (SELECT *, sum(strlen(c)) OVER (PARTITION BY doc_id, text ORDER BY i) AS n FROM c) WHERE n <= 131072 GROUP BY 1, 2)
SELECT d.doc_id, CASE WHEN d.doc_id % 9 = 0 THEN '' ELSE coalesce(kept, d.text, '') END AS text FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id AND k.text = d.text""")
def decoded_documents(spark, d):
    coded = F.when(F.col("doc_id") % 9 == 0, "*not base64*").otherwise(F.base64(F.col("text").cast("binary")))
    return table(spark, d, "documents").select("doc_id", findings.decoded(coded).alias("text"))


@query("capability_groups", "SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_type) FILTER (p_size > 40)), ',') AS large, array_to_string(list_sort(list(DISTINCT p_type) FILTER (p_retailprice > 1500)), ',') AS dear FROM part GROUP BY 1")
def capability_groups(spark, d):
    names_of = lambda flag: F.nullif(F.array_join(F.array_sort(F.collect_set(F.when(flag, F.col("p_type")))), ","), F.lit(""))
    return table(spark, d, "part").groupBy("p_brand").agg(names_of(F.col("p_size") > 40).alias("large"), names_of(F.col("p_retailprice") > 1500).alias("dear"))


@query("snapshot_evidence", "SELECT o_orderkey, count(DISTINCT l_partkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1")
def snapshot_evidence(spark, d):
    lines = table(spark, d, "lineitem")
    kept = lines.groupBy("l_orderkey").agg(F.collect_set(F.sha2(F.col("l_partkey").cast("string"), 256)).alias("evidence_sha256"))
    snapshots = table(spark, d, "orders").filter("o_orderstatus = 'F'").join(kept, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.explode("evidence_sha256").alias("sha256"))
    evidence = lines.select(F.sha2(F.col("l_partkey").cast("string"), 256).alias("sha256")).distinct()
    return snapshots.join(evidence, "sha256").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("organisation_names", rf"""SELECT trim(regexp_replace(regexp_replace(regexp_replace(lower(n), '[^a-z0-9 ]+', '', 'g'), '\b({"|".join(names.LEGAL_FORMS)})\b', '', 'g'), ' +', ' ', 'g')) AS canonical, count(*) AS n FROM (SELECT p_type || CASE p_partkey % 3 WHEN 0 THEN ' Inc.' WHEN 1 THEN ', GmbH' ELSE '' END AS n FROM part) GROUP BY 1""")
def organisation_names(spark, d):
    key = F.col("p_partkey") % 3
    named = F.concat("p_type", F.when(key == 0, " Inc.").when(key == 1, ", GmbH").otherwise(""))
    return table(spark, d, "part").groupBy(names.organisation(named).alias("canonical")).agg(F.count(F.lit(1)).alias("n"))


@query("latest_runs", "WITH l AS (SELECT o_custkey, arg_max(k, (o_orderdate, k)) AS k FROM (SELECT *, CASE WHEN o_orderkey % 5 > 0 THEN 'j' || (o_orderkey // 7) END AS k FROM orders) WHERE k IS NOT NULL GROUP BY 1) SELECT o.o_custkey, o_orderkey FROM (SELECT *, CASE WHEN o_orderkey % 5 > 0 THEN 'j' || (o_orderkey // 7) END AS k FROM orders) o LEFT JOIN l ON o.o_custkey = l.o_custkey WHERE o.k IS NOT DISTINCT FROM l.k")
def latest_runs(spark, d):
    job = F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("j"), F.floor(F.col("o_orderkey") / 7)))
    return ledger.latest_runs(table(spark, d, "orders").withColumn("job", job), "o_custkey", "job", "o_orderdate").select("o_custkey", "o_orderkey")
