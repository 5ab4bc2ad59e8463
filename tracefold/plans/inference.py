"""Links inferred between accounts, and agreements between sources, over events and lines of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import infer as ops
from .findings import FINDINGS_SQL, case_findings
from .registry import query

ACCOUNTS_SQL = "(SELECT DISTINCT 'case-' || (user_id % 3) AS case_id, user_id || '@' || event_type AS key, 'User' || (user_id % 40) AS handle, event_type AS platform FROM events)"


def accounts(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("case-"), F.col("user_id") % 3).alias("case_id"), F.concat_ws("@", "user_id", "event_type").alias("key"), F.concat(F.lit("User"), F.col("user_id") % 40).alias("handle"), F.col("event_type").alias("platform")).distinct()


@query("shared_handle_groups", f"""
WITH p AS (SELECT case_id, lower(handle) AS handle, platform, count(DISTINCT key) AS n FROM {ACCOUNTS_SQL} GROUP BY 1, 2, 3)
SELECT case_id, handle, sum(n)::BIGINT AS accounts, count(*) AS platforms, ((sum(n) * sum(n) - sum(n * n)) // 2)::BIGINT AS pairs, CASE WHEN length(handle) >= 6 THEN 'same_unique_username' ELSE 'same_common_username' END AS rule_key
FROM p WHERE length(handle) >= 4 GROUP BY 1, 2 HAVING count(*) > 1""")
def shared_handle_groups(spark, d):
    return ops.handle_groups(accounts(spark, d))


@query("shared_handle_links", f"""WITH a AS (SELECT case_id, lower(handle) AS handle, key, platform FROM {ACCOUNTS_SQL} WHERE length(handle) >= 4), f AS (SELECT case_id, handle, min(key) AS first, arg_min(platform, key) AS p FROM a GROUP BY 1, 2),
o AS (SELECT case_id, handle, first, p, min(key) AS other FROM a JOIN f USING (case_id, handle) WHERE platform <> p GROUP BY ALL)
SELECT case_id, handle, CASE WHEN platform = p THEN other ELSE first END AS a, key AS b, CASE WHEN length(handle) >= 6 THEN 'same_unique_username' ELSE 'same_common_username' END AS rule_key FROM a JOIN o USING (case_id, handle) WHERE key <> first""")
def shared_handle_links(spark, d):
    return ops.handle_links(accounts(spark, d))


@query("shared_site_groups", """
WITH e AS (SELECT DISTINCT 'a' || l_suppkey AS account, 's' || l_partkey AS site FROM lineitem)
SELECT site, count(*) AS accounts, min(account) AS first_account FROM e GROUP BY 1 HAVING count(*) > 1""")
def shared_site_groups(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    account, site = F.concat(F.lit("a"), "l_suppkey"), F.concat(F.lit("s"), "l_partkey")
    odd = F.col("l_linenumber") % 2 == 1
    edges = lines.select(F.when(odd, account).otherwise(site).alias("src"), F.when(odd, site).otherwise(account).alias("dst"))
    return ops.shared_sites(edges, F.col("site").startswith("s"))


_MEMBERS_SQL = """(SELECT DISTINCT 'c' || (l_partkey % 3) AS case_id, 's' || l_partkey AS site, 'a' || l_suppkey AS account, CASE WHEN l_suppkey % 7 > 0 THEN 'h' || (l_suppkey % 4) END AS handle FROM lineitem)"""
_CLASSES_SQL = f"(SELECT case_id, site, handle, CASE WHEN handle IS NULL THEN account END AS alone, count(*) AS n, min(account) AS first FROM {_MEMBERS_SQL} GROUP BY ALL)"


def site_members(spark, d):
    """Suppliers link the parts they deliver, on odd lines from the part's side."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(F.concat(F.lit("c"), F.col("l_partkey") % 3).alias("case_id"), F.concat(F.lit("a"), "l_suppkey").alias("account"), F.concat(F.lit("s"), "l_partkey").alias("site"), (F.col("l_linenumber") % 2 == 1).alias("odd"), "l_suppkey")
    links = lines.select("case_id", F.when(F.col("odd"), F.col("account")).otherwise(F.col("site")).alias("src"), F.when(F.col("odd"), F.col("site")).otherwise(F.col("account")).alias("dst"))
    named = lines.select("case_id", "account", F.when(F.col("l_suppkey") % 7 > 0, F.concat(F.lit(" H"), F.col("l_suppkey") % 4)).alias("handle")).distinct()
    return ops.site_members(links, named)


@query("shared_site_classes", f"""SELECT case_id, site, sum(n)::BIGINT AS accounts, count(*) AS classes, ((sum(n * n) - sum(n)) // 2)::BIGINT AS same_pairs, ((sum(n) * sum(n) - sum(n * n)) // 2)::BIGINT AS other_pairs FROM {_CLASSES_SQL} GROUP BY 1, 2 HAVING sum(n) > 1""")
def shared_site_classes(spark, d):
    return ops.site_groups(site_members(spark, d))


@query("shared_site_links", f"""WITH c AS {_CLASSES_SQL}, t AS (SELECT case_id, site, min(first) AS a FROM c GROUP BY 1, 2)
SELECT case_id, site, first AS a, account AS b, 'same_username_shared_website' AS rule_key FROM {_MEMBERS_SQL} m JOIN c USING (case_id, site, handle) WHERE account <> first
UNION ALL SELECT case_id, site, a, first, 'shared_infrastructure' FROM c JOIN t USING (case_id, site) WHERE first <> a""")
def shared_site_links(spark, d):
    return ops.site_links(site_members(spark, d))


@query("unlinked_pairs", """
WITH p AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b, 'T' AS type FROM lineitem WHERE l_returnflag = 'N'), e AS (SELECT DISTINCT least(l_suppkey, l_partkey) AS x, greatest(l_suppkey, l_partkey) AS y FROM lineitem WHERE l_returnflag <> 'N')
SELECT a, b FROM p WHERE NOT EXISTS (SELECT 1 FROM e WHERE x = least(a, b) AND y = greatest(a, b))""")
def unlinked_pairs(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    pairs = lines.filter("l_returnflag = 'N'").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), F.lit("T").alias("type")).distinct()
    edges = lines.filter("l_returnflag <> 'N'").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.lit("T").alias("type"))
    return ops.not_linked(pairs, edges).select("a", "b")


#: Each type of event stands for a source that claims the identifier of its day's user.
SOURCES = {"click": "orcid", "view": "openalex", "purchase": "github", "signup": "wikidata", "error": "search"}
KINDS = ["orcid", "doi", "github_login", "wikidata", "openalex"]
CLAIMS_SQL = f"""(SELECT 'case-' || (user_id % 5) AS case_id, event_id AS record, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in SOURCES.items())} END AS source,
 CASE user_id % 5 {' '.join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS))} END AS identifier, 'v' || user_id || '-' || (day(ts) % 6) AS value, CASE WHEN value > 60 AND event_type = 'signup' THEN ['github'] ELSE []::VARCHAR[] END AS imported FROM events)"""


def claims(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    source = F.create_map(*(F.lit(x) for kv in SOURCES.items() for x in kv))[F.col("event_type")]
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("user_id") % 5 + 1).cast("int"))
    imported = F.when((F.col("value") > 60) & (F.col("event_type") == "signup"), F.array(F.lit("github"))).otherwise(F.array().cast("array<string>"))
    return events.select(F.concat(F.lit("case-"), F.col("user_id") % 5).alias("case_id"), F.col("event_id").alias("record"), source.alias("source"), kind.alias("identifier"), F.concat(F.lit("V"), "user_id", F.lit("-"), F.dayofmonth("ts") % 6).alias("value"), imported.alias("imported_from"))


@query("identifier_agreement", f"""
SELECT case_id, identifier, value, count(*) AS records, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM {CLAIMS_SQL} GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def identifier_agreement(spark, d):
    return ops.agreements(claims(spark, d)).select("case_id", "identifier", "value", "records", F.array_join("sources.source", ",").alias("sources"))


_LINES = ", ".join(f"('{s}', '{i}', {str(a).lower()}, {g}::VARCHAR[])" for s, i, a, g in ops.LINEAGE)
RULINGS_SQL = f"""
c AS (SELECT case_id, identifier, value, source, count(*) AS n, list_distinct(flatten(list(imported))) AS imp FROM {CLAIMS_SQL} GROUP BY 1, 2, 3, 4),
g AS (SELECT case_id, identifier, value, sum(n) AS records, count(*) AS kinds FROM c GROUP BY 1, 2, 3 HAVING sum(n) > 1),
l(source, identifier, auth, ingests) AS (VALUES {_LINES}),
p AS (SELECT a.case_id, a.identifier, a.value, a.source AS first, b.source AS second, a.imp AS pa, b.imp AS pb, coalesce(la.auth, false) AND coalesce(lb.auth, false) AS sure, coalesce(la.ingests, []::VARCHAR[]) AS ia, coalesce(lb.ingests, []::VARCHAR[]) AS ib
  FROM g JOIN c a USING (case_id, identifier, value) JOIN c b USING (case_id, identifier, value) LEFT JOIN l la ON la.source = a.source AND la.identifier = a.identifier LEFT JOIN l lb ON lb.source = b.source AND lb.identifier = b.identifier
  WHERE a.source < b.source OR (g.kinds = 1 AND a.source = b.source)),
r AS (SELECT case_id, identifier, value, first, second, CASE WHEN first = second OR list_contains(pa, second) OR list_contains(pb, first) OR list_contains(ib, first) OR list_contains(ia, second) OR list_has_any(ia, ib) THEN 'DEPENDENT'
  WHEN first = 'search' OR second = 'search' THEN 'UNKNOWN' WHEN sure THEN 'INDEPENDENT' ELSE 'UNKNOWN' END AS ruling FROM p)"""


@query("independence", f"WITH {RULINGS_SQL} SELECT * FROM r")
def independence(spark, d):
    return ops.rulings(ops.agreements(claims(spark, d)), ops.lineage_table(spark))


@query("best_rulings", f"""WITH {RULINGS_SQL}, k AS (SELECT *, CASE ruling WHEN 'INDEPENDENT' THEN 1 WHEN 'DEPENDENT' THEN 2 ELSE 3 END AS rank FROM r)
SELECT case_id, identifier, value, arg_min(ruling, (rank, first, second)) AS ruling, arg_min(first, (rank, first, second)) AS first, arg_min(second, (rank, first, second)) AS second FROM k GROUP BY 1, 2, 3""")
def best_rulings(spark, d):
    return ops.best_rulings(ops.rulings(ops.agreements(claims(spark, d)), ops.lineage_table(spark)))


_BEST_SQL = f"""{RULINGS_SQL}, k AS (SELECT *, CASE ruling WHEN 'INDEPENDENT' THEN 1 WHEN 'DEPENDENT' THEN 2 ELSE 3 END AS rank FROM r),
b AS (SELECT case_id, identifier, value, arg_min(ruling, (rank, first, second)) AS ruling, arg_min(first, (rank, first, second)) AS first, arg_min(second, (rank, first, second)) AS second FROM k GROUP BY 1, 2, 3)"""


@query("agreement_list", f"""WITH {_BEST_SQL} SELECT case_id, identifier, value, CASE WHEN ruling = 'INDEPENDENT' THEN 'CORROBORATED' ELSE 'SHARED' END AS status, CASE WHEN first = second THEN first ELSE first || ',' || second END AS sources FROM b""")
def agreement_list(spark, d):
    listed = ops.agreement_list(ops.best_rulings(ops.rulings(ops.agreements(claims(spark, d)), ops.lineage_table(spark))))
    return listed.withColumn("sources", F.array_join("sources", ","))


_SCORES = f"(SELECT * FROM (VALUES {scoring.rules_sql()}) AS t(rule_key, score, ceiling))"
_KEYS = [["same_person_name"], ["search_reference", "same_person_name"], ["weak_name_similarity", "unknown_rule"], None]
_KEYS_SQL = "CASE record % 4 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(_KEYS) if x) + " END"


def _records(spark, d):
    key = F.pmod("record", F.lit(4))
    kept = F.when(key == 0, F.array(F.lit(_KEYS[0][0]))).when(key == 1, F.array(*map(F.lit, _KEYS[1]))).when(key == 2, F.array(*map(F.lit, _KEYS[2])))
    records = claims(spark, d).select("case_id", "record", kept.alias("signal_keys"), F.lit(0.15).alias("score"))
    kind = F.when(F.col("record") % 5 == 0, "MENTIONS").otherwise("POSSIBLY_SAME_ENTITY")
    edges = records.select("case_id", F.lit("subject").alias("src"), F.col("record").alias("dst"), kind.alias("type"), (F.pmod("record", F.lit(10)) / 10).alias("score"))
    return ops.written_back(records, edges, claims(spark, d), ops.lineage_table(spark), scoring.rules_table(spark))


_WRITTEN_SQL = f"""WITH {_BEST_SQL}, h AS (SELECT DISTINCT case_id, identifier, value, record FROM {CLAIMS_SQL}), m AS (SELECT h.*, ruling, CASE WHEN first = second THEN [first] ELSE [first, second] END AS pair FROM h JOIN b USING (case_id, identifier, value)),
up AS (SELECT case_id, record, list_sort(list_distinct(flatten(list(pair)))) AS sources FROM m WHERE ruling = 'INDEPENDENT' GROUP BY 1, 2), shared AS (SELECT case_id, record, count(*) AS n FROM m WHERE ruling <> 'INDEPENDENT' GROUP BY 1, 2),
s AS (SELECT DISTINCT case_id, record, unnest(list_append(coalesce({_KEYS_SQL}, ['same_person_name']), 'independent_corroboration')) AS rule_key FROM up),
n AS (SELECT case_id, record, round(least(greatest(1 - product(1 - score), max(score)), max(ceiling)), 4) AS score FROM s JOIN {_SCORES} USING (rule_key) GROUP BY 1, 2)"""
_BAND_SQL = "CASE WHEN score >= 0.9 THEN 'LIKELY_MATCH' WHEN score >= 0.7 THEN 'PROBABLE_MATCH' WHEN score >= 0.5 THEN 'POSSIBLE_MATCH' ELSE 'WEAK_ASSOCIATION' END"


@query("corroborated_records", f"""{_WRITTEN_SQL}, x AS (SELECT c.case_id, c.record, coalesce(n.score, 0.15)::DOUBLE AS score, coalesce(array_to_string(sources, ','), '') AS corroborating_sources, coalesce(shared.n, 0) AS n_shared FROM {CLAIMS_SQL} c LEFT JOIN n USING (case_id, record) LEFT JOIN up USING (case_id, record) LEFT JOIN shared USING (case_id, record))
SELECT *, {_BAND_SQL} AS band FROM x""")
def corroborated_records(spark, d):
    found = _records(spark, d)[0]
    return found.select("case_id", "record", "score", F.array_join("corroborating_sources", ",").alias("corroborating_sources"), F.size("shared_identifiers").cast("long").alias("n_shared"), "band")


@query("corroborated_edges", f"""{_WRITTEN_SQL}, x AS (SELECT c.case_id, c.record AS dst, CASE WHEN record % 5 = 0 THEN 'MENTIONS' ELSE 'POSSIBLY_SAME_ENTITY' END AS type, CASE WHEN record % 5 > 0 AND n.score IS NOT NULL THEN greatest(record % 10 / 10, n.score) ELSE record % 10 / 10 END AS score FROM {CLAIMS_SQL} c LEFT JOIN n USING (case_id, record))
SELECT *, {_BAND_SQL} AS band FROM x""")
def corroborated_edges(spark, d):
    return _records(spark, d)[1].select("case_id", "dst", "type", "score", "band")


@query("strengthened_scores", f"""
WITH s AS (SELECT DISTINCT case_id, user_id, rule_key FROM {FINDINGS_SQL}), c AS (SELECT case_id, user_id FROM s GROUP BY 1, 2 HAVING user_id % 4 = 0),
t AS (SELECT * FROM s UNION SELECT case_id, user_id, 'independent_corroboration' FROM c), r(rule_key, score, ceiling) AS (VALUES {scoring.rules_sql()})
SELECT case_id, user_id, round(least(greatest(1 - product(1 - score), max(score)), max(ceiling)), 4) AS score FROM t JOIN r USING (rule_key) GROUP BY 1, 2""")
def strengthened_scores(spark, d):
    rows = case_findings(spark, d)
    signals = ops.strengthened(rows, rows.filter("user_id % 4 = 0"), ["case_id", "user_id"])
    return scoring.score_groups(signals, ["case_id", "user_id"], scoring.rules_table(spark)).select("case_id", "user_id", "score")


@query("merge_suggestions", f"""
WITH s AS (SELECT DISTINCT user_id, rule_key FROM {FINDINGS_SQL}), r(rule_key, score, ceiling) AS (VALUES {scoring.rules_sql()}),
g AS (SELECT user_id, round(least(greatest(1 - product(1 - score), max(score)), max(ceiling)), 4) AS score FROM s JOIN r USING (rule_key) GROUP BY 1) SELECT user_id, score FROM g WHERE score >= 0.95""")
def merge_suggestions(spark, d):
    return scoring.score_groups(case_findings(spark, d), ["user_id"], scoring.rules_table(spark)).filter(F.col("score") >= scoring.MERGE_SUGGESTION).select("user_id", "score")
