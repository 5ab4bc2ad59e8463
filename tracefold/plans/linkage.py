"""Names of parts, suppliers and customers as records to link."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, scoring, urls
from ..operators import linkage as ops
from .identifiers import KEY_SQL, PATH_SQL
from .registry import query

FORMS_SQL = "|".join(names.LEGAL_FORMS)
STOP_SQL = ", ".join(f"'{w}'" for w in names.STOP_WORDS)


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def org_sql(column: str) -> str:
    bare = rf"trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace({column}, '[,;(].*$', '')), '[^a-z0-9 ]+', '', 'g'), '\b({FORMS_SQL})\b', '', 'g'), ' +', ' ', 'g'))"
    bare = f"CASE WHEN {bare} = '' THEN lower(trim(regexp_replace({column}, '[,;(].*$', ''))) ELSE {bare} END"
    return f"array_to_string(list_sort(list_distinct(list_filter(string_split({bare}, ' '), lambda t: t <> '' AND t NOT IN ({STOP_SQL})))), ' ')"


@query("organisation_keys", f"SELECT {org_sql('n')} AS key, count(*) AS n FROM (SELECT p_name || ' Ltd., ' || p_brand AS n FROM part UNION ALL SELECT 'The ' || split_part(p_name, ' ', 2) || ' and ' || split_part(p_name, ' ', 1) || ' (Corp)' FROM part) GROUP BY 1")
def organisation_keys(spark, d):
    part = table(spark, d, "part")
    one = part.select(F.concat("p_name", F.lit(" Ltd., "), "p_brand").alias("n"))
    two = part.select(F.concat(F.lit("The "), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(" and "), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" (Corp)")).alias("n"))
    return one.unionByName(two).groupBy(names.organisation_key(F.col("n")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("org_key_match", f"WITH r AS (SELECT {org_sql('p_type')} AS key, min(p_partkey) AS b, count(*) AS members FROM part WHERE p_size > 25 GROUP BY 1 HAVING {org_sql('any_value(p_type)')} <> '') SELECT p_partkey AS a, b, key, members FROM part JOIN r ON {org_sql('p_type')} = key WHERE p_size <= 25")
def org_key_match(spark, d):
    part = table(spark, d, "part")
    return ops.organisations_matched(part.filter("p_size <= 25").select(F.col("p_partkey").alias("a"), F.col("p_type").alias("name")), part.filter("p_size > 25").select(F.col("p_partkey").alias("b"), F.col("p_type").alias("name")))


WORDS_SQL = "list_distinct(list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda t: t <> ''))"


@query("place_match", f"""WITH s AS (SELECT c_custkey, {WORDS_SQL.format("n_name || ' ' || c_mktsegment || ' ' || c_name")} AS w FROM customer JOIN nation ON n_nationkey = c_nationkey),
p AS (SELECT n_name AS place, {WORDS_SQL.format('n_name')} AS w FROM nation UNION ALL SELECT r_name, {WORDS_SQL.format('r_name')} FROM region)
SELECT c_custkey, place FROM s JOIN p ON list_has_all(s.w, p.w) WHERE len(p.w) > 0""")
def place_match(spark, d):
    customer = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    stated = customer.select(F.col("c_custkey").alias("a"), F.concat_ws(" ", "n_name", "c_mktsegment", "c_name").alias("stated"))
    places = table(spark, d, "nation").select(F.col("n_name").alias("place")).unionByName(table(spark, d, "region").select(F.col("r_name").alias("place")))
    return ops.places_matched(stated, places).select(F.col("a").alias("c_custkey"), "place")


@query("name_relation", """WITH p AS (SELECT p_partkey, p_name AS c, string_split(p_name, ' ') AS t FROM part), o AS (SELECT p_partkey, c, t, CASE p_partkey % 6 WHEN 0 THEN upper(c) WHEN 1 THEN replace(c, ' ', '-') WHEN 2 THEN c || ' extra' WHEN 3 THEN t[1] WHEN 4 THEN 'zz ' || t[1] ELSE 'unrelated' END AS n FROM p)
SELECT p_partkey % 6 AS form, CASE WHEN len(list_distinct(t)) = 1 AND p_partkey % 6 = 3 THEN 'EXACT' ELSE CASE p_partkey % 6 WHEN 0 THEN 'EXACT' WHEN 1 THEN CASE WHEN contains(c, ' ') THEN 'FORMATTING' ELSE 'EXACT' END WHEN 2 THEN 'EXTENDED' WHEN 3 THEN CASE WHEN len(t) > 1 THEN 'TOKEN_REDUCED' ELSE 'EXACT' END WHEN 4 THEN CASE WHEN len(t) = 1 THEN 'EXTENDED' ELSE 'PARTIAL' END ELSE 'PARTIAL' END END AS relation, count(*) AS n FROM o GROUP BY 1, 2""")
def name_relation(spark, d):
    t = F.split("p_name", " ")
    form = F.col("p_partkey") % 6
    observed = F.when(form == 0, F.upper("p_name")).when(form == 1, F.replace("p_name", F.lit(" "), F.lit("-"))).when(form == 2, F.concat("p_name", F.lit(" extra"))).when(form == 3, t[0]).when(form == 4, F.concat(F.lit("zz "), t[0])).otherwise("unrelated")
    return table(spark, d, "part").groupBy(form.alias("form"), names.relation(observed, F.col("p_name")).alias("relation")).agg(F.count(F.lit(1)).alias("n"))


@query("folded_names", r"SELECT trim(regexp_replace(lower(strip_accents(w)), '[^\p{L}\p{N}]+', ' ', 'g')) AS folded, count(*) AS n FROM (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w FROM documents) GROUP BY 1")
def folded_names(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    distinct = words.groupBy("w").agg(F.count(F.lit(1)).alias("k"))
    return distinct.groupBy(names.fold(F.col("w")).alias("folded")).agg(F.sum("k").alias("n"))


OBSERVED_SQL = "(SELECT user_id % 30 AS subject_id, user_id AS record, CASE event_type WHEN 'click' THEN 'profile_url' WHEN 'view' THEN 'website' WHEN 'purchase' THEN 'affiliation' WHEN 'signup' THEN 'orcid' ELSE 'location' END AS kind, 'v' || (event_id % 25) AS value FROM events WHERE value <= 200)"
ANCHORS_SQL = "(SELECT DISTINCT user_id % 30 AS subject_id, CASE event_type WHEN 'click' THEN 'profile_url' WHEN 'view' THEN 'website' WHEN 'purchase' THEN 'affiliation' WHEN 'signup' THEN 'orcid' ELSE 'location' END AS kind, 'v' || (event_id % 25) AS value FROM events WHERE value > 200)"


def stated(spark, d):
    kind = F.create_map(*(F.lit(x) for kv in {"click": "profile_url", "view": "website", "purchase": "affiliation", "signup": "orcid", "error": "location"}.items() for x in kv))[F.col("event_type")]
    # What is stated as an anchor and what is observed is told by the event's own value.
    rows = table(spark, d, "events").select(F.col("value").alias("weight"), (F.col("user_id") % 30).alias("subject_id"), F.col("user_id").alias("record"), kind.alias("kind"), F.concat(F.lit("v"), F.col("event_id") % 25).alias("value"))
    return rows.filter("weight <= 200").drop("weight"), rows.filter("weight > 200").drop("weight", "record")


@query("anchor_matches", f"""WITH m AS (SELECT DISTINCT o.subject_id, o.record, o.kind FROM {OBSERVED_SQL} o JOIN {ANCHORS_SQL} a ON o.subject_id = a.subject_id AND o.kind = a.kind AND o.value = a.value)
SELECT * FROM m WHERE NOT (kind = 'website' AND EXISTS (SELECT 1 FROM m x WHERE x.subject_id = m.subject_id AND x.record = m.record AND x.kind = 'profile_url'))""")
def anchor_matches(spark, d):
    observed, anchors = stated(spark, d)
    return ops.anchor_matches(observed, anchors).select("subject_id", "record", "kind")


@query("anchor_conflicts", f"""SELECT DISTINCT o.subject_id, o.record, o.kind FROM {OBSERVED_SQL} o WHERE EXISTS (SELECT 1 FROM {ANCHORS_SQL} a WHERE a.subject_id = o.subject_id AND a.kind = o.kind)
AND NOT EXISTS (SELECT 1 FROM {OBSERVED_SQL} p JOIN {ANCHORS_SQL} a ON p.subject_id = a.subject_id AND p.kind = a.kind AND p.value = a.value WHERE p.subject_id = o.subject_id AND p.record = o.record AND p.kind = o.kind)""")
def anchor_conflicts(spark, d):
    observed, anchors = stated(spark, d)
    return ops.conflicts(observed, anchors)


_ANCHOR_RULES_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ops.ANCHOR_RULES.items())


@query("record_assessment", f"""WITH o AS {OBSERVED_SQL}, a AS {ANCHORS_SQL}, m AS (SELECT DISTINCT o.subject_id, o.record, o.kind FROM o JOIN a ON o.subject_id = a.subject_id AND o.kind = a.kind AND o.value = a.value),
k AS (SELECT * FROM m WHERE NOT (kind = 'website' AND EXISTS (SELECT 1 FROM m x WHERE x.subject_id = m.subject_id AND x.record = m.record AND x.kind = 'profile_url'))),
s AS (SELECT subject_id, record, CASE kind {_ANCHOR_RULES_SQL} END AS rule_key FROM k UNION SELECT subject_id, record, CASE WHEN record % 3 = 0 THEN 'same_person_name' ELSE 'name_variant_partial' END FROM o),
r(rule_key, score, ceiling) AS (VALUES {scoring.rules_sql()}), g AS (SELECT subject_id, record, round(least(greatest(1 - product(1 - score), max(score)), max(ceiling)), 4) AS score FROM s JOIN r USING (rule_key) GROUP BY 1, 2),
c AS (SELECT DISTINCT subject_id, record, kind FROM o WHERE EXISTS (SELECT 1 FROM a WHERE a.subject_id = o.subject_id AND a.kind = o.kind) AND NOT EXISTS (SELECT 1 FROM m WHERE m.subject_id = o.subject_id AND m.record = o.record AND m.kind = o.kind)),
l AS (SELECT subject_id, record, array_to_string(list_sort(list(kind)), ',') AS conflicts FROM c GROUP BY 1, 2)
SELECT g.subject_id, g.record, score, coalesce(conflicts, '') AS conflicts FROM g LEFT JOIN l ON g.subject_id = l.subject_id AND g.record = l.record""")
def record_assessment(spark, d):
    observed, anchors = stated(spark, d)
    rule = F.when(F.col("record") % 3 == 0, "same_person_name").otherwise("name_variant_partial")
    out = ops.assessed(observed, anchors, observed.select("subject_id", "record", rule.alias("rule_key")), scoring.rules_table(spark))
    return out.select("subject_id", "record", "score", F.array_join("conflicts", ",").alias("conflicts"))


@query("result_owners", f"""WITH k AS (SELECT page_id, {KEY_SQL} AS url_key FROM pages), o AS (SELECT url_key, min(page_id) AS candidate FROM k WHERE page_id % 3 = 0 GROUP BY 1) SELECT page_id, candidate FROM k LEFT JOIN o USING (url_key)""")
def result_owners(spark, d):
    pages = table(spark, d, "pages")
    own = pages.filter("page_id % 3 = 0").select(F.col("page_id").alias("candidate"), F.upper("url").alias("page_url"))
    return ops.owners(pages.select("page_id", "url"), own).select("page_id", "candidate")


@query("declared_names", f"""SELECT c_custkey, p_partkey FROM customer JOIN part ON p_partkey = c_custkey WHERE len(list_filter({WORDS_SQL.format("split_part(p_name, ' ', 1)")}, lambda t: NOT list_contains({WORDS_SQL.format("p_name || ' ' || c_mktsegment")}, t))) = 0 AND lower(p_name) <> lower(split_part(p_name, ' ', 1))""")
def declared_names(spark, d):
    both = table(spark, d, "customer").join(table(spark, d, "part"), F.col("p_partkey") == F.col("c_custkey"))
    searched, declared = F.split_part("p_name", F.lit(" "), F.lit(1)), F.concat_ws(" ", "p_name", "c_mktsegment")
    other = F.lower("p_name") != F.lower(searched)
    return both.filter(names.holds(names.words(declared), names.words(searched)) & other).select("c_custkey", "p_partkey")


@query("supplied_value_in_text", "SELECT lang, count(*) FILTER (contains(lower(text), lower(source))) AS named, count(*) FILTER (contains(lower(text), 'license')) AS licensed, count(*) AS n FROM documents GROUP BY 1")
def supplied_value_in_text(spark, d):
    low = F.lower("text")
    return table(spark, d, "documents").groupBy("lang").agg(F.count_if(F.contains(low, F.lower("source"))).alias("named"), F.count_if(F.contains(low, F.lit("license"))).alias("licensed"), F.count(F.lit(1)).alias("n"))


@query("useful_results", f"""WITH k AS (SELECT *, {PATH_SQL} AS p FROM pages) SELECT CASE WHEN regexp_matches(lower(p), '\\.(pdf|docx?|xlsx?|pptx?|odt|csv)$') THEN 'DOCUMENT' WHEN regexp_matches(lower(p), '\\.(png|jpe?g|gif|webp|svg)$') THEN 'IMAGE' ELSE 'WEBSITE' END AS kind, count(*) AS n, count(*) FILTER (contains(url, '.html') OR contains(url, '#')) AS useful FROM k GROUP BY 1""")
def useful_results(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").groupBy(urls.finding_kind(url).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(url.contains(".html") | url.contains("#")).alias("useful"))


@query("presence_caps", "SELECT user_id, round(max(least(value / 200, 0.6)), 6) AS confidence FROM events GROUP BY 1")
def presence_caps(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.max(F.least(F.col("value") / 200, F.lit(0.6))), 6).alias("confidence"))


@query("records_by_source", "SELECT coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, 'Unknown source') AS label, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1")
def records_by_source(spark, d):
    key = F.col("o_orderkey")
    label = F.coalesce(F.when(key % 3 > 0, F.col("o_orderpriority")), F.when(key % 2 == 0, F.col("o_orderstatus")), F.lit("Unknown source"))
    return table(spark, d, "orders").groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))
