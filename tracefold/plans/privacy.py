"""Sensitive values in documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import privacy
from .registry import query

CARD_SQL = privacy.CARD
LUHN_SQL = """(length(d) BETWEEN 13 AND 19 AND list_sum([CASE WHEN (length(d) - i) % 2 = 1 THEN CASE WHEN 2 * substr(d, i, 1)::INT > 9 THEN 2 * substr(d, i, 1)::INT - 9 ELSE 2 * substr(d, i, 1)::INT END ELSE substr(d, i, 1)::INT END FOR i IN range(1, length(d) + 1)]) % 10 = 0)"""
SECRETS_SQL = [(c, p.replace("'", "''").replace("\\n", "\n")) for c, p in privacy.SECRETS]


def docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def redact_sql(column: str) -> str:
    for _, pattern in SECRETS_SQL:
        column = f"regexp_replace({column}, '{pattern}', '{privacy.SECRET}', 'g')"
    return column


@query("card_luhn", f"""
WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '{CARD_SQL}')) AS run FROM documents), x AS (SELECT *, regexp_replace(run, '[^0-9]', '', 'g') AS d FROM c)
SELECT doc_id, run, {LUHN_SQL} AS valid FROM x""")
def card_luhn(spark, d):
    runs = docs(spark, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(privacy.CARD), 0)).alias("run"))
    return runs.withColumn("valid", privacy.luhn(F.col("run")))


@query("pii_classification", f"""
WITH x AS (SELECT doc_id, text, regexp_replace(regexp_extract(text, '{CARD_SQL}'), '[^0-9]', '', 'g') AS d FROM documents),
c AS (SELECT doc_id, coalesce({LUHN_SQL}, false) AS card, regexp_matches(text, '{privacy.SOCIAL_NUMBER}') AS gov, regexp_matches(text, '{privacy.EMAIL}') AS mail FROM x)
SELECT doc_id, CASE WHEN card OR gov THEN 'RESTRICTED' WHEN mail THEN 'PERSONAL' ELSE 'PUBLIC' END AS level, card OR gov AS redact,
  array_to_string(list_filter([CASE WHEN card THEN 'payment_card' END, CASE WHEN gov THEN 'government_id' END, CASE WHEN mail THEN 'email_address' END], lambda r: r IS NOT NULL), ',') AS rules FROM c""")
def pii_classification(spark, d):
    found = docs(spark, d).select("doc_id", privacy.classify(F.lit("text"), F.col("text")).alias("c"))
    return found.select("doc_id", privacy.level_name(F.col("c.level")).alias("level"), "c.redact", F.array_join("c.rules", ",").alias("rules"))


@query("redacted_documents", f"""SELECT doc_id, {redact_sql('text')} AS clean, {redact_sql('text')} <> text AS redacted FROM documents""")
def redacted_documents(spark, d):
    clean = privacy.redact_secrets(F.col("text"))
    return docs(spark, d).select("doc_id", clean.alias("clean"), (clean != F.col("text")).alias("redacted"))


@query("secret_exposure", " UNION ALL ".join(f"SELECT '{c}' AS category, count(*) AS n_docs, sum(n)::BIGINT AS n_matches FROM (SELECT len(regexp_extract_all(text, '{p}')) AS n FROM documents) WHERE n > 0 HAVING count(*) > 0" for c, p in SECRETS_SQL))
def secret_exposure(spark, d):
    counts = privacy.count_secrets(F.col("text"))
    found = docs(spark, d).select(F.explode(F.array(*(F.struct(F.lit(c).alias("category"), n.alias("n")) for c, n in counts.items()))).alias("x")).select("x.*").filter("n > 0")
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_matches"))


@query("document_excerpts", f"""
WITH c AS (SELECT doc_id, trim({redact_sql('text')}) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 500 THEN substr(t, 1, 500) || '…' ELSE t END AS excerpt FROM c""")
def document_excerpts(spark, d):
    return docs(spark, d).select("doc_id", privacy.excerpt(F.col("text")).alias("excerpt"))


@query("export_policy", f"""
WITH x AS (SELECT doc_id, text, regexp_replace(regexp_extract(text, '{CARD_SQL}'), '[^0-9]', '', 'g') AS d FROM documents),
c AS (SELECT doc_id, text, CASE WHEN coalesce({LUHN_SQL}, false) OR regexp_matches(text, '{privacy.SOCIAL_NUMBER}') THEN 3 WHEN regexp_matches(text, '{privacy.EMAIL}') THEN 1 ELSE 0 END AS rank FROM x)
SELECT doc_id, CASE WHEN rank > 0 THEN '[WITHHELD: ' || CASE rank WHEN 3 THEN 'RESTRICTED' ELSE 'PERSONAL' END || ']' ELSE text END AS data, rank > 0 AS withheld FROM c""")
def export_policy(spark, d):
    found = docs(spark, d).select("doc_id", "text", privacy.classify(F.lit("text"), F.col("text"))["level"].alias("rank"))
    data, over = privacy.withheld(F.col("text"), F.col("rank"), 0)
    return found.select("doc_id", data.alias("data"), over.alias("withheld"))


@query("classification_at_least", """
WITH s AS (SELECT event_type, CASE event_type WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 0 ELSE 1 END AS rank FROM events)
SELECT event_type, count(*) AS n, bool_and(rank >= 2) AS at_least_sensitive, bool_and(rank > 1) AS exceeds_personal FROM s GROUP BY 1""")
def classification_at_least(spark, d):
    level = F.when(F.col("event_type") == "signup", "SENSITIVE").when(F.col("event_type") == "purchase", "RESTRICTED").when(F.col("event_type") == "error", "PUBLIC").otherwise("PERSONAL")
    rank = privacy.level_rank(level)
    return spark.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.bool_and(rank >= privacy.LEVELS.index("SENSITIVE")).alias("at_least_sensitive"), F.bool_and(rank > privacy.LEVELS.index("PERSONAL")).alias("exceeds_personal"))


@query("privacy_walk", f"""
WITH k AS (SELECT conv_id, turn, role AS key, text AS value FROM conversations UNION ALL SELECT conv_id, turn, 'phone_number', turn::VARCHAR FROM conversations UNION ALL SELECT conv_id, turn, 'status', 'ok' FROM conversations),
f AS (SELECT *, {redact_sql('value')} AS clean, regexp_replace(regexp_extract(value, '{CARD_SQL}'), '[^0-9]', '', 'g') AS d FROM k),
g AS (SELECT *, coalesce({LUHN_SQL}, false) OR regexp_matches(value, '{privacy.SOCIAL_NUMBER}') AS bad FROM f)
SELECT conv_id, count(*) AS leaves, count(*) FILTER (clean <> value OR bad OR key = 'phone_number') AS changed FROM g GROUP BY 1""")
def privacy_walk(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    leaves = c.select("conv_id", F.inline(F.array(F.struct(F.col("role").alias("key"), F.col("text").alias("value")), F.struct(F.lit("phone_number").alias("key"), F.col("turn").cast("string").alias("value")), F.struct(F.lit("status").alias("key"), F.lit("ok").alias("value")))))
    kept = privacy.filtered(F.col("key"), F.col("value"))
    return leaves.groupBy("conv_id").agg(F.count(F.lit(1)).alias("leaves"), F.count_if((kept != F.substring("value", 1, 4000))).alias("changed"))


@query("principal_keys", """SELECT substr(sha256(lower(trim(c_name))), 1, 32) AS principal, count(*) AS n FROM customer GROUP BY 1""")
def principal_keys(spark, d):
    key = F.substring(F.sha2(F.lower(F.trim("c_name")), 256), 1, 32)
    return spark.read.parquet(f"{d}/customer.parquet").groupBy(key.alias("principal")).agg(F.count(F.lit(1)).alias("n"))
