"""Lines that recur across documents, by a log-template tree. DataFrame functions only.

Each line that isn't blank goes down a tree of fixed depth: first by its number of tokens, then
by its `LEAD` leading tokens. Tokens with a digit are variable fields and become one mark. In a
leaf whose lines differ, each further place is fixed where one token has `FIXED` of the leaf's
lines, else it is a variable field. The lines that have all fixed tokens are the leaf's template,
if beside the leading tokens at least two in three places are fixed; one rule holds for lines of
any length. Every line is also the template of its own masked text. A template in `min_docs`
documents is dropped from all of them but the one with the smallest id; for lines of `LONG` tokens
or more two documents are enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bound import bound
from .common import fresh, materialize

MIN_DOCS = 3
LEAD = 3
#: Percent of a leaf's lines that have the token of a fixed place.
FIXED = 80
LONG = 50
_LAST = (1 << 63) - 1


def masked(line: Column) -> Column:
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ ]*[0-9][^ ]*", "<*>")).otherwise(line)


def _lines(named: DataFrame) -> DataFrame:
    """doc, pos, line (masked), n (tokens) and leaf of each line that isn't blank."""
    lines = named.select("doc", F.posexplode(F.split("row.text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.trim("line")).filter("line <> ''").withColumn("line", masked(F.col("line")))
    n = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    return lines.withColumn("n", n).withColumn("leaf", F.xxhash64("n", F.substring_index("line", " ", LEAD)))


def _needed(min_docs: int, long: int) -> Column:
    return F.when(F.col("n") >= long, F.least(F.lit(2), F.lit(min_docs))).otherwise(min_docs)


def _recurring(members: DataFrame, key: str, min_docs: int, long: int) -> DataFrame:
    """(doc, pos) of lines whose `key` occurs in enough documents, apart from the first of them."""
    docs = members.groupBy(key, "doc").agg(F.first("n").alias("n")).groupBy(key).agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("n_docs"), F.min("doc").alias("keeper"))
    # A table of its own, so that Spark may split a template of very many lines when it joins them.
    often = materialize(docs.filter(F.col("n_docs") >= _needed(min_docs, long)).select(key, "keeper"), "templates")
    return members.join(often, key).filter("doc <> keeper").select("doc", "pos")


def _templates(lines: DataFrame, refs: DataFrame, min_docs: int, long: int) -> DataFrame:
    """doc, pos, n, leaf of the lines that have all fixed tokens of their leaf's template."""
    docs = refs.groupBy("leaf", "doc").agg(F.first("n").alias("n"), F.min("whole").alias("least"), F.max("whole").alias("most"))
    leaves = docs.groupBy("leaf").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("n_docs"), F.min("least").alias("least"), F.max("most").alias("most"))
    varied = materialize(leaves.filter((F.col("n_docs") >= _needed(min_docs, long)) & (F.col("least") != F.col("most"))).select("leaf"), "leaves")

    members = materialize(lines.join(varied, "leaf").select("leaf", "doc", "pos", "n", F.split("line", " ").alias("tokens")), "varied")
    tokens = members.select("leaf", "n", F.posexplode("tokens").alias("place", "token")).filter(F.col("place") >= LEAD)
    counted = tokens.groupBy("leaf", "place", "token").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("lines"))
    places = counted.groupBy("leaf", "place").agg(F.first("n").alias("n"), F.sum("lines").alias("all"), F.max(F.struct("lines", "token")).alias("top"))
    fixed = places.filter(F.col("top.lines") * 100 >= F.col("all") * FIXED)
    # As long as a line; a place that isn't fixed is missing.
    shapes = fixed.groupBy("leaf").agg(F.first("n").alias("n"), F.collect_list(F.struct("place", F.col("top.token").alias("token"))).alias("fixed"))
    shapes = shapes.filter(3 * (F.col("n") - LEAD - F.size("fixed")) <= F.col("n") - LEAD)
    shapes = materialize(shapes.select("leaf", "fixed"), "shapes")
    fits = F.forall("fixed", lambda x: F.get("tokens", x["place"]) == x["token"])
    return members.join(shapes, "leaf").filter(fits).select("doc", "pos", "n", "leaf")


def cleaned(docs: DataFrame, min_docs: int = MIN_DOCS, long: int = LONG) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): row (a struct of its columns), text without
    the dropped lines, n_lines, n_dropped.

    Lines are what "\\n" separates; blank lines are never dropped. Null text stays null and has 0
    lines. A row with a null doc_id counts as a document after all others; rows that repeat a
    doc_id and its text are one document and come out alike. Other columns may have any name. An
    empty table gives an empty table.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    doc = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key")).alias("doc")
    named = docs.select(doc, row)
    lines = _lines(named)
    refs = materialize(lines.select("doc", "pos", "n", "leaf", F.xxhash64("n", "line").alias("whole")), "lines")
    gone = _recurring(refs, "whole", min_docs, long).unionByName(_recurring(_templates(lines, refs, min_docs, long), "leaf", min_docs, long))
    gone = gone.groupBy("doc").agg(F.collect_set("pos").alias("gone"))
    parts = named.join(gone, "doc", "left")
    # By a hash set of places, so that a text of many lines, most of them dropped, stays linear.
    kept = lambda all_: F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col("gone"))
    left = bound(F.split("row.text", "\n"), lambda all_: F.array_join(F.transform(kept(all_), lambda i: F.get(all_, i)), "\n"))
    return parts.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(left).alias("text"),
        F.when(F.col("row.text").isNull(), 0).otherwise(F.size(F.split("row.text", "\n"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, keep: bool = False, long: int = LONG) -> DataFrame:
    """doc_id, text, n_lines, n_dropped of each row of `cleaned`. With `keep`, the columns of
    `docs`, text changed, and the number of dropped lines under the first free name of
    `__n_dropped`, `___n_dropped` and so on."""
    parts = cleaned(docs, min_docs, long)
    if keep:
        own = [F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
        return parts.select(*own, F.col("n_dropped").alias(fresh("__n_dropped", docs.columns)))
    return parts.select(F.col("row.doc_id").cast("long").alias("doc_id"), "text", "n_lines", "n_dropped")


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def cleaned_sql(table: str, min_docs: int = MIN_DOCS, long: int = LONG) -> str:
    """DuckDB SQL for doc_id, text, n_lines, n_dropped over a table of (doc_id, text)."""
    needed = f"CASE WHEN any_value(n) >= {long} THEN least(2, {min_docs}) ELSE {min_docs} END"
    return rf"""
WITH ln AS (
  SELECT doc_id, pos, trim(line) AS line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {table} WHERE text IS NOT NULL)
  WHERE trim(line) <> ''
), tk AS (
  SELECT doc_id, pos, string_split(regexp_replace(line, '[^ ]*[0-9][^ ]*', '<*>', 'g'), ' ') AS t FROM ln
), lf AS (
  SELECT doc_id, pos, t, len(t) AS n, array_to_string(list_prepend(len(t)::VARCHAR, t[1:{LEAD}]), ' ') AS leaf FROM tk
), counted AS (
  SELECT leaf, n, place, token, count(*) AS lines FROM (
    SELECT leaf, n, unnest(t) AS token, generate_subscripts(t, 1) AS place FROM lf WHERE n > {LEAD})
  WHERE place > {LEAD} GROUP BY ALL
), fixed AS (
  SELECT leaf, n, place, arg_max(token, (lines, token)) AS token FROM counted GROUP BY ALL
  HAVING max(lines) * 100 >= sum(lines) * {FIXED}
), shapes AS (
  SELECT leaf, list(place) AS places, list(token) AS tokens FROM fixed GROUP BY leaf, n HAVING 3 * (n - {LEAD} - count(*)) <= n - {LEAD}
), general AS (
  SELECT doc_id, pos, n, leaf FROM lf JOIN shapes USING (leaf) WHERE [t[p] FOR p IN places] = tokens
), member AS (
  SELECT doc_id, pos, n, 'w' || array_to_string(t, ' ') AS template FROM lf UNION ALL SELECT doc_id, pos, n, 'g' || leaf FROM general
), often AS (
  SELECT template, min(doc_id) AS keeper FROM member GROUP BY 1 HAVING count(DISTINCT doc_id) >= {needed}
), gone AS (
  SELECT doc_id, list(DISTINCT pos) AS gone FROM member JOIN often USING (template) WHERE doc_id <> keeper GROUP BY 1
)
SELECT d.doc_id,
  CASE WHEN gone IS NULL THEN text ELSE array_to_string([x FOR x, i IN string_split(text, chr(10)) IF NOT list_contains(gone, i)], chr(10)) END AS text,
  CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines,
  coalesce(len(gone), 0) AS n_dropped
FROM {table} d LEFT JOIN gone USING (doc_id)
"""


OP6_SQL = cleaned_sql("documents")
