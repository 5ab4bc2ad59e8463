"""A corpus from raw documents: language, recurring lines, near copies, test items, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import decontam, langid, linededup, minhash, packing
from tracefold.llm.common import is_held_out, shared_dir

#: A document stays if one language labels this share of its words' bytes.
LEAST_LANGUAGE_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (`und`: null and empty texts too) and those of no predominant
    language go; so do all where no language is known. Rows with a null doc_id and repeated rows
    stand for themselves; an empty table stays empty; other columns may have any name."""
    model = langid.train(docs.filter(~is_held_out(4, 2)))
    found = langid.identify(docs, model, keep=True)
    label = found.columns[-1]
    return found.filter((F.col(f"{label}.lang_pred") != langid.UNKNOWN) & (F.col(f"{label}.score") >= LEAST_LANGUAGE_SHARE)).drop(label)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines are cut; a document of which no letter or digit is left goes. Null and empty
    texts have no lines and stay; ids, repeats and other columns are as in `linededup.cleaned`."""
    parts = linededup.cleaned(docs)
    emptied = (F.col("n_dropped") > 0) & ~F.col("text").rlike(r"[\p{L}\p{N}]")
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return parts.filter(~emptied).select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """`docs` without the rows whose doc_id and text are in `gone` (doc_id, text_key); a null
    doc_id is an id like others."""
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    gone = gone.select(F.col("doc_id").alias("id"), "text_key").distinct().alias("gone")
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("gone.id")) & (key == F.col("gone.text_key")), "left_anti")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id. Rows that repeat its
    doc_id and text are the same document. A row with a null doc_id or without words stays."""
    return _without(docs, minhash.near_dedup(docs).filter(~F.col("kept")))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a copy of a test item go, those with a null doc_id too; null and empty texts
    stay. A row that shares its doc_id with such a document, but not its text, stays."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontam.contaminated(docs, items))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, as the packing query returns them; a null or empty text is the end id
    alone, and rows with a null or repeated doc_id are packed each on its own."""
    return packing.with_digest(packing.pack(docs))


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("pack", pack)]
#: SQL can't express languages learned from text, MinHash or tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}-{name}")
    return docs
