"""Cutting lineage by tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`, or a temporary folder where it is unset and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="spark-ckpt-"))
    return _own[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet and read back, so that a lost executor costs no earlier round."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """`rows` dealt over `spark.sql.shuffle.partitions` tasks, for work that costs far more than reading:
    a small file is one partition, however long its rows take. The number is given, so that AQE doesn't
    join them again."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
