"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(materialize(least, "least"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that occurs in `links` (two columns of ids of one type).

    The component is the smallest id that can be reached. Self links, repeated links and links in
    either direction are alike; rows with a null are left out; no links give an empty table. Each
    round is written to the shared folder, as is each step's table of least neighbours, so that Spark may split
    a node of very many links when it joins them; only a count and a checksum reach the driver.
    """
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).dropna().distinct()
    alone = edges.filter("u = v").select("u")
    edges, seen = edges.filter("u <> v"), None
    for _ in range(most_rounds):
        edges = materialize(_small_star(materialize(_large_star(edges), "stars")), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node")).unionByName(alone.select(F.col("u").alias("node"))).distinct()
    roots = roots.join(stars.select("node"), "node", "left_anti")
    return stars.unionByName(roots.select("node", F.col("node").alias("component")))
