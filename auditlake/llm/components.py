"""Connected components of an edge list by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.session import checkpointed


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest of each node's neighbours; partial minima are taken before the shuffle, so a hub is no hot task."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = checkpointed(_least(both).select("u", F.least("u", "m").alias("m")))  # a plain input of the join, so that a hub's edges may be split at run time
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    low = checkpointed(_least(edges))
    links = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return links.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node of its component, for every node of the pairs.

    Every round is checkpointed (it cuts the lineage and survives lost executors); it ends when a round changes nothing. Nulls and
    self-links are dropped; an empty edge list has no components.
    """
    edges = pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    edges = checkpointed(edges)
    size = (-1, 0)
    while True:
        edges = checkpointed(_small_star(_large_star(edges)))
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == size:
            break
        size = tuple(now)
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
