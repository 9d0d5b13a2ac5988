"""Connected components of a link table, by alternating stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfweave.session import fresh_path, store_table


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; edges point from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node of its component) of all nodes in ``links`` (columns a, b).

    Self-links and repeated links are harmless; nodes without a link to another are not listed.
    Each round costs a few shuffles of the links, is stored in the shared folder, and a node
    with very many links is only ever combined by ``min``. Rounds go on until nothing changes; few suffice, since every
    round shortens the paths of all components at once.
    """
    spark = links.sparkSession
    a, b = links.columns
    edges = links.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    edges = store_table(edges, fresh_path(spark, "links"))
    state = None
    while True:
        edges = store_table(_small_star(_large_star(edges)), fresh_path(spark, "links"))
        last, state = state, edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            return edges.toDF("node", "root")
