"""Connected components of a link table by alternating star steps.

Edges are (a, b) with a > b. A large-star step hands every larger neighbour of a node
to the least of its neighbours, a small-star step every smaller one; a logarithmic
number of rounds leaves one star per component, whose centre is its least node. Every
step is an aggregation (combined before its shuffle) and an equi-join against one row
per node, written to the shared folder, so a node with very many links is a skewed
join that Spark can split, never a group held in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import settle


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = settle(edges.groupBy("a").agg(F.min("b").alias("m")))
    moved = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.withColumnRenamed("m", "b")).distinct()


def _is_stars(edges: DataFrame) -> bool:
    n = edges.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("a").alias("d")).first()
    if n["n"] != n["d"]:
        return False
    return edges.select("a").join(edges.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (two long columns, any order); a component is its least node. Runs jobs."""
    a, b = links.columns[:2]
    edges = settle(
        links.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    )
    while not _is_stars(edges):
        edges = settle(_small_star(settle(_large_star(edges))))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
