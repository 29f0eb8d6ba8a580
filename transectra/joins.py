"""Combining tables that hold one row per group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import stored


def join_group_facts(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Attach per-group facts (few narrow columns) to every row of the groups.

    The facts are computed once and stored (runs a job), so Spark knows their size in
    bytes: below ``spark.sql.autoBroadcastJoinThreshold`` they are broadcast and a large
    table is not shuffled by a key of which one value may hold a third of it; above it
    both sides are shuffled and skewed partitions split.
    """
    return rows.join(stored(facts), keys, how)


def merge_by_key(parts: list[DataFrame], key: str) -> DataFrame:
    """Put tables with at most one row per key side by side, like a chain of full joins.

    One union and one aggregation instead of a shuffle per join; every column other
    than the key belongs to one part.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.groupBy(key).agg(*[F.first(c, ignorenulls=True).alias(c) for c in rows.columns if c != key])
