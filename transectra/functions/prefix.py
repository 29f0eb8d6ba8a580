"""Running sums in an order, per group, without one task seeing a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def running_sums(
    rows: DataFrame, groups: list[str], order: list[str | Column], values: dict[str, str | Column],
    facts: DataFrame | None = None,
) -> DataFrame:
    """``rows`` with ``<name>_before`` and ``<name>_all`` for every entry of ``values`` (whole numbers).

    ``_before`` adds up the rows of the group that come earlier in ``order``, ``_all`` the
    whole group. Two levels: rows are range-partitioned by group and order, summed
    inside each (partition, group), and moved by the totals of the group's earlier
    partitions. So a group may span many partitions and a partition may hold many
    groups; the second level has one row per partition and group. Rows that tie are
    told apart by their place in the stored input, so even equal rows are spread.
    Null groups are groups; ``groups`` may be empty. ``facts`` (one row per group) are attached on the
    way. Runs jobs: rows are stored twice in the shared folder, so that an executor
    lost in between changes nothing.
    """
    base = stored(rows.select("*", *[(F.col(v) if isinstance(v, str) else v).cast("long").alias(f"_v_{n}") for n, v in values.items()]))
    base = base.withColumn("_tie", F.monotonically_increasing_id())
    by = [*[F.col(g) for g in groups], *order, F.col("_tie")]
    cut = base.repartitionByRange(*by).withColumn("_part", F.spark_partition_id())
    earlier = Window.partitionBy("_part", *groups).orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, -1)
    near = stored(cut.select("*", *[F.coalesce(F.sum(f"_v_{n}").over(earlier), F.lit(0)).alias(f"_in_{n}") for n in values]).drop("_tie"))

    totals = near.groupBy("_part", *groups).agg(*[F.coalesce(F.sum(f"_v_{n}"), F.lit(0)).alias(f"_t_{n}") for n in values])
    # At most one row per partition in a group's window.
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    moves = totals.select("_part", *groups, *[
        c for n in values for c in (
            F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_off_{n}"), F.sum(f"_t_{n}").over(whole).alias(f"{n}_all"))
    ])
    extra = []
    if facts is not None:
        extra = [c for c in facts.columns if c not in groups]
        moves = _by(moves, facts, groups, "left", extra)
    out = _by(near, stored(moves), ["_part", *groups], "inner", [c for c in moves.columns if c not in groups and c != "_part"])
    return out.select(
        *rows.columns, *[c for n in values for c in ((F.col(f"_in_{n}") + F.col(f"_off_{n}")).alias(f"{n}_before"), F.col(f"{n}_all"))],
        *extra)


def _by(left: DataFrame, right: DataFrame, keys: list[str], how: str, take: list[str]) -> DataFrame:
    """Equi-join in which null keys are equal to each other; ``take`` names the columns of the right side that stay."""
    other = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *take)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(other, same, how).drop(*[f"_r_{k}" for k in keys])
