"""Exact nearest neighbours in space through a tree whose cells split where points are dense.

A cell with more than ``LEAF`` points is cut in 2, 4 or 8 along each axis of the box its
points fill, by how many there are; others stay leaves. So depth follows density: a
cluster of any density beside a point any distance away costs a few more levels, and
no level of fineness is fixed. Cells carry their number of points and the box these
fill, one row per cell.

A point first meets its own leaf, which bounds the distance of its neighbour. Its ball
then goes down from the root: at each cell the children it can touch follow from
arithmetic, and an equi-join with the cells of the next level keeps those that exist
and are near enough. A ball that touches many children (a lonely point's) is narrowed at each
level to the nearest farthest corner of a child that holds another point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.geo import distance
from ..session import stored

#: Points that a cell may hold unsplit.
LEAF = 256
#: Points of one task; leaves are tiny rows, so Spark would give all to a few tasks.
POINTS_PER_TASK = 8_192
#: A cell is cut in at most ``2 ** MOST_HALVINGS`` along an axis at once.
MOST_HALVINGS = 3
#: Children that a ball may touch before it is narrowed.
NARROW = 27
AXES = "xyz"
ROOT = 0


def _half(c: Column) -> Column:
    return c / 2.0


def _index(value: Column, axis: str) -> Column:
    """Number of the child along an axis; values outside the cell's box go to its first or last child.

    Halves keep the extent of a box finite. The least point of a box lands in the first
    child and the greatest in the last, so every cut tells some points apart.
    """
    low, high, cuts = F.col(f"l{axis}"), F.col(f"h{axis}"), F.expr("shiftleft(1, k)")
    share = F.try_divide(_half(value) - _half(low), _half(high) - _half(low))
    place = F.least(F.greatest(F.floor(share * cuts), F.lit(0)), cuts - 1)
    return F.when(value <= low, F.lit(0)).when(value >= high, F.when(high > low, cuts - 1).otherwise(0)).otherwise(place).cast("long")


def _child(cell: Column, places: list[Column]) -> Column:
    """Name of a child. Should two ever hash alike they are one cell with one box, which costs time only."""
    return F.xxhash64(cell, *places)


def build(points: DataFrame, group: str, leaf: int = LEAF) -> tuple[list[DataFrame], DataFrame]:
    """(cells by level, points with their leaf ``cell``) of points (group, id, x, y, z) at distinct finite places. Runs jobs, a few per level.

    Cells are ``group, cell, n, k`` (halvings of its children; 0 is a leaf) and the box
    ``lx hx ly hy lz hz``.
    """
    levels: list[DataFrame] = []
    placed: list[DataFrame] = []
    active = points.select(group, "id", *AXES, F.lit(ROOT).cast("long").alias("cell"))
    while True:
        wanted = F.ceil(F.log2(F.col("n") / leaf) / 3).cast("int")
        cells = active.groupBy(group, "cell").agg(
            F.count(F.lit(1)).alias("n"), *[f(a).alias(s + a) for a in AXES for s, f in (("l", F.min), ("h", F.max))])
        cells = stored(cells.withColumn("k", F.when(F.col("n") > leaf, F.least(F.greatest(wanted, F.lit(1)), F.lit(MOST_HALVINGS))).otherwise(0)))
        levels.append(cells)
        more = not cells.filter("k > 0").isEmpty()
        inside = active.join(cells.drop("n"), [group, "cell"])
        placed.append(inside.filter("k = 0").select(active.columns) if more else active)
        if not more:
            break
        lower = _child(F.col("cell"), [_index(F.col(a), a) for a in AXES])
        active = stored(inside.filter("k > 0").select(group, "id", *AXES, lower.alias("cell")))
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return levels, stored(out)


def _gap(axis: str) -> Column:
    q = F.col(axis)
    return F.greatest(F.col(f"l{axis}") - q, q - F.col(f"h{axis}"), F.lit(0.0))


def _reach(axis: str) -> Column:
    q = F.col(axis)
    return F.greatest(F.abs(q - F.col(f"l{axis}")), F.abs(F.col(f"h{axis}") - q))


def _length(parts: list[Column]) -> Column:
    return distance(*parts, *[F.lit(0.0)] * 3)


def _down(balls: DataFrame, above: DataFrame, below: DataFrame, group: str) -> DataFrame:
    """Balls (group, id, x, y, z, leaf, bound, cell) at split cells, moved to the children they may find a neighbour in."""
    at = balls.join(above.filter("k > 0").drop("n"), [group, "cell"])
    # A distance is rounded (and its squares may vanish); the ball's sides lie a little further out.
    radius = F.col("bound") * F.lit(1.0 + 1e-12) + F.lit(1e-150)
    for a in AXES:
        at = at.withColumns({f"_f{a}": _index(F.col(a) - radius, a), f"_t{a}": _index(F.col(a) + radius, a)})
    touched = F.lit(1)
    for a in AXES:
        touched = touched * (F.col(f"_t{a}") - F.col(f"_f{a}") + 1)
    at = at.withColumn("wide", F.col("wide") | (touched > NARROW))
    for a in AXES:
        at = at.withColumn(f"_c{a}", F.explode(F.sequence(f"_f{a}", f"_t{a}")))
    at = at.select(group, "id", *AXES, "leaf", "bound", "wide", _child(F.col("cell"), [F.col(f"_c{a}") for a in AXES]).alias("cell"))
    met = at.join(below, [group, "cell"]).withColumn("gap", _length([_gap(a) for a in AXES])).filter("gap <= bound")
    # A child that holds another point has one no farther than its farthest corner.
    other = F.when((F.col("n") > 1) | (F.col("gap") > 0), _length([_reach(a) for a in AXES]))
    met = met.select(group, "id", *AXES, "leaf", "bound", "wide", "cell", "k", "gap", F.when(F.col("wide"), other).alias("far"))
    per_ball = Window.partitionBy(group, "id")
    narrow = met.filter("wide").withColumn("bound", F.least("bound", F.min("far").over(per_ball))).filter("gap <= bound")
    return met.filter("not wide").unionByName(narrow).drop("gap", "far")


def _own_leaf(group: str):
    """Bound and nearest point inside the leaf, for rows sorted by leaf and id: whole leaves at a time, a few hundred points each."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        edges = np.concatenate([[0], starts(rows), [rows.num_rows]])
        place = np.stack([rows[a].to_numpy() for a in AXES])
        least, who = np.full(rows.num_rows, np.inf), np.full(rows.num_rows, -1, np.int64)
        with np.errstate(over="ignore", invalid="ignore"):
            for a, b in zip(edges[:-1], edges[1:]):
                if b - a > 1:
                    x, y, z = (p[a:b, None] - p[None, a:b] for p in place)
                    d = np.sqrt(x * x + y * y + z * z)
                    np.fill_diagonal(d, np.nan)
                    # The first of equal ones has the least id.
                    who[a:b] = np.nanargmin(d, axis=1) + a
                    least[a:b] = d[np.arange(b - a), who[a:b] - a]
        nn = rows["id"].combine_chunks().take(pa.array(who, pa.int64(), mask=who < 0))
        out = rows.append_column("bound", pa.array(least)).append_column("nn", nn)
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in out.columns], names=out.column_names)

    def starts(rows: pa.Table) -> np.ndarray:
        """Where a leaf other than the row before begins."""
        cell, name = rows["cell"].to_numpy(), rows[group].combine_chunks()
        if len(cell) < 2:
            return np.empty(0, np.int64)
        return np.flatnonzero((cell[1:] != cell[:-1]) | pc.not_equal(name[1:], name[:-1]).to_numpy(zero_copy_only=False)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            at = starts(held.combine_chunks())
            if len(at):
                yield solve(held.slice(0, at[-1]))
                held = held.slice(at[-1])
        if held is not None and held.num_rows:
            yield solve(held)

    return run


def nearest(points: DataFrame, group: str = "chunk", leaf: int = LEAF) -> DataFrame:
    """(group, id, distance, nn): the nearest other point of the group; equal distances go to the least id.

    ``points`` are (group, id, x, y, z) with ids of any ordered type, unique in a group,
    at distinct finite places; rows of a null group are left out. A group's only point has no row. Exact: boxes and
    distances are rounded by the same operations, which keep order. Runs jobs.
    """
    levels, placed = build(points.filter(F.col(group).isNotNull()), group, leaf)
    tasks = int(levels[0].agg(F.sum("n")).first()[0] or 0) // POINTS_PER_TASK + 1
    dealt = placed.repartition(tasks, group, "cell").sortWithinPartitions(group, "cell", "id")
    more = [StructField("bound", DoubleType()), StructField("nn", points.schema["id"].dataType)]
    own = stored(dealt.mapInArrow(_own_leaf(group), StructType([*dealt.schema.fields, *more])))
    best = own.filter("nn IS NOT NULL").select(group, "id", F.struct(F.col("bound").alias("distance"), "nn").alias("best"))
    if len(levels) == 1:
        return best.select(group, "id", "best.*")
    balls = own.select(
        group, "id", *AXES, F.col("cell").alias("leaf"), "bound", F.isnull("nn").alias("wide"), F.lit(ROOT).cast("long").alias("cell"))
    hits = []
    for above, below in zip(levels, levels[1:]):
        reached = stored(_down(balls, above, below, group).repartition(tasks))
        hits.append(reached.filter("k = 0 AND cell <> leaf"))
        balls = reached.filter("k > 0").drop("k")
    found = hits[0]
    for h in hits[1:]:
        found = found.unionByName(h)
    others = placed.select(group, "cell", F.col("id").alias("nn"), *[F.col(a).alias(f"o{a}") for a in AXES])
    d = distance(*[F.col(a) for a in AXES], *[F.col(f"o{a}") for a in AXES])
    near = found.join(others, [group, "cell"]).withColumn("distance", d).filter("distance <= bound")
    both = best.unionByName(near.select(group, "id", F.struct("distance", "nn").alias("best")))
    return both.groupBy(group, "id").agg(F.min("best").alias("best")).select(group, "id", "best.*")
