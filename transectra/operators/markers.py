"""Marker pairing by mutual nearest neighbours. Markers: ``chunk, pos, label, x, y, z``.

A chunk may hold very many markers, and many at one position, so neighbours are
found through a tree of cells instead of by comparing all pairs.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_percentiles
from ..joins import join_group_facts
from ..session import durable, stored
from . import octree

_LARGEST = sys.float_info.max

def reconstructed(markers: DataFrame) -> DataFrame:
    return markers.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())


def nearest_neighbours(markers: DataFrame) -> DataFrame:
    """Nearest other marker per reconstructed marker; equal distances go to the lowest ``pos``.

    Exact. Markers at the same position pair at distance zero without meeting each
    other; of the rest, one per position goes through the tree of :mod:`.octree`.
    Markers with a coordinate that is no finite number have no neighbour. Runs jobs.
    """
    finite = [F.col(a).between(-_LARGEST, _LARGEST) for a in "xyz"]
    pts = reconstructed(markers).select(
        "chunk", F.struct("pos", "label").alias("id"), *[F.col(a).cast("double").alias(a) for a in "xyz"]
    ).filter(finite[0] & finite[1] & finite[2])
    at = ["chunk", "x", "y", "z"]
    # The two least ids of a position: the least, and the least of all but that.
    w = Window.partitionBy(*at).orderBy("id")
    ranked = pts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 2)
    spots = stored(ranked.groupBy(*at).agg(
        F.min(F.when(F.col("_r") == 1, F.col("id"))).alias("id"),
        F.min(F.when(F.col("_r") == 2, F.col("id"))).alias("second"),
    ))
    shared_spots = spots.filter(F.col("second").isNotNull()).withColumnRenamed("id", "first")
    copies = join_group_facts(pts, shared_spots, at).select(
        "chunk", "id", F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("nn"),
        F.lit(0.0).alias("distance"),
    )
    singles = spots.filter(F.col("second").isNull()).select("chunk", "id")
    found = octree.nearest(spots.drop("second")).join(singles, ["chunk", "id"], "left_semi")
    return copies.unionByName(found).select(
        "chunk", F.col("id.pos").alias("pos"), F.col("id.label").alias("label"),
        F.col("nn.pos").alias("nn_pos"), F.col("nn.label").alias("nn_label"), "distance",
    )


def mutual_pairs(neighbours: DataFrame) -> DataFrame:
    """Pairs that are each other's nearest, once each, with the length flag.

    ``is_outlier`` marks lengths outside 0.6 to 1.4 times the chunk's median pair length.
    """
    back = neighbours.select(
        "chunk", F.col("pos").alias("nn_pos"), F.col("nn_pos").alias("pos")
    )
    pairs = neighbours.filter(F.col("pos") < F.col("nn_pos")).join(back, ["chunk", "pos", "nn_pos"])
    pairs = pairs.select(
        "chunk", F.col("pos").alias("a_pos"), F.col("label").alias("a_label"), F.col("nn_pos").alias("b_pos"),
        F.col("nn_label").alias("b_label"), "distance",
    )
    median = exact_percentiles(pairs, ["chunk"], F.col("distance"), {"median_distance": 0.5})
    m, d = F.col("median_distance"), F.col("distance")
    return join_group_facts(pairs, median, ["chunk"]).withColumn("is_outlier", ~d.between(F.lit(0.6) * m, F.lit(1.4) * m))


def paired_labels(pairs: DataFrame) -> DataFrame:
    sides = F.array(F.struct(F.col("a_pos").alias("pos"), F.col("a_label").alias("label")),
                    F.struct(F.col("b_pos").alias("pos"), F.col("b_label").alias("label")))
    return pairs.select("chunk", F.explode(sides).alias("m")).select("chunk", "m.*").distinct()


def orphans(markers: DataFrame, pairs: DataFrame) -> DataFrame:
    """Markers in no mutual pair, and markers that were not reconstructed."""
    return markers.join(paired_labels(pairs).select("chunk", "pos"), ["chunk", "pos"], "left_anti").select(
        "chunk", "pos", "label"
    )


def marker_report(markers: DataFrame) -> DataFrame:
    """Every marker with its state: reconstructed, nearest neighbour, paired or orphan, pair length flag.

    The neighbour table is checkpointed (runs a job): three later steps read it.
    """
    nn = durable(nearest_neighbours(markers))
    pairs = mutual_pairs(nn)
    sides = F.array(
        F.struct(F.col("a_pos").alias("pos"), F.col("b_label").alias("partner")),
        F.struct(F.col("b_pos").alias("pos"), F.col("a_label").alias("partner")),
    )
    partners = pairs.select("chunk", "is_outlier", F.explode(sides).alias("s")).select("chunk", "s.*", "is_outlier")
    return (
        markers.withColumn("is_reconstructed", F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
        .join(nn.select("chunk", "pos", "nn_label", "distance"), ["chunk", "pos"], "left")
        .join(partners, ["chunk", "pos"], "left")
        .withColumn("is_orphan", F.col("partner").isNull())
    )


def fact_counts(markers: DataFrame, scalebars: DataFrame) -> DataFrame:
    """Marker and scale-bar counts per chunk; a chunk seen on one side only counts zero on the other."""
    both = markers.select("chunk", F.lit(1).alias("m"), F.lit(0).alias("s")).unionByName(
        scalebars.select("chunk", F.lit(0).alias("m"), F.lit(1).alias("s"))
    )
    return both.groupBy("chunk").agg(F.sum("m").alias("markers"), F.sum("s").alias("scalebars"))
