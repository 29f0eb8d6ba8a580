"""Point tables: filters, sweeps, extents, grids. One pass over the points each.

Dense cloud: ``chunk, x, y, z, confidence, cls``. Tie points: ``chunk, track_id,
ru, pa, re`` (reconstruction uncertainty, projection accuracy, reprojection error).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..joins import join_group_facts
from ..profile import ReconstructionProfile

_DEFAULTS = ReconstructionProfile()


def gradual_selection(points: DataFrame, profile: ReconstructionProfile = _DEFAULTS) -> DataFrame:
    """Tag every tie point with the first of three criteria that removes it; null means kept."""
    step = (
        F.when(F.col("ru") > profile.reconstruction_uncertainty, "reconstruction_uncertainty")
        .when(F.col("pa") > profile.projection_accuracy, "projection_accuracy")
        .when(F.col("re") > profile.reprojection_error, "reprojection_error")
    )
    return points.withColumn("step", step)


def selection_counts(tagged: DataFrame) -> DataFrame:
    """Points removed per chunk and step, and points kept."""
    return tagged.groupBy("chunk", F.coalesce("step", F.lit("kept")).alias("step")).agg(F.count(F.lit(1)).alias("points"))


def drop_low_confidence(cloud: DataFrame, max_conf: float = _DEFAULTS.noise_confidence_threshold) -> DataFrame:
    """Remove points with confidence below the integer part of ``max_conf``."""
    return cloud.filter(F.col("confidence") >= int(max_conf))


def noise_report(cloud: DataFrame, max_conf: float = _DEFAULTS.noise_confidence_threshold) -> DataFrame:
    """Per chunk before/after/removed/fraction of the confidence filter, and a nothing-removed flag."""
    counted = cloud.groupBy("chunk").agg(
        F.count(F.lit(1)).alias("points_before"),
        F.count_if(F.col("confidence") >= int(max_conf)).alias("points_after"),
    )
    removed = F.col("points_before") - F.col("points_after")
    return counted.withColumns({
        "removed": removed,
        "removed_fraction": removed.cast("double") / F.col("points_before").cast("double"),
        "nothing_removed": removed == 0,
    })


def confidence_sweep(cloud: DataFrame, thresholds: Sequence[int] = _DEFAULTS.sweep_thresholds) -> DataFrame:
    """Effect of rising confidence thresholds, from one conditional aggregation.

    Row per chunk and threshold: bucket ``[lo, threshold)`` count and percentage,
    cumulative removed, survivors.
    """
    under = [F.count_if(F.col("confidence") < t).alias(f"_u{i}") for i, t in enumerate(thresholds)]
    wide = cloud.groupBy("chunk").agg(F.count(F.lit(1)).alias("_n"), *under)
    rows = []
    for i, t in enumerate(thresholds):
        prev = F.col(f"_u{i - 1}") if i else F.lit(0).cast("bigint")
        rows.append(F.struct(
            F.lit(thresholds[i - 1] if i else 0).alias("lo"), F.lit(t).alias("threshold"),
            (F.col(f"_u{i}") - prev).alias("in_bucket"), F.col(f"_u{i}").alias("removed"),
            (F.col("_n") - F.col(f"_u{i}")).alias("survivors"),
        ))
    out = wide.select("chunk", "_n", F.explode(F.array(*rows)).alias("r")).select("chunk", "_n", "r.*")
    pct = lambda c: F.lit(100.0) * F.col(c) / F.col("_n")
    return out.withColumns({
        "bucket_pct": pct("in_bucket"), "removed_pct": pct("removed"), "survivor_pct": pct("survivors"),
    }).drop("_n")


def class_counts(cloud: DataFrame) -> DataFrame:
    return cloud.groupBy("chunk", "cls").agg(F.count(F.lit(1)).alias("points"))


def extent(cloud: DataFrame) -> DataFrame:
    """Per chunk point count and min, max, size per axis."""
    aggs = [F.count(F.lit(1)).alias("point_count")]
    for a in "xyz":
        aggs += [F.min(a).alias(f"min_{a}"), F.max(a).alias(f"max_{a}")]
    out = cloud.groupBy("chunk").agg(*aggs)
    return out.withColumns({f"size_{a}": F.col(f"max_{a}") - F.col(f"min_{a}") for a in "xyz"})


def in_confidence(lo: int, hi: int) -> Column:
    return F.col("confidence").between(lo, hi)


def reclassify(cloud: DataFrame, source: str, target: str, lo: int = 0, hi: int = 255) -> DataFrame:
    """Move points of one class to another, optionally only inside a confidence range."""
    move = (F.col("cls") == source) & in_confidence(lo, hi)
    return cloud.withColumn("cls", F.when(move, target).otherwise(F.col("cls")))


def remove_classes(cloud: DataFrame, classes: Sequence[str], lo: int = 0, hi: int = 255) -> DataFrame:
    """Drop points of the listed classes inside a confidence range; null attributes stay."""
    drop = F.col("cls").isin(*classes) & in_confidence(lo, hi)
    return cloud.filter(~F.coalesce(drop, F.lit(False)))


def crop_confidence(cloud: DataFrame, lo: int, hi: int) -> DataFrame:
    """Remove the confidence range, ends included."""
    return cloud.filter(~F.coalesce(in_confidence(lo, hi), F.lit(False)))


def in_region(
    center: Sequence[float], size: Sequence[float], rotation: Sequence[Sequence[float]] | None = None
) -> Column:
    """Inside a box; ``rotation`` rows are the box axes in cloud coordinates."""
    d = [F.col(a) - F.lit(float(c)) for a, c in zip("xyz", center)]
    axes = rotation or ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))
    inside = F.lit(True)
    for axis, length in zip(axes, size):
        along = F.lit(0.0)
        for r, di in zip(axis, d):
            along = along + F.lit(float(r)) * di
        inside = inside & (F.abs(along) <= float(length) / 2.0)
    return inside


def select_region(cloud: DataFrame, center, size, rotation=None, invert: bool = False) -> DataFrame:
    inside = in_region(center, size, rotation)
    return cloud.filter(~inside if invert else inside)


def compare_removals(cloud: DataFrame, variants: dict[str, Column]) -> DataFrame:
    """Before, after and removed per named keep-condition, from one aggregation."""
    kept = [F.count_if(c).alias(f"_k_{name}") for name, c in variants.items()]
    wide = cloud.groupBy("chunk").agg(F.count(F.lit(1)).alias("before"), *kept)
    rows = F.array(*[F.struct(F.lit(n).alias("variant"), F.col(f"_k_{n}").alias("after")) for n in variants])
    out = wide.select("chunk", "before", F.explode(rows).alias("r")).select("chunk", "r.variant", "before", "r.after")
    return out.withColumn("removed", F.col("before") - F.col("after"))


def removal_variants(threshold: int) -> dict[str, Column]:
    """Keep-conditions of the compared ways to remove low-confidence points."""
    c = F.col("confidence")
    return {
        "remove_range": ~c.between(0, threshold),
        "crop_range": ~c.between(0, threshold),
        "crop_inverse_range": ~c.between(threshold, 255),
        "remove_classes_in_range": ~c.between(0, threshold),
        "clean_below": c >= threshold,
    }


def require_some_removed(comparison: DataFrame) -> None:
    """Raise when no variant removed a point (runs a job)."""
    if comparison.filter(F.col("removed") > 0).isEmpty():
        raise RuntimeError("every removal variant left the cloud unchanged")


def overview_resolution(size_x: float, size_y: float) -> float:
    """Cell edge for a quick look at an unscaled chunk: the longer side in 2000 cells."""
    return max(size_x, size_y) / 2000.0


def elevation_grid(cloud: DataFrame, resolution: float = _DEFAULTS.dsm_resolution_m) -> DataFrame:
    """Cells ``chunk, ix, iy, z_max, z_mean, n`` anchored at each chunk's lower corner."""
    corner = cloud.groupBy("chunk").agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    placed = join_group_facts(cloud, corner, ["chunk"]).select(
        "chunk",
        F.floor((F.col("x") - F.col("x0")) / F.lit(resolution)).alias("ix"),
        F.floor((F.col("y") - F.col("y0")) / F.lit(resolution)).alias("iy"),
        "z",
    )
    return placed.groupBy("chunk", "ix", "iy").agg(
        F.max("z").alias("z_max"), F.avg("z").alias("z_mean"), F.count(F.lit(1)).alias("n")
    )


def grid_summary(grid: DataFrame) -> DataFrame:
    """Per chunk: width, height, all cells, filled cells, holes."""
    out = grid.groupBy("chunk").agg(
        (F.max("ix") + 1).alias("width"), (F.max("iy") + 1).alias("height"), F.count(F.lit(1)).alias("filled")
    )
    cells = F.col("width") * F.col("height")
    return out.withColumns({"cells": cells, "holes": cells - F.col("filled")})
