"""Image-quality filter, alignment rates and threshold comparison over camera tables.

Cameras: ``chunk, label, quality_raw, enabled, aligned``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import quality_band, quality_score
from ..functions.quantiles import exact_percentiles
from ..session import stored
from ..profile import ReconstructionProfile

_DEFAULTS = ReconstructionProfile()


def below(threshold: Column | float) -> Column:
    """True only for a known score under the threshold; a missing score is never blurred."""
    return F.coalesce(quality_score(F.col("quality_raw")) < threshold, F.lit(False))


def disable_low_quality(cameras: DataFrame, threshold: float = _DEFAULTS.image_quality_threshold) -> DataFrame:
    return cameras.withColumn("enabled", F.col("enabled") & ~below(threshold))


def quality_stats(cameras: DataFrame, threshold: float = _DEFAULTS.image_quality_threshold) -> DataFrame:
    """Per chunk: analysed, scored, unscored and disabled counts, min, max, exact median. Scores are parsed once and stored."""
    scored = stored(cameras.select("chunk", quality_score(F.col("quality_raw")).alias("q")))
    counts = scored.groupBy("chunk").agg(
        F.count(F.lit(1)).alias("analyzed"),
        F.count("q").alias("with_quality"),
        F.count_if(F.col("q").isNull()).alias("no_metadata"),
        F.count_if(F.col("q") < threshold).alias("disabled"),
        F.lit(threshold).alias("threshold"),
        F.min("q").alias("min_quality"),
        F.max("q").alias("max_quality"),
    )
    return counts.join(exact_percentiles(scored, ["chunk"], F.col("q"), {"median_quality": 0.5}), "chunk", "left")


def alignment_rates(cameras: DataFrame) -> DataFrame:
    """Per chunk: totals and rates; with no enabled camera the stage rate is 0 and the report rate null."""
    counted = cameras.groupBy("chunk").agg(
        F.count(F.lit(1)).alias("cameras_total"),
        F.count_if("enabled").alias("cameras_enabled"),
        F.count_if("aligned").alias("cameras_aligned"),
    )
    rate = F.try_divide(F.col("cameras_aligned").cast("double"), F.col("cameras_enabled").cast("double"))
    of_total = F.try_divide(F.col("cameras_aligned").cast("double"), F.col("cameras_total").cast("double"))
    return counted.withColumns({
        "alignment_rate": F.coalesce(rate, F.lit(0.0)),
        "report_alignment_rate": rate,
        "rate_of_total": of_total,
    })


def compare_arms(cameras: DataFrame, arms=_DEFAULTS.ab_arms, keys: list[str] = ("chunk",)) -> DataFrame:
    """One row per arm: disabled, enabled, aligned and both rates.

    ``cameras`` carries one ``aligned_<arm>`` column per arm. All arms come from
    one aggregation; the rows are stacked afterwards.
    """
    aggs = [F.count(F.lit(1)).alias("_n")]
    for arm, threshold in arms:
        aggs += [
            F.count_if(below(threshold)).alias(f"_d_{arm}"),
            F.count_if(F.col("enabled") & ~below(threshold)).alias(f"_e_{arm}"),
            F.count_if(f"aligned_{arm}").alias(f"_a_{arm}"),
        ]
    wide = cameras.groupBy(*keys).agg(*aggs)
    rows = F.array(*[
        F.struct(
            F.lit(arm).alias("arm"), F.lit(threshold).alias("threshold"), F.col(f"_d_{arm}").alias("disabled"),
            F.col(f"_e_{arm}").alias("enabled"), F.col(f"_a_{arm}").alias("aligned"),
        )
        for arm, threshold in arms
    ])
    out = wide.select(*keys, "_n", F.explode(rows).alias("r")).select(*keys, "_n", "r.*")
    share = lambda n, d: F.try_divide(F.col(n).cast("double"), F.col(d).cast("double"))
    return out.withColumns({
        "align_rate_of_enabled": share("aligned", "enabled"), "align_rate_of_total": share("aligned", "_n"),
    }).drop("_n")


def arm_results(arms: DataFrame, tie_points: DataFrame, runs: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Results of :func:`compare_arms` with what each arm's reconstruction gave: tie points, region size per axis, minutes.

    ``tie_points`` are (chunk, arm, x, y, z), ``runs`` (chunk, arm, seconds; stages add up), ``regions`` (chunk, arm,
    size_x, size_y, size_z); without it a region is the extent of the arm's points. Points are read once, in a hash
    aggregation; an arm without points has 0 of them and no region.
    """
    keys = ["chunk", "arm"]
    span = [(F.max(a) - F.min(a)).alias(f"size_{a}") for a in "xyz"] if regions is None else []
    found = tie_points.groupBy(*keys).agg(F.count(F.lit(1)).alias("tie_points"), *span)
    spent = runs.groupBy(*keys).agg(F.round(F.sum("seconds") / 60, 1).alias("minutes"))
    out = arms.join(found, keys, "left").join(spent, keys, "left")
    if regions is not None:
        out = out.join(regions.select(*keys, *[f"size_{a}" for a in "xyz"]), keys, "left")
    sizes = {f"region_{a}": F.round(f"size_{a}", 4) for a in "xyz"}
    return out.withColumns({"tie_points": F.coalesce("tie_points", F.lit(0)), **sizes}).select(
        *arms.columns, "tie_points", *sizes, "minutes")


def band_breakdown(cameras: DataFrame, alignment: DataFrame, bands=_DEFAULTS.quality_bands) -> DataFrame:
    """Registration by arm and quality band; ``alignment`` is (chunk, arm, label, aligned)."""
    scored = cameras.select("chunk", "label", quality_band(quality_score(F.col("quality_raw")), *bands).alias("band"))
    joined = alignment.join(scored, ["chunk", "label"]).filter(F.col("band").isNotNull())
    out = joined.groupBy("chunk", "arm", "band").agg(
        F.count(F.lit(1)).alias("cameras"), F.count_if("aligned").alias("aligned")
    )
    return out.withColumn("rate", F.col("aligned").cast("double") / F.col("cameras").cast("double"))
