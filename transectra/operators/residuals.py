"""Reprojection residuals. Projections: ``chunk, camera, track_id, ex, ey``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import envelope
from ..profile import ReconstructionProfile


def projection_residuals(projections: DataFrame, cameras: DataFrame, points: DataFrame) -> DataFrame:
    """Residual sums per chunk over aligned cameras and valid points.

    Projections meet points on (chunk, track); the result is summed per camera
    before the camera table joins, so a camera with very many projections costs
    one row there.
    """
    valid = points.filter("valid").select("chunk", "track_id")
    squared = F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey")
    per_camera = projections.join(valid, ["chunk", "track_id"]).groupBy("chunk", "camera").agg(
        F.sum(squared).alias("sse"), F.count(F.lit(1)).alias("n")
    )
    aligned = cameras.filter("aligned").select("chunk", F.col("label").alias("camera"))
    return per_camera.join(aligned, ["chunk", "camera"])


def residual_rms(
    projections: DataFrame, cameras: DataFrame, points: DataFrame, profile: ReconstructionProfile = ReconstructionProfile()
) -> DataFrame:
    """Per chunk: RMS in pixels, projections used, label against the published envelope."""
    sums = projection_residuals(projections, cameras, points).groupBy("chunk").agg(
        F.sum("sse").alias("sse"), F.sum("n").alias("projections_used")
    )
    rms = F.sqrt(F.col("sse") / F.col("projections_used"))
    return sums.select("chunk", rms.alias("rms"), "projections_used").withColumn(
        "envelope", envelope(F.col("rms"), profile.rms_envelope_lo, profile.rms_envelope_hi)
    )


def filter_unit_rms(points: DataFrame, valid_only: bool = False) -> DataFrame:
    """Per chunk RMS of per-point reprojection errors ``re``; null when there is none."""
    rows = points.filter("valid") if valid_only else points
    return rows.groupBy("chunk").agg(
        F.sqrt(F.avg(F.col("re") * F.col("re"))).alias("rms"), F.count("re").alias("residuals")
    )


def reduction_record(tagged: DataFrame, scalebars: DataFrame) -> DataFrame:
    """RMS before and after point reduction, beside the scale-bar count.

    ``tagged`` is the output of ``gradual_selection``: ``step`` is null for points kept.
    """
    e2 = F.col("re") * F.col("re")
    rms = tagged.groupBy("chunk").agg(
        F.sqrt(F.avg(e2)).alias("rms_pre"), F.sqrt(F.avg(F.when(F.col("step").isNull(), e2))).alias("rms_post")
    )
    bars = scalebars.groupBy("chunk").agg(F.count(F.lit(1)).alias("scalebars_present"))
    return rms.join(bars, "chunk", "left").fillna(0, subset=["scalebars_present"])
