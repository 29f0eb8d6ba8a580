"""Telemetry summary, the same for batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..profile import ReconstructionProfile

_DEFAULTS = ReconstructionProfile()


def summarize(samples: DataFrame) -> DataFrame:
    """Per host: peaks (never below zero), means, last reported total, sample count."""
    peak = lambda c: F.greatest(F.max(c), F.lit(0.0))
    return samples.groupBy("host").agg(
        peak("util_pct").alias("peak_util"),
        F.avg("util_pct").alias("mean_util"),
        peak("mem_used_mb").alias("peak_mem"),
        F.max_by("mem_total_mb", "pos").alias("mem_total"),
        peak("swap_used_mb").alias("peak_swap"),
        F.count(F.lit(1)).alias("samples"),
    )


def _mem_pct():
    pct = F.lit(100.0) * F.col("peak_mem") / F.when(F.col("mem_total") > 0, F.col("mem_total"))
    return F.coalesce(pct, F.lit(0.0))


def gpu_hints(summary: DataFrame, profile: ReconstructionProfile = _DEFAULTS) -> DataFrame:
    load = (
        F.when(F.col("mean_util") >= profile.gpu_bound_mean_pct, "bound")
        .when(F.col("peak_util") < profile.gpu_light_peak_pct, "light")
        .otherwise("normal")
    )
    return summary.withColumns({
        "mem_pct": _mem_pct(), "near_capacity": _mem_pct() >= profile.vram_warn_pct, "gpu_load": load,
    })


def cpu_hints(summary: DataFrame, profile: ReconstructionProfile = _DEFAULTS) -> DataFrame:
    return summary.withColumns({
        "mem_pct": _mem_pct(), "near_capacity": _mem_pct() >= profile.ram_warn_pct,
        "swapping": F.col("peak_swap") >= profile.swap_warn_mb,
    })
