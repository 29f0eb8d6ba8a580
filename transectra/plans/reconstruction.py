"""Stage facts from the tables a reconstruction tool exports.

Each function reduces big tables to stage records ``(chunk, stage, ts, payload)``
ready to append to the ``stage_stats`` table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.manifest import carry_scale
from ..operators.points import elevation_grid, grid_summary, noise_report
from ..operators.quality import alignment_rates, quality_stats
from ..profile import ReconstructionProfile

_DEFAULTS = ReconstructionProfile()


def as_stage_rows(facts: DataFrame, stage: str) -> DataFrame:
    fields = [c for c in facts.columns if c != "chunk"]
    payload = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return facts.select("chunk", F.lit(stage).alias("stage"), F.current_timestamp().alias("ts"), payload.alias("payload"))


def step4_record(cameras: DataFrame, profile: ReconstructionProfile = _DEFAULTS) -> DataFrame:
    return as_stage_rows(quality_stats(cameras, profile.image_quality_threshold), "step4")


def align_record(cameras: DataFrame) -> DataFrame:
    return as_stage_rows(alignment_rates(cameras), "align")


def _for_chunks(chunks: DataFrame | None, facts: DataFrame, absent: dict) -> DataFrame:
    """A row for every chunk of ``chunks``, with the ``absent`` values where ``facts`` has none."""
    if chunks is None:
        return facts
    return chunks.select("chunk").distinct().join(facts, "chunk", "left").fillna(absent)


def import_record(cameras: DataFrame) -> DataFrame:
    return as_stage_rows(cameras.groupBy("chunk").agg(F.count(F.lit(1)).alias("cameras_total")), "import")


def markers_record(markers: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Markers per chunk; those with a position count as detected."""
    facts = markers.groupBy("chunk").agg(F.count(F.lit(1)).alias("markers_total"), F.count("x").alias("markers_detected"))
    return as_stage_rows(_for_chunks(chunks, facts, {"markers_total": 0, "markers_detected": 0}), "markers")


def reduce_record(scalebars: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Scale bars per chunk that stand when tie points are reduced."""
    facts = scalebars.groupBy("chunk").agg(F.count(F.lit(1)).alias("scalebars_present"))
    return as_stage_rows(_for_chunks(chunks, facts, {"scalebars_present": 0}), "reduce")


def dense_record(transforms: DataFrame, cloud: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Scale of each chunk's transform (chunk, transform_scale; null: not scaled) and its number of points."""
    points = cloud.groupBy("chunk").agg(F.count(F.lit(1)).alias("dense_points"))
    scale = transforms.groupBy("chunk").agg(F.max("transform_scale").alias("transform_scale"))
    facts = scale.join(points, "chunk", "full").fillna({"dense_points": 0})
    return as_stage_rows(_for_chunks(chunks, facts, {"dense_points": 0}), "dense")


def filter_record(
    cloud: DataFrame, profile: ReconstructionProfile = _DEFAULTS, chunks: DataFrame | None = None
) -> DataFrame:
    """Noise facts of each chunk's cloud; a chunk of ``chunks`` without any point has no cloud."""
    facts = noise_report(cloud, profile.noise_confidence_threshold).withColumn("has_cloud", F.lit(True))
    return as_stage_rows(_for_chunks(chunks, facts, {"has_cloud": False}), "filter")


def dsm_record(cloud: DataFrame, scale: DataFrame, profile: ReconstructionProfile = _DEFAULTS) -> DataFrame:
    facts = grid_summary(elevation_grid(cloud, profile.dsm_resolution_m))
    return as_stage_rows(carry_scale(facts, scale), "dsm")


def ortho_record(products: DataFrame, elevation: str = "dsm", chunks: DataFrame | None = None) -> DataFrame:
    """Products per chunk (chunk, product) and whether the elevation product is among them."""
    facts = products.groupBy("chunk").agg(
        F.count(F.lit(1)).alias("products"), F.coalesce(F.bool_or(F.col("product") == elevation), F.lit(False)).alias("has_elevation"))
    return as_stage_rows(_for_chunks(chunks, facts, {"products": 0, "has_elevation": False}), "ortho")


# Payload fields the alarm rules read.
STAGE_FACTS = (
    "disabled bigint, alignment_rate double, markers_detected bigint, scalebars_present bigint, "
    "transform_scale double, has_cloud boolean, cells bigint, has_elevation boolean"
)


def typed_stages(stage_stats: DataFrame) -> DataFrame:
    """Stage records with their payload parsed into the columns ``alarms`` reads."""
    return stage_stats.select("chunk", "stage", F.from_json("payload", STAGE_FACTS).alias("p")).select("chunk", "stage", "p.*")
