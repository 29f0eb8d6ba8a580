"""Run manifest: input hashes, stage records, assembly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..profile import ReconstructionProfile

# Stages in run order.
STAGES = ("import", "step4", "align", "markers", "reduce", "dense", "filter", "dsm", "ortho")


def _chain_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Running SHA-256 per label over rows sorted by label and name; holds one batch at a time."""
    label, digest, count = object(), None, 0
    for batch in batches:
        for key, rows in batch.groupby("label", sort=False, dropna=False):
            key = None if pd.isna(key) else key
            if key != label:
                if digest is not None:
                    yield pd.DataFrame({"label": [label], "count": [count], "aggregate_sha256": [digest.hexdigest()]})
                label, digest, count = key, hashlib.sha256(), 0
            lines = "\n".join(rows["name"].fillna("") + ":" + rows["sha256"].fillna(""))
            digest.update((("\n" if count else "") + lines).encode())
            count += len(rows)
    if digest is not None:
        yield pd.DataFrame({"label": [label], "count": [count], "aggregate_sha256": [digest.hexdigest()]})


def input_set_hashes(images: DataFrame) -> DataFrame:
    """One hash per transect pinning its input set: SHA-256 of the sorted ``name:sha256`` lines.

    The hash is a chain over the sorted lines, so a transect is read in order by
    one task; the task streams them and keeps a batch, not the transect. Only
    names and hashes travel, never pixels. Images without a label are a set of their
    own under a null label; a missing hash or name is an empty text in its line. Of a
    name met twice the last by ``path`` counts, without that column the greatest hash.
    """
    last = F.max_by("sha256", "path") if "path" in images.columns else F.max("sha256")
    lines = images.groupBy("label", "name").agg(last.alias("sha256"))
    ordered = lines.select("label", "name", "sha256").repartition("label").sortWithinPartitions("label", "name")
    return ordered.mapInPandas(_chain_hashes, "label string, count bigint, aggregate_sha256 string")


def stage_columns(stage_stats: DataFrame) -> DataFrame:
    """Latest payload of every stage per chunk, one column per stage, null where missing."""
    latest = stage_stats.groupBy("chunk").pivot("stage", list(STAGES)).agg(F.max_by("payload", "ts"))
    return latest.select("chunk", *[F.col(s).alias(f"stage_{s}") for s in STAGES])


def run_chunks(facts: DataFrame, stage_stats: DataFrame, products: DataFrame) -> DataFrame:
    """Chunk facts + nine stage blobs + product files (at most one row per product name)."""
    files = products.groupBy("chunk").agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("product", F.struct("path", "bytes"))))).alias("products"))
    return facts.join(stage_columns(stage_stats), "chunk", "left").join(files, "chunk", "left")


def with_run_header(chunks: DataFrame, devices: list[str], profile: ReconstructionProfile = ReconstructionProfile(),
                    tool_version: str = "", note: str = "") -> DataFrame:
    """Repeat the run-level fields on every chunk row of the manifest table."""
    return chunks.withColumns({
        "tool_version": F.lit(tool_version),
        "generated_utc": F.current_timestamp(),
        "gpu_devices": F.array(*[F.lit(d) for d in devices]).cast("array<string>"),
        "parameters": F.lit(profile.to_json()),
        "dsm_resolution_note": F.lit(note),
    })


def pending_work(work: DataFrame, stage_stats: DataFrame) -> DataFrame:
    """(chunk, stage) entries of the work list that have no record yet."""
    done = stage_stats.select("chunk", "stage")
    return work.join(done, ["chunk", "stage"], "left_anti")


def carry_scale(stage_rows: DataFrame, scale: DataFrame) -> DataFrame:
    """Put each chunk's scale and region facts into its stage rows."""
    facts = [c for c in scale.columns if c != "chunk"]
    return stage_rows.join(scale.select("chunk", F.struct(*facts).alias("scale_info")), "chunk", "left")


def product_integrity(products: DataFrame, files: DataFrame, min_bytes: int = 1024) -> DataFrame:
    """Expected products against files found (path, length): ok when present and above ``min_bytes``."""
    found = files.groupBy("path").agg(F.max("length").alias("length"))
    return products.join(found, "path", "left").withColumn("ok", F.coalesce(F.col("length") > min_bytes, F.lit(False)))


def integrity_verdict(checked: DataFrame) -> DataFrame:
    return checked.groupBy("chunk").agg(F.every("ok").alias("all_ok"), F.count_if(~F.col("ok")).alias("failed"))


def observe_quality(chunks: DataFrame, profile: ReconstructionProfile = ReconstructionProfile()) -> DataFrame:
    """Manifest facts beside the published targets; reports, never gates."""
    pct = F.coalesce(F.try_divide(F.lit(100.0) * F.col("cameras_aligned"), F.col("cameras_total").cast("double")), F.lit(0.0))
    return chunks.select(
        F.col("label"), "cameras_aligned", "cameras_total", pct.alias("aligned_pct"), "markers", "scalebars",
        "has_dense", "has_dsm", "has_ortho",
        F.lit(profile.rms_envelope_lo).alias("rms_envelope_lo"), F.lit(profile.rms_envelope_hi).alias("rms_envelope_hi"),
        F.lit(profile.max_horizontal_mm).alias("max_horizontal_mm"),
        F.lit(profile.scalebar_target_mm).alias("scalebar_target_mm"),
    )
