"""Artefact writers.

A document that would nest an unbounded list (files of a site, records of an
inventory, hashes of a transect) is written as a header folder plus a rows
folder of JSON lines, so no list passes through one task. ``null`` fields are
kept in JSON, as readers of the artefacts expect. Provenance, inventory, run manifest
and extents, which are written again while others read them, are published as versions
(see :mod:`.snapshots`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.manifest import input_set_hashes
from ..profile import ReconstructionProfile
from .snapshots import current, publish


def write_json(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    writer = df.write.mode("overwrite").option("ignoreNullFields", "false")
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def _iso(ts):
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def write_provenance(records: DataFrame, path: str, doi: str, host: str = "") -> None:
    """``header`` (one document per site) and ``files`` (rows, partitioned by site)."""
    header = records.groupBy("site").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("size_bytes").alias("total_bytes"),
        _iso(F.max("downloaded_at_utc")).alias("downloaded_at_utc"),
    ).withColumns({"schema": F.lit("transectra/acquisition/v1"), "doi": F.lit(doi), "hostname": F.lit(host)})
    rows = records.withColumn("downloaded_at_utc", _iso(F.col("downloaded_at_utc")))

    def write(folder: str) -> None:
        write_json(header, f"{folder}/header")
        write_json(rows, f"{folder}/files", ["site"])

    publish(records.sparkSession, path, write)


def read_provenance_rows(spark, path: str) -> DataFrame:
    """(name, sha256) back from what ``write_provenance`` wrote."""
    return spark.read.schema("name string, sha256 string").json(f"{current(spark, path)}/files")


def write_inventory(inventory: DataFrame, path: str, partition_by: list[str] = ()) -> str:
    """``inventory`` (Parquet, for jobs) and ``header`` (JSON: schema id and count) as one version, whose folder is returned."""

    def write(folder: str) -> None:
        writer = inventory.write
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{folder}/inventory")
        stored = inventory.sparkSession.read.parquet(f"{folder}/inventory")
        header = stored.agg(F.count(F.lit(1)).alias("count")).withColumn("schema", F.lit("transectra/inventory/v1"))
        write_json(header, f"{folder}/header")

    return publish(inventory.sparkSession, path, write)


def read_inventory(spark, path: str) -> DataFrame:
    """The inventory that ``write_inventory`` published last."""
    return spark.read.parquet(f"{current(spark, path)}/inventory")


def write_inventory_json(inventory: DataFrame, path: str) -> None:
    write_json(inventory, path)


def write_report(headers: DataFrame, failed: DataFrame, warned: DataFrame, path: str) -> None:
    """Report documents per site beside the two file lists; the findings table is written before."""
    write_json(failed, f"{path}/files_with_failures")
    write_json(warned, f"{path}/files_with_warnings")
    write_json(headers, f"{path}/qc_report")


def write_manifest_csv(manifest: DataFrame, path: str) -> None:
    manifest.select("url", "name", "size").write.mode("overwrite").csv(path, header=True)


def write_input_hashes(images: DataFrame, path: str) -> None:
    """Per transect: count and aggregate hash (``header``) and the hash of every image (``images``)."""
    write_json(input_set_hashes(images).withColumnRenamed("label", "transect"), f"{path}/header")
    write_json(images.select(F.col("label").alias("transect"), "name", "sha256"), f"{path}/images", ["transect"])


def write_run_manifest(chunks: DataFrame, path: str) -> None:
    publish(chunks.sparkSession, path, lambda folder: write_json(chunks, folder))


def decision_documents(decided: DataFrame, profile: ReconstructionProfile = ReconstructionProfile()) -> DataFrame:
    """One nested decision document per experiment."""
    arm = lambda a: F.struct(F.col(f"{a}_rms").alias("rms"), F.col(f"{a}_pct").alias("aligned_pct"))
    return decided.select(
        "experiment",
        F.lit("focal_length_decision").alias("artifact_type"),
        F.lit(1).alias("schema_version"),
        F.struct(
            F.lit("residual RMS, lower is better").alias("primary"),
            F.lit("aligned_pct, higher is better").alias("tiebreak"),
            F.lit(profile.rms_margin).alias("rms_margin"),
            F.lit(profile.align_margin_pct).alias("align_margin_pct"),
        ).alias("criterion"),
        F.struct(arm("fallback").alias("fallback"), arm("manual").alias("manual")).alias("arms"),
        F.struct("verdict", "chosen_arm", "rationale").alias("decision"),
    )


def write_decisions(decided: DataFrame, path: str) -> None:
    write_json(decision_documents(decided), path)


def merge_extents(snapshots: DataFrame) -> DataFrame:
    """Latest extent per chunk and snapshot key, side by side as ``pre`` and ``post``.

    ``snapshots`` are extent rows with ``snapshot`` and ``ts`` appended over time.
    """
    facts = [c for c in snapshots.columns if c not in ("chunk", "snapshot", "ts")]
    return snapshots.groupBy("chunk").pivot("snapshot", ["pre", "post"]).agg(F.max_by(F.struct(*facts), F.col("ts")))


def write_extents(snapshots: DataFrame, path: str) -> None:
    publish(snapshots.sparkSession, path, lambda folder: write_json(merge_extents(snapshots), folder))


def write_cameras(cameras: DataFrame, path: str) -> None:
    write_json(cameras.select("chunk", "label", "enabled", "aligned"), path, ["chunk"])


def write_scalebars(scalebars: DataFrame, path: str) -> None:
    write_json(scalebars.select("chunk", "label", "defined_distance_m", "accuracy_m"), path, ["chunk"])


def write_arm_results(arms: DataFrame, path: str) -> None:
    write_json(arms, path)
