"""Download planning and verification over manifest, listing and provenance tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest_coverage(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Every distinct name with flags ``expected`` and ``on_disk``; one combined aggregation."""
    flags = expected.select("name", F.lit(True).alias("e"), F.lit(False).alias("d")).unionByName(
        present.select("name", F.lit(False).alias("e"), F.lit(True).alias("d"))
    )
    return flags.groupBy("name").agg(F.bool_or("e").alias("expected"), F.bool_or("d").alias("on_disk"))


def missing_files(coverage: DataFrame, limit: int | None = None) -> DataFrame:
    out = coverage.filter(F.col("expected") & ~F.col("on_disk")).select("name").orderBy("name")
    return out.limit(limit) if limit else out


def unexpected_files(coverage: DataFrame, limit: int | None = None) -> DataFrame:
    out = coverage.filter(~F.col("expected") & F.col("on_disk")).select("name").orderBy("name")
    return out.limit(limit) if limit else out


def coverage_counts(coverage: DataFrame) -> DataFrame:
    e, d = F.col("expected"), F.col("on_disk")
    return coverage.agg(
        F.count_if(e).alias("expected"), F.count_if(d).alias("on_disk"),
        F.count_if(e & ~d).alias("missing"), F.count_if(~e & d).alias("unexpected"),
    )


def download_plan(manifest: DataFrame, listing: DataFrame, prior: DataFrame) -> DataFrame:
    """Manifest rows with what to do for each: ``resumed`` or ``download``.

    ``listing`` is what is on disk (name, size_bytes, sha256), ``prior`` the hashes
    of an earlier run (name, sha256). ``pos`` carries the manifest order.
    """
    disk = listing.groupBy("name").agg(F.max("size_bytes").alias("disk_size"), F.max("sha256").alias("disk_sha"))
    old = prior.groupBy("name").agg(F.max("sha256").alias("expected_sha"))
    joined = manifest.join(disk, "name", "left").join(old, "name", "left")
    present = F.col("disk_size").isNotNull()
    size_ok = F.col("size").isNull() | (F.col("size") == F.col("disk_size"))
    hash_ok = F.col("expected_sha").isNull() | (F.col("expected_sha") == F.col("disk_sha"))
    note = F.when(present & ~size_ok, F.concat(
        F.lit("on-disk size "), F.col("disk_size").cast("string"), F.lit(" != declared "), F.col("size").cast("string")))
    return joined.select(
        "pos", "url", "name", "size", "parent_item_id",
        F.when(present & size_ok & hash_ok, "resumed").otherwise("download").alias("action"),
        note.alias("size_note"),
    )


def in_input_order(df: DataFrame, pos: str = "pos") -> DataFrame:
    return df.orderBy(pos)


def size_mismatches(manifest: DataFrame, written: DataFrame) -> DataFrame:
    """Transferred files whose length differs from the declared size; an unknown size passes."""
    done = written.select("name", F.col("size_bytes").alias("written"))
    return manifest.filter(F.col("size").isNotNull()).join(done, "name").filter(F.col("size") != F.col("written"))


def provenance_records(plan: DataFrame, written: DataFrame, site: str) -> DataFrame:
    """Provenance rows for a finished transfer, one per manifest entry."""
    files = written.select("name", "sha256", "size_bytes")
    return plan.join(files, "name").select(
        "pos", "name", F.concat(F.lit(f"{site}/"), F.col("name")).alias("relpath"), "url", "sha256", "size_bytes",
        F.current_timestamp().alias("downloaded_at_utc"), "parent_item_id",
        F.when(F.col("action") == "resumed", "resumed").otherwise("downloaded").alias("notes"),
        F.lit(site).alias("site"),
    )


def preview(manifest: DataFrame, n: int = 5) -> DataFrame:
    """First rows of a planned download."""
    return manifest.orderBy("pos").select("name", "size").limit(n)
