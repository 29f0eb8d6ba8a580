"""Inventory assembly: one typed row per image with its three side tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from ..sources.tables import XMP_FIELDS

CSV_FIELDS = (
    "image_id", "csv_dtoriginal_utc", "csv_cammake", "csv_cammodel", "csv_artist", "csv_copyright",
    "csv_lat", "csv_lon", "csv_uuid",
)
# Inventory columns in artefact order.
INVENTORY_FIELDS = (
    "name", "relpath", "size_bytes", "sha256", "width", "height", "exif_make", "exif_model", "exif_artist",
    "exif_copyright", "exif_image_description", "exif_datetime_original", "gps_lat", "gps_lon",
    "xmp_attribution_url", "xmp_external_metadata_link", "xmp_usage_terms", "iptc_credit", "iptc_contact",
    "software", "orientation", "csv_matched", *CSV_FIELDS, "read_errors",
)


def reuse_hashes(files: DataFrame, known: DataFrame) -> DataFrame:
    """A non-empty known hash (name, sha256) replaces the file's own; exact name match."""
    known = known.groupBy("name").agg(F.max("sha256").alias("_known"))
    joined = files.join(known, "name", "left")
    return joined.withColumn("sha256", F.coalesce(blank_to_null(F.col("_known")), F.col("sha256"))).drop("_known")


def attach_metadata(files: DataFrame, records: DataFrame | None) -> DataFrame:
    """Join metadata records by lower-cased name; adds ``csv_matched`` and the CSV fields."""
    if records is None:
        typed = {"image_id": "bigint", "csv_lat": "double", "csv_lon": "double"}
        empty = {c: F.lit(None).cast(typed.get(c, "string")) for c in CSV_FIELDS}
        return files.withColumns({"csv_matched": F.lit(False), **empty})
    right = records.select("key", *CSV_FIELDS)
    joined = files.join(right, F.lower(files["name"]) == right["key"], "left")
    return joined.withColumn("csv_matched", F.col("key").isNotNull()).drop("key")


def attach_xmp(files: DataFrame, xmp: DataFrame | None) -> DataFrame:
    """Join tag-tool fields by exact name; without an export every field is null."""
    if xmp is None:
        return files.withColumns({c: F.lit(None).cast("string") for c in XMP_FIELDS})
    return files.join(xmp.select("name", *XMP_FIELDS), "name", "left")


def assemble_inventory(
    files: DataFrame,
    records: DataFrame | None = None,
    xmp: DataFrame | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """Files + hashes + metadata + XMP. Spark broadcasts a side only when its size allows."""
    out = reuse_hashes(files, known) if known is not None else files
    out = attach_xmp(attach_metadata(out, records), xmp)
    lead = ["site"] if "site" in out.columns else []
    return out.select(*lead, *INVENTORY_FIELDS)


def head(inventory: DataFrame, n: int = 10) -> DataFrame:
    """First rows by name with the columns people look at."""
    cols = ("name", "width", "height", "exif_make", "exif_model", "exif_datetime_original", "gps_lat", "gps_lon",
            "size_bytes")
    return inventory.select(*cols).orderBy("name").limit(n)
