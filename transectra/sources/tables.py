"""CSV and JSON exports read into typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import (
    basename, blank_to_null, csv_cell, csv_number, has_extension, has_site_code, looks_like_site, strip, tag_text,
)
from ..profile import SurveyProfile
from ..session import stored
from .documents import json_objects, read_csv_split

# Columns of the metadata export that are used.
METADATA_COLUMNS = (
    "image_id", "uuid", "preservedfilename", "cammake", "cammodel", "artist", "copyright", "dtoriginal", "lat", "lng",
)
IMAGE_LIST_COLUMNS = ("public_path", "filename", "file_size")
XMP_FIELDS = {
    "xmp_attribution_url": "AttributionURL",
    "xmp_external_metadata_link": "ExternalMetadataLink",
    "xmp_usage_terms": "UsageTerms",
    "iptc_credit": "Credit",
    "iptc_contact": "Contact",
}


def read_csv_text(spark: SparkSession, path, multi_line: bool = False, pos: str | None = None) -> DataFrame:
    """CSV with a header, every column text, cells unchanged; ``pos`` names a column that is added in row order.

    Files are split among tasks. ``multi_line`` accepts line breaks inside quotes, at the
    price of passes that find where rows begin (runs jobs).
    """
    if multi_line:
        rows = read_csv_split(spark, path)
        return rows.withColumnRenamed("_pos", pos) if pos else rows.drop("_pos")
    rows = spark.read.csv(
        path, header=True, inferSchema=False, quote='"', escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, nullValue="\u0000", emptyValue="",
    )
    return rows.withColumn(pos, line_order()) if pos else rows


def read_json_objects(spark: SparkSession, path, schema: str, depth: int = 0, pos: str | None = None) -> DataFrame:
    """Objects of JSON documents of any layout (see :func:`.documents.json_objects`) by ``schema``; a document is split among tasks."""
    rows = json_objects(spark, path, depth)
    order = [F.struct("file", "record").alias(pos)] if pos else []
    return rows.select(F.from_json("text", schema).alias("_o"), *order).select("_o.*", *([pos] if pos else []))


def require_columns(df: DataFrame, names, what: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns {missing}; found {df.columns}")
    return df


def line_order() -> Column:
    """Row position in a file scan: file, block in the file, row in the block."""
    return F.struct(
        F.col("_metadata.file_path").alias("f"),
        F.col("_metadata.file_block_start").alias("b"),
        F.monotonically_increasing_id().alias("r"),
    )


def last_row_per_key(df: DataFrame, key: str, pos: str) -> DataFrame:
    """Keep the last row of each key by ``pos``; combines map-side, so a hot key is cheap."""
    rest = [c for c in df.columns if c not in (key, pos)]
    kept = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(pos)).alias("_row"))
    return kept.select(key, "_row.*")


def metadata_records(raw: DataFrame, pos: str = "pos") -> DataFrame:
    """Metadata rows keyed by lower-cased file name, the last duplicate winning.

    ``raw`` has the ten used columns as text and a position column.
    """
    require_columns(raw, (*METADATA_COLUMNS, pos), "metadata export")
    name = csv_cell(F.col("preservedfilename"))
    number = strip(F.col("image_id")).try_cast("bigint")
    checked = F.when(number.isNull(), F.raise_error(F.concat(F.lit("bad image_id: "), F.col("image_id")))).otherwise(number)
    rows = raw.filter(name.isNotNull()).select(
        F.lower(name).alias("key"),
        F.col(pos),
        checked.alias("image_id"),
        F.coalesce(csv_cell(F.col("uuid")), F.lit("")).alias("csv_uuid"),
        csv_cell(F.col("cammake")).alias("csv_cammake"),
        csv_cell(F.col("cammodel")).alias("csv_cammodel"),
        csv_cell(F.col("artist")).alias("csv_artist"),
        csv_cell(F.col("copyright")).alias("csv_copyright"),
        csv_cell(F.col("dtoriginal")).alias("csv_dtoriginal_utc"),
        csv_number(F.col("lat")).alias("csv_lat"),
        csv_number(F.col("lng")).alias("csv_lon"),
    )
    return last_row_per_key(rows, "key", pos)


def read_metadata_csv(spark: SparkSession, path, multi_line: bool = False) -> DataFrame:
    raw = require_columns(read_csv_text(spark, path, multi_line, "pos"), METADATA_COLUMNS, "metadata export")
    return metadata_records(raw.select(*METADATA_COLUMNS, "pos"))


def manifest_records(raw: DataFrame, pos: str | None = None) -> DataFrame:
    """Download manifest rows: url, name, size, parent_item_id (and ``pos`` when given)."""
    require_columns(raw, ("url",), "manifest")
    have = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    url = strip(F.col("url"))
    size = blank_to_null(have("size"))
    number = strip(size).try_cast("bigint")
    checked = F.when(size.isNotNull() & number.isNull(), F.raise_error(F.concat(F.lit("bad size: "), size))).otherwise(number)
    return raw.filter(url != "").select(
        url.alias("url"),
        strip(F.coalesce(blank_to_null(have("name")), basename(url))).alias("name"),
        checked.alias("size"),
        blank_to_null(have("parent_item_id")).alias("parent_item_id"),
        *([F.col(pos)] if pos else []),
    )


def read_manifest_csv(spark: SparkSession, path, multi_line: bool = False) -> DataFrame:
    return manifest_records(require_columns(read_csv_text(spark, path, multi_line, "pos"), ("url",), "manifest"), "pos")


def image_list_to_manifest(raw: DataFrame, site_code: str) -> DataFrame:
    """Image list rows of one site as manifest rows (url, name, size), cells unchanged."""
    require_columns(raw, IMAGE_LIST_COLUMNS, "image list")
    keep = has_site_code(F.col("filename"), site_code) & (F.col("public_path") != "")
    return raw.filter(keep).select(
        F.col("public_path").alias("url"), F.col("filename").alias("name"), F.col("file_size").alias("size")
    )


def read_image_list(spark: SparkSession, path, site_code: str, multi_line: bool = False) -> DataFrame:
    return image_list_to_manifest(read_csv_text(spark, path, multi_line), site_code)


CATALOGUE_SCHEMA = (
    "id string, title string, files array<struct<name: string, url: string, downloadUri: string, "
    "size: bigint, contentType: string>>"
)


def catalogue_files(items: DataFrame, site: str, profile: SurveyProfile = SurveyProfile()) -> DataFrame:
    """Files of catalogue items whose title matches ``site`` (lazy; may be empty)."""
    matched = items.filter(looks_like_site(F.coalesce("title", F.lit("")), F.lit(site)))
    files = matched.select(F.col("id").alias("parent_item_id"), F.explode("files").alias("f"))
    url = F.coalesce(blank_to_null(F.col("f.url")), blank_to_null(F.col("f.downloadUri")))
    return files.filter(has_extension(F.col("f.name"), profile.image_extensions) & url.isNotNull()).select(
        url.alias("url"), F.col("f.name").alias("name"), F.col("f.size").alias("size"), "parent_item_id",
        F.col("f.contentType").alias("content_type"),
    )


def read_catalogue(spark: SparkSession, path, site: str, profile: SurveyProfile = SurveyProfile()) -> DataFrame:
    """Saved catalogue child items (JSON) to manifest rows; no matching item is an error."""
    items = stored(read_json_objects(spark, path, CATALOGUE_SCHEMA))
    if items.filter(looks_like_site(F.coalesce("title", F.lit("")), F.lit(site))).isEmpty():
        raise LookupError(f"no catalogue item matches site {site!r}")
    return catalogue_files(items, site, profile)


def xmp_records(raw: DataFrame, pos: str) -> DataFrame:
    """Tag-tool export rows keyed by file name; a later row replaces an earlier one."""
    have = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    rows = raw.select(
        basename(F.coalesce(have("SourceFile"), F.lit(""))).alias("name"),
        F.col(pos),
        *[tag_text(have(src)).alias(dst) for dst, src in XMP_FIELDS.items()],
    )
    return last_row_per_key(rows, "name", pos)


def read_xmp_json(spark: SparkSession, path) -> DataFrame:
    schema = "SourceFile string, " + ", ".join(f"{c} string" for c in XMP_FIELDS.values())
    return xmp_records(read_json_objects(spark, path, schema, pos="pos"), "pos")


PROVENANCE_SCHEMA = (
    "schema string, doi string, site string, downloaded_at_utc string, hostname string, file_count bigint, "
    "total_bytes bigint, files array<struct<name: string, relpath: string, url: string, sha256: string, "
    "size_bytes: bigint, downloaded_at_utc: string, parent_item_id: string, notes: string>>"
)


def read_provenance(spark: SparkSession, path: str | None, multi_line: bool = False) -> DataFrame:
    """(name, sha256) from provenance envelopes, one per line, or of any layout with ``multi_line``; no file means no rows.

    With ``multi_line`` an envelope's file list is split among tasks: the objects inside the envelope that carry a name are its entries.
    """
    if path is None:
        return spark.createDataFrame([], "name string, sha256 string")
    if multi_line:
        return read_json_objects(spark, path, "name string, sha256 string", depth=1).filter("name IS NOT NULL")
    docs = spark.read.schema(PROVENANCE_SCHEMA).json(path)
    return docs.select(F.explode("files").alias("f")).select("f.name", "f.sha256")


def read_decisions(spark: SparkSession, path, multi_line: bool = False) -> DataFrame:
    """Decision artefacts: experiment, verdict, chosen_arm, rationale. One document per line, or per file if ``multi_line``."""
    schema = "experiment string, decision struct<verdict: string, chosen_arm: string, rationale: string>"
    return spark.read.schema(schema).json(path, multiLine=multi_line).select("experiment", "decision.*")


RUN_CHUNK_SCHEMA = (
    "label string, cameras_total bigint, cameras_enabled bigint, cameras_aligned bigint, alignment_rate double, "
    "markers bigint, scalebars bigint, transform_scale double, tie_points bigint, dense_point_count bigint, "
    "has_dense boolean, has_dsm boolean, has_ortho boolean"
)


def read_run_manifest(spark: SparkSession, path, multi_line: bool = False) -> DataFrame:
    """One row per chunk of the run manifests found at ``path``, one per line or per file."""
    fields = RUN_CHUNK_SCHEMA.replace(" bigint", ": bigint").replace(" string", ": string")
    fields = fields.replace(" double", ": double").replace(" boolean", ": boolean")
    docs = spark.read.schema(f"chunks array<struct<{fields}>>").json(path, multiLine=multi_line)
    return docs.select(F.explode("chunks").alias("c")).select("c.*")


# Columns of a point cloud as text; pass another schema for clouds with more or fewer.
POINT_SCHEMA = "x double, y double, z double, confidence smallint, cls string"


def read_points(spark: SparkSession, path, fmt: str = "parquet", schema: str = POINT_SCHEMA) -> DataFrame:
    """Points of a cloud; text has no types of its own, so it is read by ``schema`` in one pass."""
    return spark.read.csv(path, header=True, schema=schema) if fmt == "csv" else spark.read.format(fmt).load(path)


def has_attribute(points: DataFrame, column: str = "confidence") -> bool:
    """True when the column exists and holds at least one value (stops at the first)."""
    return column in points.columns and not points.filter(F.col(column).isNotNull()).isEmpty()
