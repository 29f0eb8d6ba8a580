"""Image file scans: listing, tags and hashes, transect layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename, blank_to_null, has_extension, transect_token
from ..profile import SurveyProfile
from ..session import stored
from .headers import reachable, with_entries
from .tiff import tag_fields, with_tags

#: Files whose headers, and bytes whose hash, make one task of ranged reads; and the most tasks.
FILES_PER_TASK, BYTES_PER_TASK, MOST_TASKS = 2_000, 256 << 20, 100_000


def _scan(spark: SparkSession, root: str, recursive: bool) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.[tT][iI][fF]*")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(root)
    )


def list_images(
    spark: SparkSession, root: str, profile: SurveyProfile = SurveyProfile(), recursive: bool = False
) -> DataFrame:
    """Image files as (path, name, relpath, size_bytes); file contents are not read."""
    files = _scan(spark, root, recursive)
    return files.filter(has_extension(F.col("path"), profile.image_extensions)).select(
        "path", *_file_columns(), F.col("length").alias("size_bytes")
    )


def _file_columns() -> list[Column]:
    path = F.col("path")
    return [
        F.element_at(F.split(path, "/"), -1).alias("name"),
        F.array_join(F.slice(F.split(path, "/"), -2, 2), "/").alias("relpath"),
    ]


def tags_by_ranges(files: DataFrame, known: DataFrame | None) -> DataFrame:
    """Listed files (path, name, ...) with tags by ranged reads; contents are read only of names without a known hash."""
    files = stored(files.join(known, "name", "left") if known is not None else files.withColumn("_known", F.lit(None).cast("string")))
    work = files.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("_known").isNull(), F.col("size_bytes"))).alias("b")).first()
    # The rows are tiny, so Spark would put them into one task; the bytes behind them say how many are needed.
    tasks = min(MOST_TASKS, 1 + work["n"] // FILES_PER_TASK + (work["b"] or 0) // BYTES_PER_TASK)
    dealt = files.repartition(int(tasks), "path").withColumnRenamed("_known", "sha256")
    return tag_fields(with_entries(dealt))


def catalogue_images(
    spark: SparkSession,
    root: str,
    known_hashes: DataFrame | None = None,
    profile: SurveyProfile = SurveyProfile(),
    site: Column | None = None,
    ranged: bool | None = None,
) -> DataFrame:
    """One row per image under ``root``: identity, size, tags, SHA-256, read errors.

    Tags are read by byte ranges where Arrow can open the store (``ranged``; by
    default local and mounted folders), and a hash known from earlier provenance
    (name, sha256) saves reading the content; ``bytes_read`` says what was read. The listing
    is joined with known hashes before anything is opened (runs jobs). In stores that
    only Spark opens, each file is read once, in the JVM, for tags and hash, and known rows are joined after the
    contents are gone. Either way no file content is ever shuffled.
    """
    known = None
    if known_hashes is not None:
        known = known_hashes.groupBy("name").agg(F.max("sha256").alias("_known"))
        known = known.select("name", blank_to_null(F.col("_known")).alias("_known"))
    if reachable(root) if ranged is None else ranged:
        tagged = tags_by_ranges(list_images(spark, root, profile), known)
    else:
        files = _scan(spark, root, recursive=False).filter(has_extension(F.col("path"), profile.image_extensions))
        files = files.withColumns({"name": _file_columns()[0], "relpath": _file_columns()[1]})
        tagged = with_tags(files.withColumn("sha256", F.sha2("content", 256))).withColumnRenamed("length", "size_bytes").drop("content")
        tagged = tagged.withColumn("bytes_read", F.col("size_bytes"))
        if known is not None:
            tagged = tagged.join(known, "name", "left").withColumn("sha256", F.coalesce("_known", "sha256"))
    site_col = site if site is not None else F.element_at(F.split("path", "/"), -2)
    return tagged.withColumn("site", site_col).drop("content", "_known", "modificationTime", "path")


def transect_layout(
    spark: SparkSession, root: str, transect: str | None = None, profile: SurveyProfile = SurveyProfile()
) -> DataFrame:
    """Image files with their transect label, from subfolders if any hold images, else from names.

    Raises when nothing matches. ``label`` is null for files without a token
    (they are kept so that they can be counted) unless one transect is asked for.
    """
    base = root.rstrip("/")
    top, parts = basename(F.lit(base)), F.split("path", "/")
    files = list_images(spark, base, profile, recursive=True).withColumns({
        "folder": F.element_at(parts, -2), "above": F.element_at(parts, -3),
    })
    foldered = files.filter(F.col("above") == top)
    if transect:
        foldered = foldered.filter(F.upper("folder") == transect.upper())
    if not foldered.isEmpty():
        out = foldered.withColumn("label", F.col("folder"))
    else:
        flat = files.filter(F.col("folder") == top)
        out = label_by_name(flat, profile)
        if transect:
            out = out.filter(F.col("label") == transect.upper())
        if out.filter(F.col("label").isNotNull()).isEmpty():
            raise FileNotFoundError(f"no image under {root} carries a transect token")
    return out.select("label", "path", "name", "size_bytes")


def label_by_name(images: DataFrame, profile: SurveyProfile = SurveyProfile()) -> DataFrame:
    return images.withColumn("label", transect_token(F.col("name"), profile.transect_token_pattern))


def known_bad(images: DataFrame, profile: SurveyProfile = SurveyProfile()) -> DataFrame:
    """Known-bad names with the first path found for each; ``path`` is null when absent."""
    spark = images.sparkSession
    names = spark.createDataFrame([(n,) for n in profile.known_bad_files], "name string")
    hits = images.filter(F.col("name").isin(*profile.known_bad_files)).groupBy("name").agg(F.min("path").alias("path"))
    return names.join(hits, "name", "left")


def with_known_bad(subset: DataFrame, images: DataFrame, profile: SurveyProfile = SurveyProfile()) -> DataFrame:
    """Subset paths plus the known-bad files that are not in it already."""
    extra = known_bad(images, profile).filter(F.col("path").isNotNull()).select("path")
    return subset.select("path").unionByName(extra).dropDuplicates(["path"]).withColumn("name", basename(F.col("path")))
