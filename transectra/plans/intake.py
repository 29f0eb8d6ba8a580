"""Directory of images to inventory, findings and report."""

from __future__ import annotations

import json
import platform

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..operators.acquisition import coverage_counts, manifest_coverage, missing_files, unexpected_files
from ..operators.dataset_rules import dataset_findings, transect_uuids
from ..operators.image_rules import image_findings
from ..operators.inventory import assemble_inventory
from ..operators.report import all_findings, files_with, report_headers, strict_gate
from ..profile import SurveyProfile
from ..sinks.artefacts import write_inventory, write_report
from ..sources.images import catalogue_images

#: Names listed in the report itself.
FIRST_NAMES = 50
MANIFEST_CHECK = (
    "struct<expected: bigint, on_disk: bigint, missing: bigint, unexpected: bigint, "
    "first_missing: array<string>, first_unexpected: array<string>>"
)


def judge(
    inventory: DataFrame, profile: SurveyProfile = SurveyProfile(), expected_sites: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(dataset findings, per-image findings) of an inventory table."""
    return dataset_findings(inventory, profile, expected_sites), image_findings(inventory, profile)


def manifest_check(coverage: DataFrame, first: int = FIRST_NAMES) -> dict:
    """Counts of a coverage table and the first missing and unexpected names, as in the report; the table has them all."""
    counts = coverage_counts(coverage).first().asDict()
    return counts | {
        "first_missing": [r.name for r in missing_files(coverage).limit(first).collect()],
        "first_unexpected": [r.name for r in unexpected_files(coverage).limit(first).collect()],
    }


def site_folders(spark: SparkSession, site_dir: str) -> DataFrame:
    """Names of the folders that a path or glob stands for, one row each; lists folders only, on the driver."""
    path = spark._jvm.org.apache.hadoop.fs.Path(site_dir)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    names = sorted({f.getPath().getName() for f in found if f.isDirectory()})
    return spark.createDataFrame([(n,) for n in names], "site string")


def validate_intake(
    spark: SparkSession,
    site_dir: str,
    out_dir: str,
    doi: str = "",
    records: DataFrame | None = None,
    xmp: DataFrame | None = None,
    known_hashes: DataFrame | None = None,
    manifest: DataFrame | None = None,
    profile: SurveyProfile = SurveyProfile(),
    strict: bool = False,
    expected_sites: DataFrame | None = None,
    ids_csv_path: str | None = None,
    context: dict[str, str] | None = None,
) -> DataFrame:
    """Catalogue a folder (or a glob of site folders), write all artefacts, return the gate per site.

    Inventory and findings are written once and read back: rules, report and gate then
    scan narrow Parquet columns, and a lost executor never causes images to be read again.
    ``expected_sites`` (site) defaults to the folders that ``site_dir`` names, so a folder
    without any image fails instead of being passed over.
    """
    if expected_sites is None:
        expected_sites = site_folders(spark, site_dir)
    files = catalogue_images(spark, site_dir, known_hashes, profile)
    version = write_inventory(assemble_inventory(files, records, xmp), f"{out_dir}/inventory")
    inventory = spark.read.parquet(f"{version}/inventory")
    dataset, images = judge(inventory, profile, expected_sites)
    transect_uuids(inventory, profile).write.mode("overwrite").parquet(f"{out_dir}/transect_uuids")
    all_findings(dataset, images).write.mode("overwrite").parquet(f"{out_dir}/findings")
    stored = spark.read.parquet(f"{out_dir}/findings")
    dataset, images = (stored.filter(F.col("scope_kind") == kind) for kind in ("dataset", "image"))
    context = {
        "site_dir": site_dir, "package_version": __version__, "hostname": platform.node(), "ids_csv_path": ids_csv_path or "", **(context or {}),
    }
    headers = report_headers(inventory, dataset, doi, profile, context)
    check = F.lit(None).cast(MANIFEST_CHECK)
    if manifest is not None:
        manifest_coverage(manifest, inventory).write.mode("overwrite").parquet(f"{out_dir}/manifest_coverage")
        check = F.lit(json.dumps(manifest_check(spark.read.parquet(f"{out_dir}/manifest_coverage"))))
        check = F.from_json(check, MANIFEST_CHECK)
    headers = headers.withColumn("extra_context", F.struct(check.alias("manifest_check")))
    write_report(headers, files_with(images, "fail"), files_with(images, "warn"), out_dir)
    return strict_gate(stored, strict).orderBy(F.col("site"))
