"""QC report: rollup, worst severities, file lists, totals, gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import SEVERITIES, SEVERITY_RANK
from ..joins import merge_by_key
from ..profile import SurveyProfile
from ..session import stored
from .image_rules import evidence, image_findings, image_verdicts, severities, worst_of


def all_findings(dataset: DataFrame, images: DataFrame) -> DataFrame:
    return dataset.unionByName(images)


def rollup(findings: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Counts per rule, one column per severity, zero-filled."""
    return findings.groupBy(*keys, "code").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    )


def overall_severity(findings: DataFrame, keys: list[str] = ("site",)) -> DataFrame:
    """Worst severity; dataset findings come first, then images by name and rule order.

    The highest rank is a hash aggregation. Only severities of equal rank need the first
    one met; of their rows each task keeps one per group before the shuffle.
    """
    keys = list(keys)
    by_rank = {}
    for s, r in SEVERITY_RANK.items():
        by_rank.setdefault(r, []).append(s)
    shared = [r for r, names in by_rank.items() if len(names) > 1]
    worst = findings.groupBy(*keys).agg(F.max("rank").alias("_rank"))
    order = [F.when(F.col("scope_kind") == "dataset", 0).otherwise(1), F.col("scope"), F.col("pos")]
    w = Window.partitionBy(*keys, "rank").orderBy(*order)
    met = (
        findings.filter(F.col("rank").isin(*shared)).withColumn("_n", F.row_number().over(w)).filter("_n = 1")
        .select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("rank").alias("_met"), "severity")
    )
    same = F.col("_rank") == F.col("_met")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    severity = F.col("severity")
    for r, names in by_rank.items():
        if len(names) == 1:
            severity = F.when(F.col("_rank") == r, names[0]).otherwise(severity)
    return worst.join(met, same, "left").select(*keys, severity.alias("overall_severity"))


def worst_per_file(findings: DataFrame) -> DataFrame:
    """Worst severity of every image; dataset findings do not count.

    Rank, rule position and severity are packed into one number, so the minimum is
    a hash aggregation and each task sends one row per image.
    """
    images = findings.filter(F.col("scope_kind") == "image")
    keys = ["site", "scope"] if "site" in findings.columns else ["scope"]
    names = F.array(*[F.lit(s) for s in SEVERITIES])
    packed = (2 - F.col("rank")) * 4_000_000 + F.col("pos") * 4 + F.array_position(names, F.col("severity")).cast("int") - 1
    worst = images.groupBy(*keys).agg(F.min(packed).alias("_w"))
    return worst.select(*keys, F.get(names, F.col("_w") % 4).alias("severity"))


def files_with(findings: DataFrame, severity: str) -> DataFrame:
    """Names whose worst severity is ``severity``, sorted."""
    return worst_per_file(findings).filter(F.col("severity") == severity).drop("severity").orderBy("scope")


def totals(inventory: DataFrame, keys: list[str] = ("site",)) -> DataFrame:
    return inventory.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("image_count"),
        F.count_if("csv_matched").alias("csv_join_count"),
        F.sum("size_bytes").alias("total_bytes"),
    )


def strict_gate(findings: DataFrame, strict: bool = True) -> DataFrame:
    """Per site: blocked when the worst finding is a failure and the gate is strict."""
    blocked = (F.col("overall_severity") == "fail") & F.lit(strict)
    return overall_severity(findings).withColumn("blocked", blocked)


def _site_counts(inventory: DataFrame, profile: SurveyProfile) -> DataFrame:
    """Per site: images by worst severity, and totals. One scan without exploding; stored."""
    verdicts = evidence(inventory, profile).select("site", "csv_matched", "size_bytes", worst_of(severities(profile))["severity"].alias("worst"))
    return stored(verdicts.groupBy("site").agg(
        *[F.count_if(F.col("worst") == s).alias(f"worst_{s}") for s in SEVERITIES],
        F.count(F.lit(1)).alias("image_count"), F.count_if("csv_matched").alias("csv_join_count"), F.sum("size_bytes").alias("total_bytes")))


def _site_severity(dataset: DataFrame, sites: DataFrame, inventory: DataFrame, profile: SurveyProfile) -> DataFrame:
    """``overall_severity`` of dataset findings and images, from counts of worst severities per site.

    Only where dataset findings are milder and images of two severities share the highest rank
    do image names decide; only then, and for these sites, are images looked at again.
    """
    first = dataset.groupBy("site").agg(F.min(F.struct((-F.col("rank")).alias("order"), "pos", "severity")).alias("d"))
    worst = sites.select("site", *[f"worst_{s}" for s in SEVERITIES])
    both = merge_by_key([first, worst], "site")
    rank, image, several = F.lit(-1), F.lit(None).cast("string"), F.lit(False)
    for level in sorted(set(SEVERITY_RANK.values())):
        names = [s for s in SEVERITIES if SEVERITY_RANK[s] == level]
        here = sum((F.coalesce((F.col(f"worst_{s}") > 0).cast("int"), F.lit(0)) for s in names), F.lit(0))
        rank = F.when(here > 0, level).otherwise(rank)
        several = F.when(here > 0, here > 1).otherwise(several)
        for s in names:
            image = F.when(F.col(f"worst_{s}") > 0, s).otherwise(image)
    data_rank = F.coalesce(-F.col("d.order"), F.lit(-1))
    both = stored(both.select(
        "site", F.when(data_rank >= rank, F.col("d.severity")).otherwise(image).alias("overall_severity"), ((data_rank < rank) & several).alias("open")))
    undecided = both.filter("open").select("site")
    if undecided.isEmpty():
        return both.drop("open")
    verdicts = image_verdicts(inventory.join(undecided, "site", "left_semi"), profile)
    return both.filter("not open").drop("open").unionByName(overall_severity(verdicts))


def report_headers(
    inventory: DataFrame, dataset: DataFrame, doi: str, profile: SurveyProfile = SurveyProfile(),
    context: dict[str, str] | None = None,
) -> DataFrame:
    """One report document per site: scalars, dataset findings, rollup.

    Images are judged twice, once for worst severities (stored; runs jobs) and once for the rollup, each a hash aggregation over narrow
    columns. Only bounded parts are nested (seven dataset findings, at most twelve rules); per-image findings and file lists stay tables beside it.
    """
    dataset = stored(dataset)
    sites = _site_counts(inventory, profile)
    worst = _site_severity(dataset, sites, inventory, profile)
    counts = sites.select(
        "site", "image_count", "csv_join_count", "total_bytes", F.col("worst_fail").alias("failed_file_count"), F.col("worst_warn").alias("warned_file_count"))
    nested = dataset.groupBy("site").agg(F.sort_array(F.collect_list(
        F.struct("pos", "code", "severity", "message", "scope", "details"))).alias("dataset_findings"))
    per_rule = rollup(image_findings(inventory, profile), ["site"]).groupBy("site").agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("code", F.struct(*SEVERITIES))))).alias("per_image_findings_rollup"))
    lineage = profile.lineage()
    absent = lineage["fields_absent_by_design"]
    texts = lambda values: F.array(*[F.lit(v) for v in values])
    out = merge_by_key([worst, counts, nested, per_rule], "site")
    out = out.fillna(0, subset=["image_count", "csv_join_count", "total_bytes", "failed_file_count", "warned_file_count"])
    return out.withColumns({
        "schema": F.lit("transectra/intake_qc/v2"),
        "doi": F.lit(doi),
        # The unbounded parts, by the folder they are written to beside the report.
        "per_image_findings": F.lit("findings"),
        "files_with_failures": F.lit("files_with_failures"),
        "files_with_warnings": F.lit("files_with_warnings"),
        "generated_at_utc": F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()),
                                          "yyyy-MM-dd'T'HH:mm:ss'+00:00'"),
        "metadata_lineage": F.struct(
            texts(lineage["csv_primary_fields"]).alias("csv_primary_fields"),
            texts(lineage["on_disk_primary_fields"]).alias("on_disk_primary_fields"),
            F.struct(F.lit(absent["reason"]).alias("reason"),
                     texts(absent["missing_exif_tags"]).alias("missing_exif_tags")).alias("fields_absent_by_design"),
        ),
        **{k: F.lit(v) for k, v in (context or {}).items()},
    })
