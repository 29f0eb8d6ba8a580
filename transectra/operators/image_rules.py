"""Per-image QC rules: one scan of the inventory, one findings table.

Each rule judges evidence columns prepared once per image. The severities of all
rules form one small array that is exploded; messages and details are derived
after that, so a job that only counts severities never builds them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import in_window, is_one_of_sizes, severity_rank, software_severity, wall_clock
from ..functions.geo import in_box
from ..functions.text import details, filename_parts, truthy, truthy_source
from ..profile import SurveyProfile


def evidence(inventory: DataFrame, p: SurveyProfile) -> DataFrame:
    """Inventory plus the values several rules look at; table values win over file tags."""
    c = F.col
    return inventory.withColumns({
        "_make": F.coalesce(truthy(c("csv_cammake"), c("exif_make")), F.lit("")),
        "_model": F.coalesce(truthy(c("csv_cammodel"), c("exif_model")), F.lit("")),
        "_artist": truthy(c("csv_artist"), c("exif_artist")),
        "_rights": truthy(c("csv_copyright"), c("exif_copyright")),
        "_taken": wall_clock(c("csv_dtoriginal_utc")),
        "_lat": F.coalesce("csv_lat", "gps_lat"),
        "_lon": F.coalesce("csv_lon", "gps_lon"),
    })


@dataclass(frozen=True)
class Rule:
    code: str
    severity: Callable[[SurveyProfile], Column]
    details: Callable[[SurveyProfile], Column]
    messages: dict[str, str]


def _passes(condition: Column) -> Column:
    return F.when(condition, "ok").otherwise("fail")


def _capture_time(p: SurveyProfile) -> Column:
    return (
        F.when(truthy(F.col("csv_dtoriginal_utc")).isNull(), "unverified")
        .when(in_window(F.col("_taken"), p.date_min, p.date_max), "ok")
        .otherwise("warn")
    )


def _attribution(p: SurveyProfile) -> Column:
    url = F.col("xmp_attribution_url")
    return F.when(url.isNull(), "unverified").when(url == p.attribution_url, "ok").otherwise("fail")


def _credit(p: SurveyProfile) -> Column:
    rights = F.col("_artist").isNotNull() & F.col("_rights").isNotNull()
    return F.when(F.col("iptc_credit").isNotNull(), "ok").when(rights, "warn").otherwise("fail")


def _source(field: str) -> Column:
    return truthy_source(F.col(field), "CSV", "EXIF")


READ_ERRORS = Rule(
    "read_errors", lambda p: F.lit("fail"), lambda p: details(errors=F.col("read_errors")),
    {"fail": "the file could not be read"},
)

# Order matters: it breaks ties between severities of equal rank.
RULES = (
    Rule("csv_join", lambda p: _passes(F.col("csv_matched")), lambda p: details(image_id=F.col("image_id")),
         {"ok": "found in the metadata table", "fail": "not in the metadata table"}),
    Rule("software_lineage",
         lambda p: software_severity(F.col("software"), p.software_ok_prefix, p.software_warn_prefixes),
         lambda p: details(software=F.col("software")),
         {"ok": "expected software", "warn": "known second tool", "fail": "software missing or unknown"}),
    Rule("filename_pattern", lambda p: _passes(F.col("name").rlike(f"(?i){p.filename_pattern}")),
         lambda p: details(**filename_parts(F.col("name"), p.filename_pattern)),
         {"ok": "name follows the convention", "fail": "name off convention"}),
    Rule("camera_consistency",
         lambda p: _passes(F.col("_make").rlike(f"(?i){p.camera_make_pattern}")
                           & F.col("_model").rlike(f"(?i){p.camera_model_pattern}")),
         lambda p: details(make=F.col("_make"), model=F.col("_model"), source=_source("csv_cammake")),
         {"ok": "expected camera", "fail": "unexpected camera"}),
    Rule("dimensions", lambda p: _passes(is_one_of_sizes(F.col("width"), F.col("height"), p.dimensions)),
         lambda p: details(width=F.col("width"), height=F.col("height")),
         {"ok": "native frame size", "fail": "frame size missing or unexpected"}),
    Rule("exif_artist", lambda p: _passes(F.col("_artist").eqNullSafe(F.lit(p.artist))),
         lambda p: details(actual=F.col("_artist"), expected=F.lit(p.artist), source=_source("csv_artist")),
         {"ok": "artist as expected", "fail": "artist differs"}),
    Rule("exif_copyright", lambda p: _passes(F.col("_rights").eqNullSafe(F.lit(p.copyright))),
         lambda p: details(actual=F.col("_rights"), expected=F.lit(p.copyright), source=_source("csv_copyright")),
         {"ok": "copyright as expected", "fail": "copyright differs"}),
    Rule("datetime_original", _capture_time, lambda p: details(dtoriginal_utc=F.col("csv_dtoriginal_utc")),
         {"ok": "inside the survey window", "warn": "unreadable or outside the survey window",
          "unverified": "no capture time available"}),
    Rule("gps_present", lambda p: _passes(in_box(F.col("_lat"), F.col("_lon"), p)),
         lambda p: details(lat=F.col("_lat"), lon=F.col("_lon"),
                           source=F.when(F.col("csv_lat").isNotNull(), "CSV").otherwise("EXIF")),
         {"ok": "inside the survey box", "fail": "missing or outside the box"}),
    Rule("xmp_attribution_url", _attribution,
         lambda p: details(actual=F.col("xmp_attribution_url"), expected=F.lit(p.attribution_url)),
         {"ok": "points to the release", "fail": "points elsewhere", "unverified": "tag not read"}),
    Rule("iptc_credit", _credit,
         lambda p: details(actual=F.col("iptc_credit"), artist=F.col("_artist"), copyright=F.col("_rights")),
         {"ok": "credit given", "warn": "no credit, but artist and copyright are there", "fail": "no rights information"}),
)


def severities(p: SurveyProfile) -> Column:
    """(code, severity) of every rule for one image; a read error stands alone."""
    one = lambda r: F.struct(F.lit(r.code).alias("code"), r.severity(p).alias("severity"))
    return F.when(F.size("read_errors") > 0, F.array(one(READ_ERRORS))).otherwise(F.array(*[one(r) for r in RULES]))


def worst_of(found: Column) -> Column:
    """(order, pos, severity) of the worst of an image's findings: the highest rank wins, among equals the first rule."""
    return F.array_min(F.transform(found, lambda f, i: F.struct(
        (-severity_rank(f["severity"])).alias("order"), i.alias("pos"), f["severity"].alias("severity"))))


def image_verdicts(inventory: DataFrame, profile: SurveyProfile = SurveyProfile()) -> DataFrame:
    """Worst finding of every image (site, scope, pos, severity, rank) straight from its inventory row.

    Equals ``worst_per_file`` of the findings table, without exploding or shuffling.
    """
    judged = evidence(inventory, profile).select("*", worst_of(severities(profile)).alias("w"))
    return judged.select(
        *(["site"] if "site" in inventory.columns else []), F.col("name").alias("scope"), F.lit("image").alias("scope_kind"),
        "w.pos", "w.severity", (-F.col("w.order")).alias("rank"),
    )


def _per_rule(value: Callable[[Rule], Column]) -> Column:
    out = F
    for rule in (READ_ERRORS, *RULES):
        out = out.when(F.col("f.code") == rule.code, value(rule))
    return out


def _message(rule: Rule) -> Column:
    out = F
    for severity, text in rule.messages.items():
        out = out.when(F.col("f.severity") == severity, text)
    return out


def image_findings(inventory: DataFrame, profile: SurveyProfile = SurveyProfile()) -> DataFrame:
    """Findings table: site, scope, scope_kind, pos, code, severity, rank, message, details. No shuffle."""
    judged = evidence(inventory, profile).select("*", F.posexplode(severities(profile)).alias("pos", "f"))
    return judged.select(
        *(["site"] if "site" in inventory.columns else []),
        F.col("name").alias("scope"), F.lit("image").alias("scope_kind"), "pos", "f.code", "f.severity",
        severity_rank(F.col("f.severity")).alias("rank"),
        _per_rule(_message).alias("message"),
        _per_rule(lambda r: r.details(profile)).alias("details"),
    )
