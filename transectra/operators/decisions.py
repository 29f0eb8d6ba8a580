"""Two-arm decisions, mode resolution, alarms, preflight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..profile import ReconstructionProfile, SurveyProfile

_DEFAULTS = ReconstructionProfile()


def arms_side_by_side(arms: DataFrame) -> DataFrame:
    """(experiment, arm, rms, aligned_pct) rows to one row per experiment."""
    pick = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    return arms.groupBy("experiment").agg(
        pick("fallback", "rms").alias("fallback_rms"), pick("fallback", "aligned_pct").alias("fallback_pct"),
        pick("manual", "rms").alias("manual_rms"), pick("manual", "aligned_pct").alias("manual_pct"),
    )


def decide_arm(arms: DataFrame, profile: ReconstructionProfile = _DEFAULTS) -> DataFrame:
    """Verdict per experiment: lower residual first, alignment as tie-break, review on conflict."""
    wide = arms_side_by_side(arms)
    fr, mr, fa, ma = (F.col(c) for c in ("fallback_rms", "manual_rms", "fallback_pct", "manual_pct"))
    by_rms = F.when(fr < mr, "fallback").otherwise("manual")
    by_alignment = F.when(fa > ma, "fallback").otherwise("manual")
    rms_clear = F.abs(fr - mr) > profile.rms_margin
    alignment_clear = F.abs(fa - ma) > profile.align_margin_pct
    review = "NEEDS_REVIEW"
    chosen = (
        F.when(fr.isNull() & mr.isNull(), review)
        .when(fr.isNull(), "manual")
        .when(mr.isNull(), "fallback")
        .when(rms_clear & alignment_clear & (by_rms != by_alignment), review)
        .when(rms_clear, by_rms)
        .when(alignment_clear, by_alignment)
        .otherwise("fallback")
    )
    why = (
        F.when(fr.isNull() & mr.isNull(), "no arm aligned")
        .when(fr.isNull() | mr.isNull(), "the other arm did not align")
        .when(rms_clear & alignment_clear & (by_rms != by_alignment), "residual and alignment point to different arms")
        .when(rms_clear, "lower residual")
        .when(alignment_clear, "residuals tie; more cameras aligned")
        .otherwise("both tie; the arm without assumptions")
    )
    return wide.withColumn("chosen_arm", chosen).withColumns({
        "verdict": F.when(F.col("chosen_arm") == review, review).otherwise("DECIDED"), "rationale": why,
    })


def resolve_modes(chunks: DataFrame, overrides: DataFrame, decisions: DataFrame) -> DataFrame:
    """Mode per chunk: operator override, else a decided valid arm, else refused.

    A chunk's latest decision counts if ``decisions`` has a ``ts``; without one, decisions
    that differ are refused.
    """
    decided = F.when((F.col("verdict") == "DECIDED") & F.col("chosen_arm").isin("fallback", "manual"), F.col("chosen_arm"))
    o = overrides.groupBy("chunk").agg(F.max("override").alias("override"))
    row = F.struct("verdict", "chosen_arm")
    if "ts" in decisions.columns:
        said = F.max_by(row, "ts")
    else:
        said = F.when(F.min(row) == F.max(row), F.max(row))
    d = decisions.groupBy("chunk").agg(said.alias("d")).select("chunk", "d.*")
    joined = chunks.select("chunk").distinct().join(o, "chunk", "left").join(d, "chunk", "left")
    mode = F.coalesce(F.nullif("override", F.lit("")), decided)
    return joined.select("chunk", mode.alias("mode")).withColumn(
        "status", F.when(F.col("mode").isNull(), "refused").otherwise("resolved")
    )


def alarms(stages: DataFrame, profile: ReconstructionProfile = _DEFAULTS) -> DataFrame:
    """Alarm rows (chunk, stage, alarm, critical) from typed stage facts.

    ``stages`` has one row per chunk and stage with ``disabled, alignment_rate,
    markers_detected, scalebars_present, transform_scale, has_cloud, cells,
    has_elevation``; each rule reads the facts of its own stage.
    """
    c, s = F.col, F.col("stage")
    rules = [
        ("too_many_disabled", True, (s == "step4") & (c("disabled") > profile.alarm_max_disabled)),
        ("low_alignment", True, (s == "align") & (c("alignment_rate") < profile.alarm_min_align_rate)),
        ("no_markers", False, (s == "markers") & (c("markers_detected") == 0)),
        ("no_scalebars", True, (s == "reduce") & (c("scalebars_present") == 0)),
        ("not_scaled", True, (s == "dense") & c("transform_scale").isNull()),
        ("no_cloud", True, (s == "filter") & ~F.coalesce(c("has_cloud"), F.lit(False))),
        ("empty_grid", True, (s == "dsm") & (F.coalesce(c("cells"), F.lit(0)) == 0)),
        ("huge_grid", True, (s == "dsm") & (c("cells") > profile.alarm_max_dsm_cells)),
        ("no_elevation", True, (s == "ortho") & ~F.coalesce(c("has_elevation"), F.lit(False))),
    ]
    fired = F.array(*[
        F.when(cond, F.struct(F.lit(name).alias("alarm"), F.lit(critical).alias("critical")))
        for name, critical, cond in rules
    ])
    hits = stages.select("chunk", "stage", F.explode(F.array_compact(fired)).alias("a"))
    return hits.select("chunk", "stage", "a.alarm", "a.critical")


def enforce(found: DataFrame, ignore: bool = False) -> None:
    """Raise on a critical alarm unless told to go on (runs a job)."""
    if not ignore:
        first = found.filter("critical").limit(5).collect()
        if first:
            raise RuntimeError("critical alarms: " + "; ".join(f"{r.chunk}/{r.stage}: {r.alarm}" for r in first))


def preflight_failures(images: DataFrame, profile: SurveyProfile = SurveyProfile()) -> DataFrame:
    """Unreadable files with the reason and whether the file is a known-bad one."""
    known = F.lit(False)
    for name in profile.known_bad_files:
        known = known | F.contains(F.col("name"), F.lit(name))
    return images.filter(F.size("read_errors") > 0).select(
        "name", F.array_join("read_errors", "; ").alias("reason"), known.alias("known_bad")
    )


def preflight_verdict(failures: DataFrame) -> DataFrame:
    """One row: failure count and whether all of them are known-bad."""
    return failures.agg(
        F.count(F.lit(1)).alias("failures"), F.coalesce(F.every("known_bad"), F.lit(True)).alias("all_known_bad")
    )
