"""Quality, decision, manifest and telemetry queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import decisions, manifest, quality, telemetry
from ..plans import reconstruction as records_of
from ..profile import ReconstructionProfile
from ..session import shared_folder
from ..sinks.artefacts import merge_extents
from ..sources.telemetry import numeric_samples
from ..streaming.telemetry import read_summary, start_summary
from .registry import query
from .views import VIEWS, ctes, spark_text, tables_of

R = ReconstructionProfile()
CAM = f"WITH {ctes('cameras')}, cam AS (SELECT *, TRY_CAST(trim(quality_raw) AS DOUBLE) AS q FROM v_cameras)"


@query("low_quality_disabled", f"{CAM} SELECT chunk, label, enabled AND NOT coalesce(q < 0.5, false) AS enabled FROM cam")
def low_quality_disabled(v):
    return quality.disable_low_quality(v("cameras"), 0.5).select("chunk", "label", "enabled")


@query("quality_stats", f"""{CAM} SELECT chunk, count(*) AS analyzed, count(q) AS with_quality, count(*) - count(q) AS no_metadata,
  count(*) FILTER (WHERE q < 0.5) AS disabled, CAST(0.5 AS DOUBLE) AS threshold, min(q) AS min_quality, max(q) AS max_quality,
  median(q) AS median_quality FROM cam GROUP BY chunk""")
def quality_stats(v):
    return quality.quality_stats(v("cameras"), 0.5)


@query("alignment_rates", f"""{CAM}, n AS (SELECT chunk, count(*) AS cameras_total, count(*) FILTER (WHERE enabled) AS cameras_enabled,
  count(*) FILTER (WHERE aligned) AS cameras_aligned FROM cam GROUP BY chunk)
  SELECT *, coalesce(cameras_aligned / CAST(nullif(cameras_enabled, 0) AS DOUBLE), 0) AS alignment_rate,
  cameras_aligned / CAST(nullif(cameras_enabled, 0) AS DOUBLE) AS report_alignment_rate,
  cameras_aligned / CAST(cameras_total AS DOUBLE) AS rate_of_total FROM n""")
def alignment_rates(v):
    return quality.alignment_rates(v("cameras"))


def _arm(name, t):
    return (f"SELECT chunk, '{name}' AS arm, CAST({t} AS DOUBLE) AS threshold, count(*) FILTER (WHERE q < {t}) AS disabled, "
            f"count(*) FILTER (WHERE enabled AND NOT coalesce(q < {t}, false)) AS enabled, count(*) FILTER (WHERE aligned_{name}) AS aligned, "
            "count(*) AS n FROM cam GROUP BY chunk")


@query("threshold_arms", f"""{CAM} SELECT chunk, arm, threshold, disabled, enabled, aligned, aligned / CAST(nullif(enabled, 0) AS DOUBLE) AS align_rate_of_enabled,
  aligned / CAST(n AS DOUBLE) AS align_rate_of_total FROM ({_arm('q050', 0.5)} UNION ALL {_arm('q030', 0.3)})""")
def threshold_arms(v):
    return quality.compare_arms(v("cameras"), R.ab_arms)


@query("arm_results", f"""{CAM}, {ctes('arm_points', 'arm_runs').removeprefix('WITH ')},
  t AS (SELECT chunk, arm, count(*) AS tie_points, round(max(x) - min(x), 4) AS region_x, round(max(y) - min(y), 4) AS region_y,
    round(max(z) - min(z), 4) AS region_z FROM v_arm_points GROUP BY ALL),
  s AS (SELECT chunk, arm, round(CAST(sum(seconds) AS DOUBLE) / 60, 1) AS minutes FROM v_arm_runs GROUP BY ALL)
  SELECT a.chunk, a.arm, a.threshold, a.disabled, a.enabled, a.aligned, a.aligned / CAST(nullif(a.enabled, 0) AS DOUBLE) AS align_rate_of_enabled,
    a.aligned / CAST(a.n AS DOUBLE) AS align_rate_of_total, coalesce(t.tie_points, 0) AS tie_points, t.region_x, t.region_y, t.region_z, s.minutes
  FROM ({_arm('q050', 0.5)} UNION ALL {_arm('q030', 0.3)}) AS a LEFT JOIN t ON t.chunk = a.chunk AND t.arm = a.arm
    LEFT JOIN s ON s.chunk = a.chunk AND s.arm = a.arm""")
def arm_results(v):
    return quality.arm_results(quality.compare_arms(v("cameras"), R.ab_arms), v("arm_points"), v("arm_runs"))


_BAND = "CASE WHEN q < 0.3 THEN '<0.30' WHEN q < 0.5 THEN '0.30-0.50' ELSE '>=0.50' END"


@query("band_breakdown", f"""{CAM}, al AS (SELECT *, 'q050' AS arm, aligned_q050 AS ok FROM cam UNION ALL SELECT *, 'q030', aligned_q030 FROM cam)
  SELECT chunk, arm, {_BAND} AS band, count(*) AS cameras, count(*) FILTER (WHERE ok) AS aligned,
  count(*) FILTER (WHERE ok) / CAST(count(*) AS DOUBLE) AS rate FROM al WHERE q IS NOT NULL GROUP BY 1, 2, 3""")
def band_breakdown(v):
    cams = v("cameras")
    arm = lambda a: cams.select("chunk", "label", F.lit(a).alias("arm"), F.col(f"aligned_{a}").alias("aligned"))
    return quality.band_breakdown(cams, arm("q050").unionByName(arm("q030")), R.quality_bands)


ARM = f"""WITH {ctes('arms')}, w AS (SELECT experiment, max(rms) FILTER (WHERE arm = 'fallback') AS fallback_rms,
  max(aligned_pct) FILTER (WHERE arm = 'fallback') AS fallback_pct, max(rms) FILTER (WHERE arm = 'manual') AS manual_rms,
  max(aligned_pct) FILTER (WHERE arm = 'manual') AS manual_pct FROM v_arms GROUP BY experiment)"""
_RW = "CASE WHEN fallback_rms < manual_rms THEN 'fallback' ELSE 'manual' END"
_AW = "CASE WHEN fallback_pct > manual_pct THEN 'fallback' ELSE 'manual' END"
DEC = f"""{ARM}, dc AS (SELECT *, CASE WHEN fallback_rms IS NULL AND manual_rms IS NULL THEN 'NEEDS_REVIEW' WHEN fallback_rms IS NULL THEN 'manual'
  WHEN manual_rms IS NULL THEN 'fallback'
  WHEN abs(fallback_rms - manual_rms) > 0.02 AND abs(fallback_pct - manual_pct) > 2 AND {_RW} <> {_AW} THEN 'NEEDS_REVIEW'
  WHEN abs(fallback_rms - manual_rms) > 0.02 THEN {_RW} WHEN abs(fallback_pct - manual_pct) > 2 THEN {_AW} ELSE 'fallback' END AS chosen_arm FROM w)"""


@query("arms_side_by_side", f"{ARM} SELECT * FROM w")
def arms_side_by_side(v):
    return decisions.arms_side_by_side(v("arms"))


@query("arm_decisions", f"{DEC} SELECT experiment, chosen_arm, CASE WHEN chosen_arm = 'NEEDS_REVIEW' THEN chosen_arm ELSE 'DECIDED' END AS verdict FROM dc")
def arm_decisions(v):
    return decisions.decide_arm(v("arms"), R).select("experiment", "chosen_arm", "verdict")


@query("resolved_modes", f"""{DEC}, o AS (SELECT c_custkey AS chunk, CASE c_nationkey WHEN 3 THEN 'manual' WHEN 4 THEN '' END AS override FROM customer),
  m AS (SELECT o.chunk, coalesce(nullif(o.override, ''), CASE WHEN chosen_arm <> 'NEEDS_REVIEW' THEN chosen_arm END) AS mode FROM o LEFT JOIN dc ON o.chunk = dc.experiment)
  SELECT chunk, mode, CASE WHEN mode IS NULL THEN 'refused' ELSE 'resolved' END AS status FROM m""")
def resolved_modes(v):
    chunks = v.table("customer").select(
        F.col("c_custkey").alias("chunk"), F.when(F.col("c_nationkey") == 3, "manual").when(F.col("c_nationkey") == 4, "").alias("override")
    )
    decided = decisions.decide_arm(v("arms"), R).withColumnRenamed("experiment", "chunk")
    return decisions.resolve_modes(chunks, chunks, decided)


# Decisions over time: a customer's latest order decides.
LATE = """SELECT o_custkey AS chunk, arg_max(CASE o_orderstatus WHEN 'F' THEN 'fallback' WHEN 'P' THEN 'manual' ELSE 'NEEDS_REVIEW' END, o_orderkey) AS arm
  FROM orders GROUP BY o_custkey"""


@query("resolved_modes_latest", f"""WITH d AS ({LATE}), m AS (SELECT c_custkey AS chunk, CASE WHEN arm <> 'NEEDS_REVIEW' THEN arm END AS mode
  FROM customer LEFT JOIN d ON c_custkey = d.chunk) SELECT chunk, mode, CASE WHEN mode IS NULL THEN 'refused' ELSE 'resolved' END AS status FROM m""")
def resolved_modes_latest(v):
    arm = F.when(F.col("o_orderstatus") == "F", "fallback").when(F.col("o_orderstatus") == "P", "manual").otherwise("NEEDS_REVIEW")
    decided = v.table("orders").select(F.col("o_custkey").alias("chunk"), F.col("o_orderkey").alias("ts"), arm.alias("chosen_arm"))
    decided = decided.withColumn("verdict", F.when(F.col("chosen_arm") == "NEEDS_REVIEW", "NEEDS_REVIEW").otherwise("DECIDED"))
    chunks = v.table("customer").select(F.col("c_custkey").alias("chunk"))
    return decisions.resolve_modes(chunks, chunks.withColumn("override", F.lit(None).cast("string")), decided)


_RULES = [
    ("too_many_disabled", "true", "stage = 'step4' AND disabled > 200"), ("low_alignment", "true", "stage = 'align' AND alignment_rate < 0.7"),
    ("no_markers", "false", "stage = 'markers' AND markers_detected = 0"), ("no_scalebars", "true", "stage = 'reduce' AND scalebars_present = 0"),
    ("not_scaled", "true", "stage = 'dense' AND transform_scale IS NULL"), ("no_cloud", "true", "stage = 'filter' AND NOT has_cloud"),
    ("empty_grid", "true", "stage = 'dsm' AND cells = 0"), ("huge_grid", "true", "stage = 'dsm' AND cells > 100000000"),
    ("no_elevation", "true", "stage = 'ortho' AND NOT has_elevation"),
]


@query("stage_alarms", f"WITH {ctes('stage_facts')} " + " UNION ALL ".join(
    f"SELECT chunk, stage, '{n}' AS alarm, {c} AS critical FROM v_stage_facts WHERE {w}" for n, c, w in _RULES))
def stage_alarms(v):
    return decisions.alarms(v("stage_facts"), R)


@query("stage_record_alarms", f"""WITH {ctes('cameras', 'markers', 'scalebars', 'cloud', 'products')}, cam AS (SELECT *, TRY_CAST(trim(quality_raw) AS DOUBLE) AS q FROM v_cameras),
  ch AS (SELECT DISTINCT chunk FROM v_markers), mk AS (SELECT chunk, count(x) AS n FROM v_markers GROUP BY chunk)
  SELECT chunk, 'step4' AS stage, 'too_many_disabled' AS alarm, true AS critical FROM cam GROUP BY chunk HAVING count(*) FILTER (WHERE q < 0.5) > 200
  UNION ALL SELECT chunk, 'align', 'low_alignment', true FROM cam GROUP BY chunk
    HAVING coalesce(count(*) FILTER (WHERE aligned) / CAST(nullif(count(*) FILTER (WHERE enabled), 0) AS DOUBLE), 0) < 0.7
  UNION ALL SELECT chunk, 'markers', 'no_markers', false FROM mk WHERE n = 0
  UNION ALL SELECT chunk, 'reduce', 'no_scalebars', true FROM ch WHERE chunk NOT IN (SELECT chunk FROM v_scalebars)
  UNION ALL SELECT chunk, 'filter', 'no_cloud', true FROM ch
  UNION ALL SELECT chunk, 'ortho', 'no_elevation', true FROM v_products GROUP BY chunk""")
def stage_record_alarms(v):
    """Alarms from records computed on tables; a chunk with a cloud raises none for it, one without does."""
    chunks = v("markers").select("chunk").distinct()
    clouds = v("cloud").select("chunk").distinct()
    records = [
        records_of.import_record(v("cameras")), records_of.step4_record(v("cameras"), R), records_of.align_record(v("cameras")),
        records_of.markers_record(v("markers")), records_of.reduce_record(v("scalebars"), chunks),
        records_of.dense_record(clouds.withColumn("transform_scale", F.lit(1.5)), v("cloud")),
        records_of.filter_record(v("cloud"), R, chunks.unionByName(clouds)), records_of.ortho_record(v("products")),
    ]
    rows = records[0]
    for r in records[1:]:
        rows = rows.unionByName(r)
    return decisions.alarms(records_of.typed_stages(rows), R)


@query("stage_columns", f"WITH {ctes('stage_stats')} SELECT chunk, " + ", ".join(
    f"arg_max(payload, ts) FILTER (WHERE stage = '{s}') AS stage_{s}" for s in manifest.STAGES) + " FROM v_stage_stats GROUP BY chunk")
def stage_columns(v):
    return manifest.stage_columns(v("stage_stats"))


@query("pending_work", f"""WITH {ctes('stage_stats', 'work')} SELECT segment, chunk, stage FROM v_work AS w
  WHERE NOT EXISTS (SELECT 1 FROM v_stage_stats AS s WHERE s.chunk = w.chunk AND s.stage = w.stage)""")
def pending_work(v):
    return manifest.pending_work(v("work"), v("stage_stats")).select("segment", "chunk", "stage")


@query("carried_scale", f"""WITH {ctes('stage_stats', 'chunk_facts')} SELECT s.chunk, s.stage, s.ts, f.markers, f.has_dense FROM v_stage_stats AS s
  LEFT JOIN v_chunk_facts AS f ON s.chunk = f.chunk""")
def carried_scale(v):
    carried = manifest.carry_scale(v("stage_stats"), v("chunk_facts").select("chunk", "markers", "has_dense"))
    return carried.select("chunk", "stage", "ts", "scale_info.markers", "scale_info.has_dense")


@query("observed_quality", f"""WITH {ctes('chunk_facts')} SELECT label, cameras_aligned, cameras_total, CAST(100 AS DOUBLE) * cameras_aligned / cameras_total AS aligned_pct,
  markers, scalebars, has_dense, has_dsm, has_ortho, CAST(0.27 AS DOUBLE) AS rms_envelope_lo, CAST(0.52 AS DOUBLE) AS rms_envelope_hi,
  CAST(3.41 AS DOUBLE) AS max_horizontal_mm, CAST(1 AS DOUBLE) AS scalebar_target_mm FROM v_chunk_facts""")
def observed_quality(v):
    return manifest.observe_quality(v("chunk_facts"), R)


@query("run_manifest_chunks", f"""WITH {ctes('chunk_facts', 'stage_stats', 'chunk_products')}, p AS (SELECT chunk, count(*) AS n_products,
  max(bytes) FILTER (WHERE product = 'AF') AS af_bytes, max(path) FILTER (WHERE product = 'NO') AS no_path FROM v_chunk_products GROUP BY chunk),
  m AS (SELECT f.chunk, f.cameras_total, f.markers, arg_max(s.payload, s.ts) FILTER (WHERE s.stage = 'align') AS stage_align
  FROM v_chunk_facts AS f LEFT JOIN v_stage_stats AS s ON f.chunk = s.chunk GROUP BY ALL) SELECT m.*, p.n_products, p.af_bytes, p.no_path FROM m LEFT JOIN p ON m.chunk = p.chunk""")
def run_manifest_chunks(v):
    rows = manifest.run_chunks(v("chunk_facts"), v("stage_stats"), v("chunk_products"))
    products = F.col("products")
    return rows.select("chunk", "cameras_total", "markers", "stage_align", F.size("products").cast("bigint").alias("n_products"),
                       products["AF"]["bytes"].alias("af_bytes"), products["NO"]["path"].alias("no_path"))


_PROD = f"WITH {ctes('products', 'product_files')}, ck AS (SELECT p.*, f.length, coalesce(f.length > 1024, false) AS ok FROM v_products AS p LEFT JOIN v_product_files AS f ON p.path = f.path)"


@query("product_integrity", f"{_PROD} SELECT chunk, product, path, length, ok FROM ck")
def product_integrity(v):
    return manifest.product_integrity(v("products"), v("product_files"))


@query("integrity_verdict", f"{_PROD} SELECT chunk, bool_and(ok) AS all_ok, count(*) FILTER (WHERE NOT ok) AS failed FROM ck GROUP BY chunk")
def integrity_verdict(v):
    return manifest.integrity_verdict(manifest.product_integrity(v("products"), v("product_files")))


@query("extent_snapshots", """SELECT l_linestatus AS chunk, arg_max(l_quantity, l_orderkey * 8 + l_linenumber + l_quantity / 100) FILTER (WHERE l_returnflag = 'A') AS pre_size,
  arg_max(l_quantity, l_orderkey * 8 + l_linenumber + l_quantity / 100) FILTER (WHERE l_returnflag <> 'A') AS post_size FROM lineitem GROUP BY 1""")
def extent_snapshots(v):
    rows = v.table("lineitem").select(
        F.col("l_linestatus").alias("chunk"), F.when(F.col("l_returnflag") == "A", "pre").otherwise("post").alias("snapshot"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber") + F.col("l_quantity") / 100).alias("ts"), F.col("l_quantity").alias("size_x"),
    )
    return merge_extents(rows).select("chunk", F.col("pre.size_x").alias("pre_size"), F.col("post.size_x").alias("post_size"))


def samples(raw, kind):
    return numeric_samples(raw.withColumnRenamed("util", f"{kind}_util_pct"), kind)


_NUM = lambda c: f"coalesce(TRY_CAST(regexp_extract({c}, '[0-9]+') AS DOUBLE), 0)"
TEL = f"""WITH {ctes('telemetry')}, s AS (SELECT host, max({_NUM('util')}) AS peak_util, avg({_NUM('util')}) AS mean_util, max({_NUM('mem_used_MB')}) AS peak_mem,
  arg_max({_NUM('mem_total_MB')}, pos) AS mem_total, count(*) AS samples, max({_NUM('swap_used_MB')}) AS swap FROM v_telemetry GROUP BY host)"""
_PCT = "CAST(100 AS DOUBLE) * peak_mem / mem_total"


@query("gpu_summary", f"""{TEL} SELECT host, peak_util, mean_util, peak_mem, mem_total, CAST(0 AS DOUBLE) AS peak_swap, samples, {_PCT} AS mem_pct, {_PCT} >= 80 AS near_capacity,
  CASE WHEN mean_util >= 90 THEN 'bound' WHEN peak_util < 50 THEN 'light' ELSE 'normal' END AS gpu_load FROM s""")
def gpu_summary(v):
    return telemetry.gpu_hints(telemetry.summarize(samples(v("telemetry"), "gpu")), R)


@query("cpu_summary", f"""{TEL} SELECT host, peak_util, mean_util, peak_mem, mem_total, swap AS peak_swap, samples, {_PCT} AS mem_pct, {_PCT} >= 85 AS near_capacity,
  swap >= 100 AS swapping FROM s""")
def cpu_summary(v):
    return telemetry.cpu_hints(telemetry.summarize(samples(v("telemetry"), "cpu")), R)


@query("streamed_cpu_summary", f"{TEL} SELECT host, peak_util, mean_util, peak_mem, mem_total, swap AS peak_swap, samples FROM s")
def streamed_cpu_summary(v):
    """The CPU summary again, kept by a stream over the whole events file."""
    schema = v.table("events").schema
    events = v.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(v.sf_dir)
    text = VIEWS["telemetry"]
    assert tables_of(text) == {"events"}
    raw = v.spark.sql(spark_text(text), events=events)
    folder = f"{shared_folder(v.spark)}/telemetry-{uuid.uuid4().hex}"
    start_summary(samples(raw, "cpu"), f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return read_summary(v.spark, f"{folder}/rows")
