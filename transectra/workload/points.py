"""Point-table and marker queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import markers, points, residuals
from ..profile import ReconstructionProfile
from ..session import durable
from .registry import query
from .views import ctes

R = ReconstructionProfile()
CLOUD, TIES = f"WITH {ctes('cloud')}", f"WITH {ctes('tie_points')}"

_STEP = "CASE WHEN ru > 30 THEN 'reconstruction_uncertainty' WHEN pa > 3.5 THEN 'projection_accuracy' WHEN re > 0.3 THEN 'reprojection_error' END"


@query("gradual_selection", f"{TIES} SELECT chunk, coalesce({_STEP}, 'kept') AS step, count(*) AS points FROM v_tie_points GROUP BY 1, 2")
def gradual_selection(v):
    return points.selection_counts(points.gradual_selection(v("tie_points"), R))


@query("tie_point_steps", f"{TIES} SELECT chunk, track_id, {_STEP} AS step FROM v_tie_points")
def tie_point_steps(v):
    return points.gradual_selection(v("tie_points"), R).select("chunk", "track_id", "step")


@query("reduction_record", f"""{TIES}, {ctes('scalebars')} SELECT p.chunk, sqrt(avg(re * re)) AS rms_pre,
  sqrt(avg(re * re) FILTER (WHERE {_STEP} IS NULL)) AS rms_post,
  (SELECT count(*) FROM v_scalebars AS s WHERE s.chunk = p.chunk) AS scalebars_present FROM v_tie_points AS p GROUP BY p.chunk""")
def reduction_record(v):
    return residuals.reduction_record(points.gradual_selection(v("tie_points"), R), v("scalebars"))


@query("filter_unit_rms", f"""{TIES} SELECT chunk, sqrt(avg(re * re)) AS rms, count(re) AS residuals FROM v_tie_points GROUP BY chunk""")
def filter_unit_rms(v):
    return residuals.filter_unit_rms(v("tie_points"))


@query("filter_unit_rms_valid", f"""{TIES} SELECT chunk, sqrt(avg(re * re)) AS rms, count(re) AS residuals FROM v_tie_points WHERE valid GROUP BY chunk""")
def filter_unit_rms_valid(v):
    return residuals.filter_unit_rms(v("tie_points"), valid_only=True)


@query("residual_rms", f"""WITH {ctes('projections', 'projection_cameras', 'projection_points')}, r AS (
  SELECT p.chunk, sqrt(sum(ex * ex + ey * ey) / count(*)) AS rms, count(*) AS projections_used FROM v_projections AS p
  JOIN v_projection_cameras AS c ON p.chunk = c.chunk AND p.camera = c.label AND c.aligned
  JOIN v_projection_points AS t ON p.chunk = t.chunk AND p.track_id = t.track_id AND t.valid GROUP BY p.chunk)
  SELECT *, CASE WHEN rms BETWEEN 0.27 AND 0.52 THEN 'WITHIN' WHEN rms < 0.27 THEN 'BELOW' ELSE 'ABOVE' END AS envelope
  FROM (SELECT chunk, rms, CAST(projections_used AS BIGINT) AS projections_used FROM r)""")
def residual_rms(v):
    return residuals.residual_rms(v("projections"), v("projection_cameras"), v("projection_points"), R)


@query("confidence_filter", f"""{CLOUD} SELECT chunk, cls, count(*) AS points, sum(x) AS sum_x, min(confidence) AS min_confidence FROM v_cloud
  WHERE confidence >= 2 GROUP BY chunk, cls""")
def confidence_filter(v):
    kept = points.drop_low_confidence(v("cloud"), 2.7)
    return kept.groupBy("chunk", "cls").agg(F.count(F.lit(1)).alias("points"), F.sum("x").alias("sum_x"), F.min("confidence").alias("min_confidence"))


@query("noise_report", f"""{CLOUD} SELECT chunk, count(*) AS points_before, count(*) FILTER (WHERE confidence >= 2) AS points_after,
  count(*) FILTER (WHERE confidence < 2) AS removed, count(*) FILTER (WHERE confidence < 2) / CAST(count(*) AS DOUBLE) AS removed_fraction,
  count(*) FILTER (WHERE confidence < 2) = 0 AS nothing_removed FROM v_cloud GROUP BY chunk""")
def noise_report(v):
    return points.noise_report(v("cloud"), R.noise_confidence_threshold)


_T = R.sweep_thresholds
_LO = (0, *_T[:-1])
_VALUES = ", ".join(f"({lo}, {t})" for lo, t in zip(_LO, _T))


@query("confidence_sweep", f"""{CLOUD}, t(lo, threshold) AS (VALUES {_VALUES}), s AS (SELECT c.chunk, t.lo, t.threshold, count(*) AS n,
  count(*) FILTER (WHERE confidence >= t.lo AND confidence < t.threshold) AS b, count(*) FILTER (WHERE confidence < t.threshold) AS r
  FROM v_cloud AS c, t GROUP BY ALL) SELECT chunk, lo, threshold, b AS in_bucket, r AS removed, n - r AS survivors,
  CAST(100 AS DOUBLE) * b / n AS bucket_pct, CAST(100 AS DOUBLE) * r / n AS removed_pct, CAST(100 AS DOUBLE) * (n - r) / n AS survivor_pct FROM s""")
def confidence_sweep(v):
    return points.confidence_sweep(v("cloud"), _T)


@query("class_counts", f"{CLOUD} SELECT chunk, cls, count(*) AS points FROM v_cloud GROUP BY chunk, cls")
def class_counts(v):
    return points.class_counts(v("cloud"))


_EXT = "count(*) AS point_count, " + ", ".join(f"min({a}) AS min_{a}, max({a}) AS max_{a}, max({a}) - min({a}) AS size_{a}" for a in "xyz")


@query("extent", f"{CLOUD} SELECT chunk, {_EXT} FROM v_cloud GROUP BY chunk")
def extent(v):
    return points.extent(v("cloud"))


@query("crop_confidence", f"{CLOUD} SELECT chunk, {_EXT} FROM v_cloud WHERE NOT confidence BETWEEN 0 AND 2 GROUP BY chunk")
def crop_confidence(v):
    return points.extent(points.crop_confidence(v("cloud"), 0, 2))


@query("reclassify", f"""{CLOUD} SELECT chunk, CASE WHEN cls = 'A' AND confidence BETWEEN 0 AND 99 THEN 'low_point' ELSE cls END AS cls,
  count(*) AS points FROM v_cloud GROUP BY 1, 2""")
def reclassify(v):
    return points.class_counts(points.reclassify(v("cloud"), "A", "low_point", 0, 99))


@query("remove_classes", f"""{CLOUD} SELECT chunk, cls, count(*) AS points FROM v_cloud
  WHERE NOT (cls IN ('A', 'N') AND confidence BETWEEN 10 AND 200) GROUP BY 1, 2""")
def remove_classes(v):
    return points.class_counts(points.remove_classes(v("cloud"), ["A", "N"], 10, 200))


_C, _S = (25.0, 8.0, 2.5), (20.0, 6.0, 3.0)
_ROT = ((0.875, 0.5, 0.0), (-0.5, 0.875, 0.0), (0.0, 0.0, 1.0))
_IN = ("abs(0.875 * (x - 25) + 0.5 * (y - 8)) <= 10 AND abs(-0.5 * (x - 25) + 0.875 * (y - 8)) <= 3 AND abs(z - 2.5) <= 1.5")
_DBL = "SELECT chunk, cls, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM v_cloud"


@query("select_region", f"{CLOUD} SELECT chunk, cls, count(*) AS points FROM ({_DBL}) WHERE {_IN} GROUP BY 1, 2")
def select_region(v):
    return points.class_counts(points.select_region(v("cloud"), _C, _S, _ROT))


@query("select_region_inverted", f"""{CLOUD} SELECT chunk, cls, count(*) AS points FROM ({_DBL})
  WHERE NOT (x BETWEEN 15 AND 35 AND y BETWEEN 5 AND 11 AND z BETWEEN 1 AND 4) GROUP BY 1, 2""")
def select_region_inverted(v):
    return points.class_counts(points.select_region(v("cloud"), _C, _S, invert=True))


_KEEP = {
    "remove_range": "NOT confidence BETWEEN 0 AND 2", "crop_range": "NOT confidence BETWEEN 0 AND 2",
    "crop_inverse_range": "NOT confidence BETWEEN 2 AND 255", "remove_classes_in_range": "NOT confidence BETWEEN 0 AND 2",
    "clean_below": "confidence >= 2",
}


@query("removal_variants", f"{CLOUD} " + " UNION ALL ".join(
    f"SELECT chunk, '{k}' AS variant, count(*) AS before, count(*) FILTER (WHERE {c}) AS after, count(*) - count(*) FILTER (WHERE {c}) AS removed "
    "FROM v_cloud GROUP BY chunk" for k, c in _KEEP.items()))
def removal_variants(v):
    return points.compare_removals(v("cloud"), points.removal_variants(2))


_GRID = f"""{CLOUD}, g AS (SELECT c.chunk, CAST(floor((x - x0) / CAST(0.5 AS DOUBLE)) AS BIGINT) AS ix, CAST(floor((y - y0) / CAST(0.5 AS DOUBLE)) AS BIGINT) AS iy,
  max(z) AS z_max, avg(z) AS z_mean, count(*) AS n FROM v_cloud AS c
  JOIN (SELECT chunk, min(x) AS x0, min(y) AS y0 FROM v_cloud GROUP BY chunk) AS o ON c.chunk = o.chunk GROUP BY 1, 2, 3)"""


@query("elevation_grid", f"{_GRID} SELECT * FROM g")
def elevation_grid(v):
    return points.elevation_grid(v("cloud"), 0.5)


@query("grid_summary", f"""{_GRID}, s AS (SELECT chunk, max(ix) + 1 AS width, max(iy) + 1 AS height, count(*) AS filled FROM g GROUP BY chunk)
  SELECT *, width * height AS cells, width * height - filled AS holes FROM s""")
def grid_summary(v):
    return points.grid_summary(points.elevation_grid(v("cloud"), 0.5))


_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
MRK = f"""WITH {ctes('markers')}, nn AS (SELECT chunk, pos, label, nn_pos, nn_label, distance FROM (
  SELECT a.chunk, a.pos, a.label, b.pos AS nn_pos, b.label AS nn_label, {_D} AS distance,
    row_number() OVER (PARTITION BY a.chunk, a.pos ORDER BY {_D}, b.pos) AS rn
  FROM v_markers AS a JOIN v_markers AS b ON a.chunk = b.chunk AND a.pos <> b.pos
  WHERE a.x IS NOT NULL AND a.y IS NOT NULL AND a.z IS NOT NULL AND b.x IS NOT NULL AND b.y IS NOT NULL AND b.z IS NOT NULL) WHERE rn = 1),
mu0 AS (SELECT a.chunk, a.pos AS a_pos, a.label AS a_label, b.pos AS b_pos, b.label AS b_label, a.distance FROM nn AS a JOIN nn AS b
  ON a.chunk = b.chunk AND a.nn_pos = b.pos AND b.nn_pos = a.pos AND a.pos < b.pos),
mu AS (SELECT m.*, d.median_distance, NOT distance BETWEEN CAST(0.6 AS DOUBLE) * median_distance AND CAST(1.4 AS DOUBLE) * median_distance AS is_outlier
  FROM mu0 AS m JOIN (SELECT chunk, median(distance) AS median_distance FROM mu0 GROUP BY chunk) AS d ON m.chunk = d.chunk),
pl AS (SELECT chunk, a_pos AS pos, a_label AS label FROM mu UNION SELECT chunk, b_pos, b_label FROM mu)"""


@query("nearest_markers", f"{MRK} SELECT * FROM nn")
def nearest_markers(v):
    return markers.nearest_neighbours(v("markers"))


def pairs(m):
    return markers.mutual_pairs(durable(markers.nearest_neighbours(m)))


@query("mutual_marker_pairs", f"{MRK} SELECT * FROM mu")
def mutual_marker_pairs(v):
    return pairs(v("markers"))


@query("paired_labels", f"{MRK} SELECT * FROM pl")
def paired_labels(v):
    return markers.paired_labels(pairs(v("markers")))


@query("orphan_markers", f"{MRK} SELECT m.chunk, m.pos, m.label FROM v_markers AS m WHERE NOT EXISTS (SELECT 1 FROM pl WHERE pl.chunk = m.chunk AND pl.pos = m.pos)")
def orphan_markers(v):
    m = v("markers")
    return markers.orphans(m, pairs(m))


@query("marker_report", f"""{MRK} SELECT m.chunk, m.pos, m.label, m.x IS NOT NULL AND m.y IS NOT NULL AND m.z IS NOT NULL AS is_reconstructed,
  nn.nn_label, nn.distance, coalesce(p.b_label, q.a_label) AS partner, coalesce(p.is_outlier, q.is_outlier) AS is_outlier,
  p.a_pos IS NULL AND q.b_pos IS NULL AS is_orphan FROM v_markers AS m LEFT JOIN nn ON m.chunk = nn.chunk AND m.pos = nn.pos
  LEFT JOIN mu AS p ON m.chunk = p.chunk AND m.pos = p.a_pos LEFT JOIN mu AS q ON m.chunk = q.chunk AND m.pos = q.b_pos""")
def marker_report(v):
    return markers.marker_report(v("markers")).drop("x", "y", "z")


@query("marker_facts", f"""WITH {ctes('markers', 'scalebars')}, a AS (SELECT chunk, 1 AS m, 0 AS s FROM v_markers UNION ALL SELECT chunk, 0, 1 FROM v_scalebars)
  SELECT chunk, CAST(sum(m) AS BIGINT) AS markers, CAST(sum(s) AS BIGINT) AS scalebars FROM a GROUP BY chunk""")
def marker_facts(v):
    return markers.fact_counts(v("markers"), v("scalebars"))
