"""Survey-shaped inputs derived from the given tables.

Each view is one SQL text that both engines run over whole tables; every source
row becomes a row. Odd values (nulls, blanks, bad text, off-convention names) are
spread over the rows by arithmetic on their ids. Engine differences are confined
to the ``SHA`` and ``THIRD`` tokens.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..profile import SurveyProfile

_P = SurveyProfile()
# Profile of the derived data: its sites are smaller than the published survey's.
PROFILE = _P.replace(file_count_min=200, file_count_max=260)


def name_of(i: str) -> str:
    """File name of row ``i``: mostly on convention, some not, some lower-case transects."""
    transect = f"CASE {i} % 3 WHEN 0 THEN 'T1' WHEN 1 THEN 'T3' ELSE CASE WHEN {i} % 20 = 2 THEN 't8' ELSE 'T8' END END"
    swath = f"CASE {i} % 2 WHEN 0 THEN 'R' ELSE 'C' END"
    return (
        f"CASE WHEN {i} % 97 = 0 THEN printf('IMG_%06d.tif', {i}) "
        f"ELSE printf('20230711_EDR_%s_%s%d_%06d.tif', {transect}, {swath}, {i} % 8 + 1, {i}) END"
    )


VIEWS: dict[str, str] = {}

# (row id, row position) pairs with many repeated ids.
VIEWS["repeats"] = """
SELECT doc_id AS id, doc_id AS pos FROM {labels}
UNION ALL SELECT conv_id AS id, 1000000000 + conv_id * 1000 + turn AS pos FROM {conversations}
"""

VIEWS["files"] = f"""
SELECT lang AS site, doc_id AS id, {name_of('doc_id')} AS name, lang || '/' || {name_of('doc_id')} AS relpath,
  n_chars AS size_bytes, CASE WHEN doc_id % 83 = 0 THEN NULL ELSE SHA(text) END AS sha256,
  CASE WHEN doc_id % 40 = 7 THEN NULL WHEN doc_id % 40 = 11 THEN 1920 WHEN doc_id % 2 = 0 THEN 4000 ELSE 3000 END AS width,
  CASE WHEN doc_id % 40 = 11 THEN 1080 WHEN doc_id % 2 = 0 THEN 3000 ELSE 4000 END AS height,
  CASE WHEN doc_id % 43 = 0 THEN NULL WHEN lang = 'de' AND doc_id % 29 = 0 THEN 'Nikon' ELSE 'Canon' END AS exif_make,
  CASE WHEN doc_id % 47 = 0 THEN '' ELSE 'Canon PowerShot S120' END AS exif_model,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE '{_P.artist}' END AS exif_artist,
  CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN 'All rights reserved' ELSE '{_P.copyright}' END AS exif_copyright,
  source AS exif_image_description, '2022:07:15 14:32:00' AS exif_datetime_original,
  CASE WHEN doc_id % 23 = 0 THEN NULL ELSE CAST('24.5' AS DOUBLE) + CAST(doc_id % 3 AS DOUBLE) / 64 END AS gps_lat,
  CASE WHEN doc_id % 31 = 0 THEN NULL ELSE CAST('-81.5' AS DOUBLE) - CAST(doc_id % 3 AS DOUBLE) / 64 END AS gps_lon,
  CASE WHEN doc_id % 50 = 0 THEN NULL WHEN doc_id % 50 < 26 THEN 'Adobe Photoshop 24.6 (Windows)'
       WHEN doc_id % 50 < 48 THEN 'Microsoft Windows Photo Viewer 10.0' ELSE 'GIMP 2.10' END AS software,
  1 AS orientation,
  CASE WHEN doc_id % 211 = 1 THEN 'open_failed: truncated' ELSE NULL END AS read_error
FROM {{documents}}
"""

VIEWS["metadata"] = f"""
SELECT id, pos, CAST(pos AS STRING) AS image_id,
  CASE WHEN id % 41 = 0 THEN ' ' WHEN id % 50 = 3 THEN 'event-x' ELSE 'event-' || CAST(id % 3 AS STRING) END AS uuid,
  CASE WHEN id % 89 = 0 THEN '' WHEN pos % 2 = 0 THEN '  ' || upper({name_of('id')}) ELSE {name_of('id')} END AS preservedfilename,
  CASE WHEN id % 31 = 0 THEN '' WHEN id % 37 = 0 THEN 'Nikon' WHEN id % 2 = 0 THEN 'CANON' ELSE 'Canon' END AS cammake,
  CASE WHEN id % 17 = 0 THEN 'NaN' WHEN id % 19 = 0 THEN 'Canon EOS' ELSE 'Canon PowerShot S120' END AS cammodel,
  CASE WHEN id % 3 = 0 THEN '' ELSE '{_P.artist}' END AS artist,
  CASE WHEN id % 4 = 0 THEN 'n/a' ELSE '{_P.copyright}' END AS copyright,
  CASE WHEN id % 13 = 0 THEN '' WHEN id % 13 = 1 THEN 'yesterday' WHEN id % 13 = 2 THEN '2023'
       WHEN id % 13 = 3 THEN '20220715T143200'
       WHEN id % 13 = 4 THEN '2023-07-19T00:00:00+05:00' WHEN id % 13 = 5 THEN '2023-07-19 00:00:01-04:00'
       ELSE CAST(DATE '2022-07-01' + CAST(id * 7 % 400 AS INT) AS STRING)
            || CASE id % 4 WHEN 0 THEN ' 14:39:55+00:00' WHEN 1 THEN 'T23:30:00+05:00' WHEN 2 THEN '' ELSE 'T08:15:30.250Z' END
  END AS dtoriginal,
  CASE WHEN id % 53 = 0 THEN 'unknown' WHEN id % 333 = 5 THEN '26.0' ELSE '24.5' || CAST(id % 3 AS STRING) END AS lat,
  CASE WHEN id % 59 = 0 THEN '' ELSE '-81.4' || CAST(id % 3 AS STRING) END AS lng
FROM ({VIEWS['repeats']}) AS r
"""

VIEWS["xmp"] = f"""
SELECT pos, '/survey/in/' || {name_of('id')} AS SourceFile,
  CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN 'https://example.org/other' ELSE ' {_P.attribution_url} ' END AS AttributionURL,
  CASE WHEN id % 6 = 0 THEN '' ELSE 'https://example.org/meta' END AS ExternalMetadataLink,
  CAST(NULL AS STRING) AS UsageTerms,
  CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN '   ' ELSE 'credit line' END AS Credit,
  'contact' AS Contact
FROM ({VIEWS['repeats']}) AS r
"""

VIEWS["known_hashes"] = f"""
SELECT {name_of('item_id')} AS name, CASE WHEN item_id % 3 = 0 THEN '' ELSE SHA(text) END AS sha256 FROM {{benchmark}}
"""

VIEWS["manifest"] = f"""
SELECT doc_id AS pos, CASE WHEN doc_id % 101 = 0 THEN '  ' ELSE 'https://files.example.org/survey/' || {name_of('doc_id')} END AS url,
  CASE WHEN doc_id % 7 = 0 THEN '' ELSE {name_of('doc_id')} END AS name,
  CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 11 = 0 THEN CAST(n_chars + 1 AS STRING) ELSE CAST(n_chars AS STRING) END AS size,
  source AS parent_item_id
FROM {{documents}}
"""

# What is on disk: labelled documents, and conversations as files no manifest lists.
VIEWS["listing"] = f"""
SELECT {name_of('d.doc_id')} AS name, d.n_chars AS size_bytes, SHA(d.text) AS sha256
FROM {{documents}} AS d JOIN {{labels}} AS l ON d.doc_id = l.doc_id
UNION ALL
SELECT printf('EXTRA_%06d_%d.tif', conv_id, turn) AS name, CAST(length(text) AS BIGINT) AS size_bytes, SHA(text) AS sha256
FROM {{conversations}}
"""

VIEWS["image_list"] = """
SELECT CASE WHEN doc_id % 29 = 0 THEN '' ELSE 'https://files.example.org/' || CAST(doc_id AS STRING) END AS public_path,
  '2023_' || CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE lang END || '_' || CAST(doc_id AS STRING) || '.tif' AS filename,
  CAST(n_chars AS STRING) AS file_size
FROM {documents}
"""

VIEWS["page_items"] = """
SELECT page_id, CAST(page_id AS STRING) AS id, url AS title,
  CASE WHEN page_id % 4 = 0 THEN printf('P_%d.TIF', page_id) WHEN page_id % 4 = 1 THEN printf('P_%d.txt', page_id)
       ELSE printf('P_%d.tiff', page_id) END AS file_name,
  CASE WHEN page_id % 5 = 0 THEN '' WHEN page_id % 5 = 1 THEN NULL ELSE url END AS file_url,
  CASE WHEN page_id % 10 = 0 THEN NULL ELSE 'https://mirror.example.org/' || CAST(page_id AS STRING) END AS download_uri,
  CAST(length(html) AS BIGINT) AS size
FROM {pages}
"""

VIEWS["cameras"] = """
SELECT event_type AS chunk, printf('cam_%08d', event_id) AS label,
  CASE event_id % 20 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'bad' WHEN 3 THEN ' 0.5 ' WHEN 4 THEN '0.30'
       ELSE '0.' || printf('%04d', CAST(floor(value * 20) AS INT) % 10000) END AS quality_raw,
  event_id % 17 <> 0 AS enabled, user_id % 3 <> 0 AS aligned,
  user_id % 2 = 0 AS aligned_q050, user_id % 10 <> 0 AS aligned_q030
FROM {events}
"""

VIEWS["arm_points"] = """
SELECT CASE l_suppkey % 5 WHEN 0 THEN 'signup' WHEN 1 THEN 'purchase' WHEN 2 THEN 'error' WHEN 3 THEN 'view' ELSE 'click' END AS chunk,
  CASE WHEN l_partkey % 3 = 0 AND l_suppkey % 5 <> 2 THEN 'q050' ELSE 'q030' END AS arm, l_quantity AS x, l_discount * 100 + l_linenumber AS y,
  CAST(floor(l_extendedprice) AS DOUBLE) / 16384 AS z
FROM {lineitem}
"""
VIEWS["arm_runs"] = """
SELECT CASE o_custkey % 5 WHEN 0 THEN 'signup' WHEN 1 THEN 'purchase' WHEN 2 THEN 'error' WHEN 3 THEN 'view' ELSE 'click' END AS chunk,
  CASE WHEN o_orderkey % 2 = 0 THEN 'q050' ELSE 'q030' END AS arm, o_orderkey % 900 AS seconds
FROM {orders}
"""

VIEWS["arms"] = """
SELECT o_custkey AS experiment, CASE WHEN o_orderstatus = 'F' OR o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'fallback' ELSE 'manual' END AS arm,
  CASE WHEN max(o_totalprice) > 450000 THEN NULL ELSE max(o_totalprice) / 1000000 END AS rms,
  CAST(100 - count(*) AS DOUBLE) AS aligned_pct
FROM {orders} GROUP BY 1, 2
"""

VIEWS["cloud"] = """
SELECT l_linestatus AS chunk, l_quantity AS x, l_discount * 100 + l_linenumber AS y, CAST(floor(l_extendedprice) AS DOUBLE) / 16384 AS z,
  CAST(l_orderkey % 256 AS SMALLINT) AS confidence, l_returnflag AS cls
FROM {lineitem}
"""

VIEWS["tie_points"] = """
SELECT l_linestatus AS chunk, l_orderkey * 8 + l_linenumber AS track_id, l_quantity AS ru, l_discount * 50 AS pa,
  CAST(l_orderkey % 8 AS DOUBLE) / 16 AS re, l_linenumber <> 7 AS valid
FROM {lineitem}
"""

VIEWS["projections"] = """
SELECT l_linestatus AS chunk, l_suppkey AS camera, l_partkey AS track_id,
  CAST(l_linenumber - 4 AS DOUBLE) / 8 AS ex, CAST(l_suppkey % 5 - 2 AS DOUBLE) / 16 AS ey
FROM {lineitem}
"""
VIEWS["projection_cameras"] = """
SELECT DISTINCT l_linestatus AS chunk, s_suppkey AS label, s_acctbal > 0 AS aligned
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey
"""
VIEWS["projection_points"] = """
SELECT DISTINCT l_linestatus AS chunk, p_partkey AS track_id, p_size <= 40 AS valid
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""

_axis = lambda i: (
    f"CASE WHEN vec_id % 17 = 0 THEN NULL WHEN vec_id % 19 = 0 THEN CAST('0.5' AS DOUBLE) ELSE CAST(THIRD({i}) AS DOUBLE) END"
)
VIEWS["markers"] = f"""
SELECT 'c' || CAST(label AS STRING) AS chunk, vec_id AS pos, printf('target %06d', vec_id) AS label,
  {_axis(1)} AS x, {_axis(2)} AS y, {_axis(3)} AS z
FROM {{embeddings}}
"""

VIEWS["scalebars"] = """
SELECT 'c' || CAST(c_nationkey AS STRING) AS chunk, c_name AS label, CAST('0.25' AS DOUBLE) AS defined_distance_m,
  CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST('0.001' AS DOUBLE) END AS accuracy_m
FROM {customer}
"""

VIEWS["telemetry"] = """
SELECT event_type AS host, event_id AS pos, CAST(ts AS STRING) AS timestamp,
  CASE WHEN event_id % 50 = 0 THEN '[N/A]' ELSE ' ' || CAST(CAST(floor(value) AS BIGINT) % 101 AS STRING) || ' ' END AS util,
  CASE WHEN event_id % 70 = 0 THEN '' ELSE ' ' || CAST(CAST(floor(value * 40) AS BIGINT) AS STRING) || ' MiB' END AS mem_used_MB,
  CASE WHEN event_id % 2 = 0 THEN ' 23034' ELSE ' 24576' END AS mem_total_MB,
  CAST(user_id AS STRING) AS swap_used_MB
FROM {events}
"""

_stage_name = (
    "CASE o_custkey % 9 WHEN 0 THEN 'import' WHEN 1 THEN 'step4' WHEN 2 THEN 'align' WHEN 3 THEN 'markers' "
    "WHEN 4 THEN 'reduce' WHEN 5 THEN 'dense' WHEN 6 THEN 'filter' WHEN 7 THEN 'dsm' ELSE 'ortho' END"
)
VIEWS["stage_stats"] = f"""
SELECT o_orderpriority || CAST(o_custkey % 7 AS STRING) AS chunk, {_stage_name} AS stage, o_orderkey AS ts,
  printf('{{{{"order": %d}}}}', o_orderkey) AS payload
FROM {{orders}}
"""
VIEWS["stage_facts"] = f"""
SELECT printf('t%d', o_orderkey) AS chunk, {_stage_name} AS stage, o_orderkey % 400 AS disabled,
  o_totalprice / 500000 AS alignment_rate, o_orderkey % 4 AS markers_detected, o_orderkey % 5 AS scalebars_present,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST('1.5' AS DOUBLE) END AS transform_scale, o_orderkey % 6 <> 0 AS has_cloud,
  (o_orderkey % 5) * 40000000 AS cells, o_orderkey % 7 <> 0 AS has_elevation
FROM {{orders}}
"""
VIEWS["work"] = f"""
SELECT DISTINCT c_mktsegment AS segment, o_orderpriority || CAST(c_custkey % 9 AS STRING) AS chunk, {_stage_name} AS stage
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey
"""
VIEWS["chunk_facts"] = """
SELECT o_orderpriority || CAST(o_custkey % 7 AS STRING) AS chunk, o_orderpriority || CAST(o_custkey % 7 AS STRING) AS label,
  count(*) AS cameras_total, count(CASE WHEN o_orderstatus <> 'O' THEN 1 END) AS cameras_aligned,
  count(DISTINCT o_custkey) AS markers, count(CASE WHEN o_totalprice > 480000 THEN 1 END) AS scalebars,
  max(o_totalprice) > 100000 AS has_dense, max(o_totalprice) > 499900 AS has_dsm, min(o_totalprice) < 1010 AS has_ortho
FROM {orders} GROUP BY 1, 2
"""
VIEWS["products"] = """
SELECT CAST(s_suppkey AS STRING) AS chunk, p_name AS product, CAST(s_suppkey AS STRING) || '/' || p_name AS path
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {part} ON l_partkey = p_partkey
GROUP BY s_suppkey, p_name
"""
VIEWS["product_files"] = """
SELECT CASE WHEN l_returnflag = 'N' THEN 'draft/' ELSE '' END || CAST(l_suppkey AS STRING) || '/' || p_name AS path,
  CAST(max(l_quantity) * 22 AS BIGINT) AS length
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
GROUP BY 1
"""
VIEWS["chunk_products"] = """
SELECT o_orderpriority || CAST(o_custkey % 7 AS STRING) AS chunk, l_returnflag || l_linestatus AS product,
  o_orderpriority || CAST(o_custkey % 7 AS STRING) || '/' || l_returnflag || l_linestatus AS path, CAST(sum(l_quantity) AS BIGINT) AS bytes
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY 1, 2, 3
"""


def tables_of(text: str) -> set[str]:
    return set(re.findall(r"(?<!\{)\{(\w+)\}", text))


# Three coordinates that all 64 values of a vector take part in: the greatest of each third.
def _spark_third(m: re.Match) -> str:
    i = int(m[1])
    return f"array_max(slice(embedding, {22 * i - 21}, {20 if i == 3 else 22}))"


def _duck_third(m: re.Match) -> str:
    i = int(m[1])
    return f"list_max(embedding[{22 * i - 21}:{64 if i == 3 else 22 * i}])"


def spark_text(text: str) -> str:
    return re.sub(r"SHA\(([\w.]+)\)", r"sha2(\1, 256)", re.sub(r"THIRD\((\d)\)", _spark_third, text))


def duck_text(text: str) -> str:
    text = re.sub(r"SHA\(([\w.]+)\)", r"sha256(\1)", re.sub(r"THIRD\((\d)\)", _duck_third, text))
    return text.format(**{t: t for t in tables_of(text)})


def ctes(*names: str) -> str:
    """``WITH`` list for the oracle side; views are prefixed ``v_``."""
    return ", ".join(f"v_{n} AS ({duck_text(VIEWS[n])})" for n in names)


class Views:
    """Derived inputs as DataFrames for one session and data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __call__(self, name: str) -> DataFrame:
        text = VIEWS[name]
        return self.spark.sql(spark_text(text), **{t: self.table(t) for t in tables_of(text)})
