"""Inventory, rules, report and layout queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, geo, text
from ..operators import dataset_rules, decisions, image_rules, inventory, layout, manifest, report, statistics
from ..sources.images import known_bad, label_by_name, with_known_bad
from ..sources.tables import metadata_records, xmp_records
from ..session import stored as store
from .registry import query
from .views import PROFILE as P
from .views import ctes, duck_text


def files(v):
    errors = F.when(F.col("read_error").isNotNull(), F.array("read_error")).otherwise(F.array().cast("array<string>"))
    return v("files").withColumn("read_errors", errors)


def build(v):
    return inventory.assemble_inventory(
        files(v), metadata_records(v("metadata")), xmp_records(v("xmp"), "pos"), v("known_hashes")
    )


def stored(v):
    """The inventory computed once, for queries that scan it several times."""
    return store(build(v))


_cell = lambda c: f"nullif(trim(CASE WHEN {c} IN ('', 'NaN', 'n/a') THEN '' ELSE {c} END), '')"
_tag = lambda c: f"nullif(trim({c}), '')"

MD = ctes("metadata") + f""", md AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT lower(trim(preservedfilename)) AS key, CAST(image_id AS BIGINT) AS image_id, coalesce({_cell('uuid')}, '') AS csv_uuid,
      {_cell('cammake')} AS csv_cammake, {_cell('cammodel')} AS csv_cammodel, {_cell('artist')} AS csv_artist,
      {_cell('copyright')} AS csv_copyright, {_cell('dtoriginal')} AS csv_dtoriginal_utc,
      TRY_CAST(nullif(lat, '') AS DOUBLE) AS csv_lat, TRY_CAST(nullif(lng, '') AS DOUBLE) AS csv_lon,
      row_number() OVER (PARTITION BY lower(trim(preservedfilename)) ORDER BY pos DESC) AS rn
    FROM v_metadata WHERE trim(preservedfilename) <> '') WHERE rn = 1)"""
XM = ctes("xmp") + f""", xm AS (
  SELECT name, xmp_attribution_url, xmp_external_metadata_link, xmp_usage_terms, iptc_credit, iptc_contact FROM (
    SELECT split_part(SourceFile, '/', 4) AS name, {_tag('AttributionURL')} AS xmp_attribution_url,
      {_tag('ExternalMetadataLink')} AS xmp_external_metadata_link, {_tag('UsageTerms')} AS xmp_usage_terms,
      {_tag('Credit')} AS iptc_credit, {_tag('Contact')} AS iptc_contact,
      row_number() OVER (PARTITION BY SourceFile ORDER BY pos DESC) AS rn
    FROM v_xmp) WHERE rn = 1)"""
INV = f"""{ctes('files', 'known_hashes')}, {MD}, {XM}, inv AS (
  SELECT f.* EXCLUDE (sha256), coalesce(nullif(k.sha256, ''), f.sha256) AS sha256, m.* EXCLUDE (key),
    m.key IS NOT NULL AS csv_matched, x.* EXCLUDE (name)
  FROM v_files AS f LEFT JOIN v_known_hashes AS k ON f.name = k.name
    LEFT JOIN md AS m ON lower(f.name) = m.key LEFT JOIN xm AS x ON f.name = x.name)"""

_or = lambda a, b: f"coalesce(nullif({a}, ''), nullif({b}, ''))"
_RX = P.filename_pattern
_BOX = lambda la, lo: (
    f"({la} BETWEEN {P.bbox_south} AND {P.bbox_north} AND {lo} BETWEEN {P.bbox_west} AND {P.bbox_east})"
)
CLOCK = lambda c: (
    f"CASE WHEN regexp_matches({c}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN TRY_CAST({c} AS TIMESTAMP) "
    f"WHEN regexp_matches({c}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]') THEN "
    f"TRY_CAST(replace(regexp_extract({c}, '^[^+Z]{{11}}[0-9:.]+'), 'T', ' ') AS TIMESTAMP) "
    f"WHEN regexp_matches({c}, '^\\d{{8}}T\\d{{6}}$') THEN try_strptime({c}, '%Y%m%dT%H%M%S') END"
)
_CODES = {
    "csv_join": "CASE WHEN csv_matched THEN 'ok' ELSE 'fail' END",
    "software_lineage": f"CASE WHEN software LIKE '{P.software_ok_prefix}%' THEN 'ok' "
                        f"WHEN software LIKE '{P.software_warn_prefixes[0]}%' THEN 'warn' ELSE 'fail' END",
    "filename_pattern": f"CASE WHEN regexp_matches(name, '{_RX}', 'i') THEN 'ok' ELSE 'fail' END",
    "camera_consistency": f"CASE WHEN lower({_or('csv_cammake', 'exif_make')}) = 'canon' AND "
                          f"regexp_matches({_or('csv_cammodel', 'exif_model')}, '{P.camera_model_pattern}', 'i') "
                          "THEN 'ok' ELSE 'fail' END",
    "dimensions": "CASE WHEN (width = 4000 AND height = 3000) OR (width = 3000 AND height = 4000) THEN 'ok' ELSE 'fail' END",
    "exif_artist": f"CASE WHEN {_or('csv_artist', 'exif_artist')} = '{P.artist}' THEN 'ok' ELSE 'fail' END",
    "exif_copyright": f"CASE WHEN {_or('csv_copyright', 'exif_copyright')} = '{P.copyright}' THEN 'ok' ELSE 'fail' END",
    "datetime_original": "CASE WHEN csv_dtoriginal_utc IS NULL THEN 'unverified' "
                         f"WHEN {CLOCK('csv_dtoriginal_utc')} BETWEEN TIMESTAMP '{P.date_min}' AND TIMESTAMP '{P.date_max}' "
                         "THEN 'ok' ELSE 'warn' END",
    "gps_present": f"CASE WHEN {_BOX('coalesce(csv_lat, gps_lat)', 'coalesce(csv_lon, gps_lon)')} THEN 'ok' ELSE 'fail' END",
    "xmp_attribution_url": "CASE WHEN xmp_attribution_url IS NULL THEN 'unverified' "
                           f"WHEN xmp_attribution_url = '{P.attribution_url}' THEN 'ok' ELSE 'fail' END",
    "iptc_credit": f"CASE WHEN iptc_credit IS NOT NULL THEN 'ok' WHEN {_or('csv_artist', 'exif_artist')} IS NOT NULL "
                   f"AND {_or('csv_copyright', 'exif_copyright')} IS NOT NULL THEN 'warn' ELSE 'fail' END",
}
_RANK = "CASE severity WHEN 'fail' THEN 2 WHEN 'ok' THEN 0 ELSE 1 END"
_arms = " UNION ALL ".join(
    f"SELECT site, name AS scope, {i} AS pos, '{code}' AS code, {case} AS severity FROM inv WHERE read_error IS NULL"
    for i, (code, case) in enumerate(_CODES.items())
)
IMG = f"""{INV}, img AS (SELECT *, {_RANK} AS rank FROM ({_arms} UNION ALL
  SELECT site, name AS scope, 0 AS pos, 'read_errors' AS code, 'fail' AS severity FROM inv WHERE read_error IS NOT NULL))"""

DS = f"""{IMG},
cnt AS (SELECT site, count(*) AS n, count(*) FILTER (WHERE csv_matched) AS matched, count(nullif(sha256, '')) AS hashed,
  count(*) FILTER (WHERE size_bytes > 0) AS sized FROM inv GROUP BY site),
cam AS (SELECT site, count(*) AS pairs FROM (SELECT DISTINCT site, exif_make, exif_model FROM inv
  WHERE exif_make <> '' AND exif_model <> '') GROUP BY site),
dup AS (SELECT site, sha256, count(*) AS files, min(name) AS first_name FROM inv WHERE sha256 <> '' GROUP BY ALL HAVING count(*) > 1),
fix0 AS (SELECT DISTINCT site, 'CSV' AS source, csv_lat AS lat, csv_lon AS lon FROM inv WHERE csv_lat IS NOT NULL AND csv_lon IS NOT NULL
  UNION SELECT DISTINCT site, 'EXIF', gps_lat, gps_lon FROM inv WHERE gps_lat IS NOT NULL AND gps_lon IS NOT NULL),
fix AS (SELECT *, {_BOX('lat', 'lon')} AS inside FROM fix0 WHERE (site, source) IN (SELECT (site, min(source)) FROM fix0 GROUP BY site)),
med AS (SELECT site, median(size_bytes) AS median_bytes FROM inv WHERE size_bytes > 0 GROUP BY site),
small AS (SELECT i.site, i.name, i.size_bytes, m.median_bytes FROM inv AS i JOIN med AS m ON i.site = m.site
  WHERE i.size_bytes > 0 AND i.size_bytes < m.median_bytes * CAST(0.4 AS DOUBLE)),
tr AS (SELECT site, regexp_extract(name, '{_RX}', 3, 'i') AS transect, count(*) AS "count", count(DISTINCT nullif(csv_uuid, '')) AS uuid_count
  FROM inv WHERE regexp_matches(name, '{_RX}', 'i') GROUP BY 1, 2),
msr AS (SELECT c.*, coalesce(cam.pairs, 0) AS pairs,
  (SELECT count(*) FROM dup WHERE dup.site = c.site) AS dup_groups,
  (SELECT count(*) FROM fix WHERE fix.site = c.site) AS fixes,
  (SELECT count(*) FROM fix WHERE fix.site = c.site AND NOT inside) AS fixes_outside,
  (SELECT count(*) FROM small WHERE small.site = c.site) AS small_files,
  (SELECT count(*) FROM tr WHERE tr.site = c.site) AS n_transects,
  (SELECT coalesce(sum(uuid_count), 0) FROM tr WHERE tr.site = c.site) AS uuid_entries,
  (SELECT count(*) FROM tr WHERE tr.site = c.site AND uuid_count > 1) AS multi
  FROM cnt AS c LEFT JOIN cam ON c.site = cam.site),
ds AS (SELECT *, {_RANK} AS rank FROM (
  SELECT site, 0 AS pos, 'file_count' AS code, CASE WHEN n BETWEEN {P.file_count_min} AND {P.file_count_max} THEN 'ok' ELSE 'warn' END AS severity FROM msr
  UNION ALL SELECT site, 1, 'dataset_camera_consistency', CASE WHEN pairs = 1 THEN 'ok' ELSE 'warn' END FROM msr
  UNION ALL SELECT site, 2, 'hash_uniqueness', CASE WHEN hashed = 0 THEN 'unverified' WHEN dup_groups > 0 THEN 'fail' ELSE 'ok' END FROM msr
  UNION ALL SELECT site, 3, 'gps_consistency', CASE WHEN fixes = 0 THEN 'unverified' WHEN fixes_outside > 0 THEN 'fail' ELSE 'ok' END FROM msr
  UNION ALL SELECT site, 4, 'size_outliers', CASE WHEN sized < 10 THEN 'unverified' WHEN small_files > 0 THEN 'warn' ELSE 'ok' END FROM msr
  UNION ALL SELECT site, 5, 'csv_coverage', CASE WHEN matched = n THEN 'ok' WHEN 100.0 * matched / n >= 90 THEN 'warn' ELSE 'fail' END FROM msr
  UNION ALL SELECT site, 6, 'subsite_cross_reference', CASE WHEN n_transects = 0 OR uuid_entries = 0 THEN 'unverified' WHEN multi > 0 THEN 'fail' ELSE 'ok' END FROM msr))"""

_ROLL = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in classify.SEVERITIES)


@query("severity_rollup", f"WITH {IMG} SELECT code, {_ROLL} FROM img GROUP BY code")
def severity_rollup(v):
    return report.rollup(image_rules.image_findings(build(v), P))


@query("inventory", f"""WITH {INV} SELECT site, name, size_bytes, sha256, width, height, exif_make, software, csv_matched, image_id,
  csv_dtoriginal_utc, csv_cammake, csv_cammodel, csv_artist, csv_copyright, csv_lat, csv_lon, csv_uuid, xmp_attribution_url,
  iptc_credit FROM inv""")
def inventory_rows(v):
    return build(v).select(
        "site", "name", "size_bytes", "sha256", "width", "height", "exif_make", "software", "csv_matched", "image_id",
        "csv_dtoriginal_utc", "csv_cammake", "csv_cammodel", "csv_artist", "csv_copyright", "csv_lat", "csv_lon", "csv_uuid",
        "xmp_attribution_url", "iptc_credit",
    )


@query("metadata_last_row_wins", f"WITH {MD} SELECT key, image_id, csv_uuid, csv_cammake, csv_cammodel, csv_lat, csv_lon FROM md")
def metadata_last_row_wins(v):
    return metadata_records(v("metadata")).select("key", "image_id", "csv_uuid", "csv_cammake", "csv_cammodel", "csv_lat", "csv_lon")


@query("metadata_join", f"""WITH {ctes('files')}, {MD} SELECT f.name, m.key IS NOT NULL AS csv_matched, m.image_id, m.csv_uuid
  FROM v_files AS f LEFT JOIN md AS m ON lower(f.name) = m.key""")
def metadata_join(v):
    return inventory.attach_metadata(v("files"), metadata_records(v("metadata"))).select("name", "csv_matched", "image_id", "csv_uuid")


@query("xmp_join", f"""WITH {ctes('files')}, {XM} SELECT f.name, x.xmp_attribution_url, x.xmp_external_metadata_link, x.iptc_credit
  FROM v_files AS f LEFT JOIN xm AS x ON f.name = x.name""")
def xmp_join(v):
    return inventory.attach_xmp(v("files"), xmp_records(v("xmp"), "pos")).select(
        "name", "xmp_attribution_url", "xmp_external_metadata_link", "iptc_credit"
    )


@query("hash_reuse", f"""WITH {ctes('files', 'known_hashes')} SELECT f.name, coalesce(nullif(k.sha256, ''), f.sha256) AS sha256
  FROM v_files AS f LEFT JOIN v_known_hashes AS k ON f.name = k.name""")
def hash_reuse(v):
    return inventory.reuse_hashes(v("files"), v("known_hashes")).select("name", "sha256")


@query("content_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hash(v):
    return v.table("documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query("image_findings", f"WITH {IMG} SELECT site, scope, pos, code, severity, rank FROM img")
def image_findings(v):
    return image_rules.image_findings(build(v), P).select("site", "scope", "pos", "code", "severity", "rank")


def _rule_query(code):
    @query(f"rule_{code}", f"WITH {IMG} SELECT severity, count(*) AS images, min(scope) AS first_image FROM img WHERE code = '{code}' GROUP BY severity")
    def one(v):
        found = image_rules.image_findings(build(v), P).filter(F.col("code") == code)
        return found.groupBy("severity").agg(F.count(F.lit(1)).alias("images"), F.min("scope").alias("first_image"))


for _code in ("read_errors", *_CODES):
    _rule_query(_code)


@query("dataset_findings", f"WITH {DS} SELECT site, pos, code, severity, rank FROM ds")
def dataset_findings(v):
    return dataset_rules.dataset_findings(stored(v), P).select("site", "pos", "code", "severity", "rank")


@query("expected_sites", f"""WITH {DS}, exp AS (SELECT DISTINCT lang AS site FROM documents UNION SELECT DISTINCT c_mktsegment FROM customer)
  SELECT site, pos, code, severity FROM ds UNION ALL SELECT site, 0, 'file_count', 'fail' FROM exp WHERE site NOT IN (SELECT site FROM ds)""")
def expected_sites(v):
    sites = v.table("documents").select(F.col("lang").alias("site")).union(v.table("customer").select("c_mktsegment")).distinct()
    return dataset_rules.dataset_findings(stored(v), P, sites).select("site", "pos", "code", "severity")


# What the findings say in their details, by rule: evidence as text, coordinates as numbers.
_SAYS = {
    "csv_join": {"image_id": "image_id"}, "software_lineage": {"software": "software"},
    "camera_consistency": {
        "make": f"coalesce({_or('csv_cammake', 'exif_make')}, '')", "model": f"coalesce({_or('csv_cammodel', 'exif_model')}, '')",
        "source": "CASE WHEN csv_cammake <> '' THEN 'CSV' ELSE 'EXIF' END"},
    "dimensions": {"width": "width", "height": "height"},
    "exif_artist": {"actual": _or("csv_artist", "exif_artist"), "expected": f"'{P.artist}'", "source": "CASE WHEN csv_artist <> '' THEN 'CSV' ELSE 'EXIF' END"},
    "exif_copyright": {
        "actual": _or("csv_copyright", "exif_copyright"), "expected": f"'{P.copyright}'", "source": "CASE WHEN csv_copyright <> '' THEN 'CSV' ELSE 'EXIF' END"},
    "datetime_original": {"dtoriginal_utc": "csv_dtoriginal_utc"},
    "gps_present": {"lat": "coalesce(csv_lat, gps_lat)", "lon": "coalesce(csv_lon, gps_lon)", "source": "CASE WHEN csv_lat IS NOT NULL THEN 'CSV' ELSE 'EXIF' END"},
    "xmp_attribution_url": {"actual": "xmp_attribution_url", "expected": f"'{P.attribution_url}'"},
    "iptc_credit": {"actual": "iptc_credit", "artist": _or("csv_artist", "exif_artist"), "copyright": _or("csv_copyright", "exif_copyright")},
}
_TYPES = {f: "DOUBLE" if f in ("lat", "lon") else "VARCHAR" for fields in _SAYS.values() for f in fields}
_says = " UNION ALL ".join(
    f"SELECT site, name AS scope, '{code}' AS code, " + ", ".join(f"CAST({fields.get(f, 'NULL')} AS {t}) AS {f}" for f, t in _TYPES.items())
    + " FROM inv WHERE read_error IS NULL" for code, fields in _SAYS.items())
_MESSAGES = " ".join(f"WHEN i.code = '{r.code}' AND severity = '{s}' THEN '{m}'" for r in image_rules.RULES for s, m in r.messages.items())


@query("image_finding_details", f"""WITH {IMG}, d AS ({_says})
  SELECT d.*, CASE {_MESSAGES} END AS message FROM d JOIN img AS i ON i.site = d.site AND i.scope = d.scope AND i.code = d.code""")
def image_finding_details(v):
    schema = ", ".join(f"{f} {t.replace('VARCHAR', 'string').lower()}" for f, t in _TYPES.items())
    found = image_rules.image_findings(build(v), P).filter(F.col("code").isin(*_SAYS))
    return found.select("site", "scope", "code", F.from_json("details", schema).alias("d"), "message").select("site", "scope", "code", "d.*", "message")


_list = lambda item, order, n, source: (
    f"(SELECT array_to_string(list_slice(list({item} ORDER BY {order}), 1, {n}), ',') FROM {source} AS x WHERE x.site = m.site)")


@query("dataset_finding_details", f"""WITH {DS}
  SELECT m.site, m.n AS count, m.pairs, m.dup_groups AS groups, CAST((SELECT sum(files) FROM dup WHERE dup.site = m.site) AS BIGINT) AS files,
    m.fixes AS unique_fixes, m.fixes_outside AS outside, (SELECT min(source) FROM fix WHERE fix.site = m.site) AS source,
    CAST(floor(med.median_bytes) AS BIGINT) AS median_bytes, CAST(floor(med.median_bytes * CAST(0.4 AS DOUBLE)) AS BIGINT) AS threshold_bytes,
    m.small_files AS outliers, m.matched, CAST(100.0 AS DOUBLE) * m.matched / m.n AS pct, m.multi AS multi_event_transects,
    m.n - (SELECT CAST(coalesce(sum("count"), 0) AS BIGINT) FROM tr WHERE tr.site = m.site) AS no_filename_match_count,
    {_list("sha256 || ':' || files || ':' || first_name", "first_name, sha256", dataset_rules.FIRST_GROUPS, "dup")} AS first_groups,
    {_list("lat || ' ' || lon", "lat, lon", dataset_rules.FIRST_FIXES, "fix")} AS first_fixes,
    {_list("name || ':' || size_bytes", "name", dataset_rules.FIRST_SMALL, "small")} AS examples,
    {_list("transect || ':' || \"count\" || ':' || uuid_count", "transect", dataset_rules.MOST_LISTED, "tr")} AS transects,
    CASE WHEN m.n_transects > 0 THEN coalesce({_list("transect", "transect", dataset_rules.MOST_LISTED, "(SELECT * FROM tr WHERE uuid_count > 1)")}, '') END AS offending
  FROM msr AS m LEFT JOIN med ON med.site = m.site""")
def dataset_finding_details(v):
    number = {"count": "file_count", "pairs": "dataset_camera_consistency", "groups": "hash_uniqueness", "files": "hash_uniqueness",
              "unique_fixes": "gps_consistency", "outside": "gps_consistency", "median_bytes": "size_outliers", "threshold_bytes": "size_outliers",
              "outliers": "size_outliers", "matched": "csv_coverage", "multi_event_transects": "subsite_cross_reference",
              "no_filename_match_count": "subsite_cross_reference"}
    lists = {"first_groups": ("hash_uniqueness", "sha256 string, files bigint, first_name string", ":"), "first_fixes": ("gps_consistency", "lat double, lon double", " "),
             "examples": ("size_outliers", "name string, size_bytes bigint", ":"),
             "transects": ("subsite_cross_reference", "transect string, count bigint, uuid_count bigint", ":")}
    of = lambda code, value: F.max(F.when(F.col("code") == code, value))
    read = lambda field, kind: F.from_json("details", f"{field} {kind}")[field]

    def entries(field, schema, mark):
        names = [x.split()[0] for x in schema.split(", ")]
        array = read(field, f"array<struct<{', '.join(x.replace(' ', ': ') for x in schema.split(', '))}>>")
        return F.array_join(F.transform(array, lambda e: F.concat_ws(mark, *[e[n].cast("string") for n in names])), ",")

    found = dataset_rules.dataset_findings(stored(v), P)
    return found.groupBy("site").agg(
        *[of(code, read(f, "bigint")).alias(f) for f, code in number.items()], of("gps_consistency", read("source", "string")).alias("source"),
        of("csv_coverage", read("pct", "double")).alias("pct"), *[of(code, entries(f, schema, mark)).alias(f) for f, (code, schema, mark) in lists.items()],
        of("subsite_cross_reference", F.array_join(read("offending", "array<string>"), ",")).alias("offending"),
    ).withColumn("files", F.when(F.col("groups") > 0, F.col("files")))


@query("file_count", f"WITH {INV} SELECT site, count(*) AS n, count(*) BETWEEN {P.file_count_min} AND {P.file_count_max} AS in_range FROM inv GROUP BY site")
def file_count(v):
    n = report.totals(build(v)).select("site", F.col("image_count").alias("n"))
    return n.withColumn("in_range", F.col("n").between(P.file_count_min, P.file_count_max))


@query("duplicate_groups", f"WITH {DS} SELECT site, sha256, files, first_name FROM dup")
def duplicate_groups(v):
    return dataset_rules.duplicate_groups(build(v))


@query("duplicate_files", f"WITH {DS} SELECT i.site, i.sha256, i.name, d.files FROM inv AS i JOIN dup AS d ON i.site = d.site AND i.sha256 = d.sha256")
def duplicate_files(v):
    return dataset_rules.duplicate_files(stored(v))


@query("first_duplicate_groups", f"""WITH {DS} SELECT site, sha256, files, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER
  (PARTITION BY site ORDER BY first_name, sha256) AS rn FROM dup) WHERE rn <= 10""")
def first_duplicate_groups(v):
    top = dataset_rules.first_n(dataset_rules.duplicate_groups(stored(v)), ["site"], [F.col("first_name"), F.col("sha256")], 10)
    return top.select("site", "sha256", "files", F.col("_rn").alias("rn"))


@query("camera_pairs", f"""WITH {DS} SELECT DISTINCT site, exif_make, exif_model FROM inv WHERE exif_make <> '' AND exif_model <> ''""")
def camera_pairs(v):
    rows = build(v).filter((F.col("exif_make") != "") & (F.col("exif_model") != ""))
    return rows.select("site", "exif_make", "exif_model").distinct()


@query("station_fixes", f"WITH {DS} SELECT site, source, lat, lon, inside FROM fix")
def station_fixes(v):
    return dataset_rules.station_fixes(stored(v), P)


@query("size_medians", f"WITH {DS} SELECT site, median_bytes FROM med")
def size_medians(v):
    return dataset_rules.size_medians(stored(v))


@query("size_outliers", f"WITH {DS} SELECT site, name, size_bytes, median_bytes FROM small")
def size_outliers(v):
    return dataset_rules.small_files(stored(v), P).select("site", "name", "size_bytes", "median_bytes")


@query("csv_coverage", f"WITH {DS} SELECT site, matched, n, 100.0 * CAST(matched AS DOUBLE) / n AS pct FROM cnt")
def csv_coverage(v):
    t = report.totals(build(v)).select("site", F.col("csv_join_count").alias("matched"), F.col("image_count").alias("n"))
    return t.withColumn("pct", F.lit(100.0) * F.col("matched") / F.col("n"))


@query("transect_uuids", f"""WITH {DS} SELECT site, regexp_extract(name, '{_RX}', 3, 'i') AS transect, nullif(csv_uuid, '') AS uuid, count(*) AS images
  FROM inv WHERE regexp_matches(name, '{_RX}', 'i') GROUP BY 1, 2, 3""")
def transect_uuids(v):
    return dataset_rules.transect_uuids(build(v), P)


@query("transect_events", f'WITH {DS} SELECT site, transect, "count", uuid_count FROM tr')
def transect_events(v):
    return dataset_rules.transect_events(build(v), P)


_ALL = f"""{DS}, al AS (SELECT site, 'dataset' AS scope, 0 AS k, pos, code, severity, rank FROM ds
  UNION ALL SELECT site, scope, 1, pos, code, severity, rank FROM img)"""
_OVERALL = "SELECT site, arg_min(severity, (-rank, k, scope, pos)) AS overall_severity FROM al GROUP BY site"


def _findings(v):
    inv = stored(v)
    return dataset_rules.dataset_findings(inv, P), image_rules.image_findings(inv, P)


@query("all_findings", f"WITH {_ALL} SELECT site, scope, pos, code, severity FROM al")
def all_findings(v):
    return report.all_findings(*_findings(v)).select("site", "scope", "pos", "code", "severity")


@query("overall_severity", f"WITH {_ALL} {_OVERALL}")
def overall_severity(v):
    return report.overall_severity(report.all_findings(*_findings(v)))


@query("strict_gate", f"WITH {_ALL} SELECT *, overall_severity = 'fail' AS blocked FROM ({_OVERALL})")
def strict_gate(v):
    return report.strict_gate(report.all_findings(*_findings(v)))


_WORST = f"WITH {IMG}, w AS (SELECT site, scope, arg_min(severity, (-rank, pos)) AS severity FROM img GROUP BY site, scope)"


@query("worst_per_file", f"{_WORST} SELECT * FROM w")
def worst_per_file(v):
    return report.worst_per_file(image_rules.image_findings(build(v), P))


@query("image_verdicts", f"{_WORST} SELECT * FROM w")
def image_verdicts(v):
    return image_rules.image_verdicts(build(v), P).select("site", "scope", "severity")


@query("files_with_failures", f"{_WORST} SELECT site, scope FROM w WHERE severity = 'fail'")
def files_with_failures(v):
    return report.files_with(image_rules.image_findings(build(v), P), "fail")


@query("files_with_warnings", f"{_WORST} SELECT site, scope FROM w WHERE severity = 'warn'")
def files_with_warnings(v):
    return report.files_with(image_rules.image_findings(build(v), P), "warn")


@query("inventory_totals", f"""WITH {INV} SELECT site, count(*) AS image_count, count(*) FILTER (WHERE csv_matched) AS csv_join_count,
  CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM inv GROUP BY site""")
def inventory_totals(v):
    return report.totals(build(v))


@query("report_headers", f"""{_WORST.replace('WITH ' + IMG, 'WITH ' + _ALL)} SELECT o.site, o.overall_severity, t.image_count, t.total_bytes,
  f.failed_file_count, f.warned_file_count FROM ({_OVERALL}) AS o
  JOIN (SELECT site, count(*) AS image_count, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM inv GROUP BY site) AS t ON o.site = t.site
  JOIN (SELECT site, count(*) FILTER (WHERE severity = 'fail') AS failed_file_count,
        count(*) FILTER (WHERE severity = 'warn') AS warned_file_count FROM w GROUP BY site) AS f ON o.site = f.site""")
def report_headers(v):
    inv = stored(v)
    return report.report_headers(inv, dataset_rules.dataset_findings(inv, P), "doi", P).select(
        "site", "overall_severity", "image_count", "total_bytes", "failed_file_count", "warned_file_count"
    )


@query("code_by_severity", f"WITH {IMG} SELECT code, severity, count(*) AS n FROM img GROUP BY code, severity")
def code_by_severity(v):
    return statistics.code_by_severity(image_rules.image_findings(build(v), P))


@query("camera_counts", f"WITH {INV} SELECT exif_make, exif_model, count(*) AS images FROM inv WHERE exif_make IS NOT NULL AND exif_model IS NOT NULL GROUP BY ALL")
def camera_counts(v):
    return statistics.camera_counts(build(v))


_D = ("SELECT '{f}' AS field, count({c}) AS count, round(avg({c}), 9) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, "
      "quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75, max({c}) AS max FROM d")


@query("describe_inventory", f"WITH {INV}, d AS (SELECT gps_lat, gps_lon, CAST(size_bytes AS DOUBLE) / 1048576 AS size_mb FROM inv) "
       + " UNION ALL ".join(_D.format(f=f, c=f) for f in ("gps_lat", "gps_lon", "size_mb")))
def describe_inventory(v):
    out = statistics.describe(stored(v), {"gps_lat": F.col("gps_lat"), "gps_lon": F.col("gps_lon"),
                                         "size_mb": F.col("size_bytes") / F.lit(1048576.0)})
    return out.withColumns({"mean": F.round("mean", 9), "std": F.round("std", 6)})


@query("images_per_transect", f"""WITH {ctes('files')} SELECT upper(nullif(regexp_extract(name, '{P.transect_token_pattern}', 1, 'i'), '')) AS label,
  count(*) AS images FROM v_files GROUP BY 1""")
def images_per_transect(v):
    return statistics.images_per_transect(v("files"), P)


@query("inventory_head", f"WITH {INV} SELECT name, width, height, exif_make, gps_lat, gps_lon, size_bytes FROM inv ORDER BY name LIMIT 10")
def inventory_head(v):
    return inventory.head(build(v)).select("name", "width", "height", "exif_make", "gps_lat", "gps_lon", "size_bytes")


@query("filename_parts", f"""WITH {ctes('files')} SELECT name, {', '.join(f"CASE WHEN regexp_matches(name, '{_RX}', 'i') THEN regexp_extract(name, '{_RX}', {i}, 'i') END AS {p}" for i, p in enumerate(('date', 'site', 'transect', 'swath', 'seq'), 1))} FROM v_files""")
def filename_parts(v):
    return v("files").select("name", *[c.alias(k) for k, c in text.filename_parts(F.col("name"), P.filename_pattern).items()])


@query("transect_token", f"WITH {ctes('files')} SELECT name, upper(nullif(regexp_extract(name, '{P.transect_token_pattern}', 1, 'i'), '')) AS label FROM v_files")
def transect_token(v):
    return label_by_name(v("files"), P).select("name", "label")


@query("truthy_camera", f"WITH {INV} SELECT name, {_or('csv_cammake', 'exif_make')} AS make, CASE WHEN nullif(csv_cammake, '') IS NOT NULL THEN 'CSV' ELSE 'EXIF' END AS source FROM inv")
def truthy_camera(v):
    return build(v).select("name", text.truthy(F.col("csv_cammake"), F.col("exif_make")).alias("make"),
                           text.truthy_source(F.col("csv_cammake"), "CSV", "EXIF").alias("source"))


@query("coordinates_in_box", f"""WITH {INV} SELECT name, coalesce(csv_lat, gps_lat) AS lat, coalesce(csv_lon, gps_lon) AS lon,
  {_BOX('coalesce(csv_lat, gps_lat)', 'coalesce(csv_lon, gps_lon)')} AS inside FROM inv""")
def coordinates_in_box(v):
    lat, lon = F.coalesce("csv_lat", "gps_lat"), F.coalesce("csv_lon", "gps_lon")
    return build(v).select("name", lat.alias("lat"), lon.alias("lon"), geo.in_box(lat, lon, P).alias("inside"))


@query("capture_time", f"WITH {ctes('metadata')} SELECT pos, CAST({CLOCK('dtoriginal')} AS VARCHAR) AS ts, {CLOCK('dtoriginal')} BETWEEN TIMESTAMP '{P.date_min}' AND TIMESTAMP '{P.date_max}' AS in_window FROM v_metadata")
def capture_time(v):
    ts = classify.wall_clock(F.col("dtoriginal"))
    return v("metadata").select("pos", ts.cast("string").alias("ts"), classify.in_window(ts, P.date_min, P.date_max).alias("in_window"))


@query("contact_sheet_layout", f"""WITH {ctes('files')}, o AS (SELECT site, name, row_number() OVER (PARTITION BY site ORDER BY name) - 1 AS i, count(*) OVER (PARTITION BY site) AS n FROM v_files)
  SELECT site, name, i, i // 36 AS sheet, (i % 36) // 6 AS "row", (i % 36) % 6 AS col, 8 + (i % 36) % 6 * 228 AS x, 8 + (i % 36) // 6 * 191 AS y,
  'contact_sheet_' || lpad(CAST(i // 36 + 1 AS VARCHAR), CAST(greatest(3, length(CAST((n + 35) // 36 AS VARCHAR))) AS INTEGER), '0') || '.jpg' AS sheet_name,
  CASE WHEN length(name) > 31 THEN substr(name, 1, 30) || '…' ELSE name END AS caption FROM o""")
def contact_sheet_layout(v):
    return layout.contact_sheet_layout(v("files"))


@query("input_set_hashes", f"""WITH {ctes('files')}, h AS (SELECT upper(nullif(regexp_extract(name, '{P.transect_token_pattern}', 1, 'i'), '')) AS label, name,
  coalesce(sha256, '') AS sha FROM v_files) SELECT label, count(*) AS count, sha256(string_agg(name || ':' || sha, chr(10) ORDER BY name)) AS aggregate_sha256
  FROM h GROUP BY label""")
def input_set_hashes(v):
    return manifest.input_set_hashes(label_by_name(v("files"), P).select("label", "name", "sha256"))


@query("preflight_failures", f"""WITH {ctes('files')} SELECT name, read_error AS reason, contains(name, '{P.known_bad_files[0]}') OR contains(name, '{P.known_bad_files[1]}') AS known_bad
  FROM v_files WHERE read_error IS NOT NULL""")
def preflight_failures(v):
    return decisions.preflight_failures(files(v), P)


_BAD = P.replace(known_bad_files=("IMG_000097.tif", "IMG_999999.tif"))
_BAD_SQL = f"""WITH {ctes('files')}, kb AS (SELECT n.name, min(f.relpath) AS path FROM (VALUES ('IMG_000097.tif'), ('IMG_999999.tif')) AS n(name)
  LEFT JOIN v_files AS f ON f.name = n.name GROUP BY n.name)"""


@query("known_bad_lookup", f"{_BAD_SQL} SELECT name, path FROM kb")
def known_bad_lookup(v):
    return known_bad(v("files").withColumn("path", F.col("relpath")), _BAD)


@query("subset_with_known_bad", f"""{_BAD_SQL} SELECT path, split_part(path, '/', 2) AS name FROM (SELECT relpath AS path FROM v_files WHERE site = 'en'
  UNION SELECT path FROM kb WHERE path IS NOT NULL)""")
def subset_with_known_bad(v):
    images = v("files").withColumn("path", F.col("relpath"))
    return with_known_bad(images.filter(F.col("site") == "en"), images, _BAD)


@query("preflight_verdict", f"WITH {ctes('files')} SELECT count(*) AS failures, coalesce(bool_and(contains(name, 'IMG_000097.tif') OR contains(name, 'IMG_999999.tif')), true) AS all_known_bad FROM v_files WHERE read_error IS NOT NULL")
def preflight_verdict(v):
    return decisions.preflight_verdict(decisions.preflight_failures(files(v), _BAD))


@query("severity_ranks", f"WITH {IMG} SELECT DISTINCT severity, rank FROM img")
def severity_ranks(v):
    found = image_rules.image_findings(build(v), P)
    return found.select("severity", classify.severity_rank(F.col("severity")).alias("rank")).distinct()


@query("gps_from_dms", duck_text("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag IN ('A', 'R') THEN -1 ELSE 1 END *
  (l_linenumber * 10 + l_quantity / 60 + l_extendedprice / 3600) AS degrees FROM {lineitem}"""))
def gps_from_dms(v):
    ref = F.when(F.col("l_returnflag") == "A", "S").when(F.col("l_returnflag") == "R", "w").otherwise("n")
    deg = geo.dms_to_degrees((F.col("l_linenumber") * 10).cast("double"), F.col("l_quantity"), F.col("l_extendedprice"), ref)
    return v.table("lineitem").select("l_orderkey", "l_linenumber", deg.alias("degrees"))


@query("rational_values", "SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(CAST(l_linenumber - 4 AS DOUBLE), 0) AS value FROM lineitem")
def rational_values(v):
    return v.table("lineitem").select("l_orderkey", "l_linenumber", geo.ratio(F.col("l_extendedprice"), F.col("l_linenumber") - 4).alias("value"))
