"""Manifest, catalogue and transfer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import acquisition as acq
from ..sources import tables
from .registry import query
from .views import PROFILE as P
from .views import ctes


def manifest(v):
    return tables.manifest_records(v("manifest"), "pos")


MAN = ctes("manifest") + """, man AS (SELECT pos, trim(url) AS url, trim(coalesce(nullif(name, ''), list_last(string_split(trim(url), '/')))) AS name,
  TRY_CAST(nullif(size, '') AS BIGINT) AS size, nullif(parent_item_id, '') AS parent_item_id FROM v_manifest WHERE trim(url) <> '')"""
COV = f"""{MAN}, {ctes('listing')}, cov AS (SELECT name, bool_or(e) AS expected, bool_or(d) AS on_disk FROM (
  SELECT name, true AS e, false AS d FROM man UNION ALL SELECT name, false, true FROM v_listing) GROUP BY name)"""


@query("manifest_rows", f"WITH {MAN} SELECT pos, url, name, size, parent_item_id FROM man")
def manifest_rows(v):
    return manifest(v)


@query("manifest_preview", f"WITH {MAN} SELECT name, size FROM man ORDER BY pos LIMIT 5")
def manifest_preview(v):
    return acq.preview(manifest(v))


def coverage(v):
    return acq.manifest_coverage(manifest(v), v("listing"))


@query("manifest_coverage", f"""WITH {COV} SELECT count(*) FILTER (WHERE expected) AS expected, count(*) FILTER (WHERE on_disk) AS on_disk,
  count(*) FILTER (WHERE expected AND NOT on_disk) AS missing, count(*) FILTER (WHERE on_disk AND NOT expected) AS unexpected FROM cov""")
def manifest_coverage(v):
    return acq.coverage_counts(coverage(v))


@query("missing_files", f"WITH {COV} SELECT name FROM cov WHERE expected AND NOT on_disk")
def missing_files(v):
    return acq.missing_files(coverage(v))


@query("first_missing_files", f"WITH {COV} SELECT name FROM cov WHERE expected AND NOT on_disk ORDER BY name LIMIT 50")
def first_missing_files(v):
    return acq.missing_files(coverage(v), 50)


@query("unexpected_files", f"WITH {COV} SELECT name FROM cov WHERE on_disk AND NOT expected")
def unexpected_files(v):
    return acq.unexpected_files(coverage(v))


@query("first_unexpected_files", f"WITH {COV} SELECT name FROM cov WHERE on_disk AND NOT expected ORDER BY name LIMIT 50")
def first_unexpected_files(v):
    return acq.unexpected_files(coverage(v), 50)


_PLAN = f"""{MAN}, {ctes('listing', 'known_hashes')}, pl AS (SELECT m.*,
  CASE WHEN l.name IS NOT NULL AND (m.size IS NULL OR m.size = l.size_bytes) AND (k.sha256 IS NULL OR k.sha256 = l.sha256)
    THEN 'resumed' ELSE 'download' END AS action,
  CASE WHEN m.size <> l.size_bytes THEN 'on-disk size ' || l.size_bytes || ' != declared ' || m.size END AS size_note
  FROM man AS m LEFT JOIN v_listing AS l ON m.name = l.name LEFT JOIN v_known_hashes AS k ON m.name = k.name)"""


@query("download_plan", f"WITH {_PLAN} SELECT pos, url, name, size, parent_item_id, action, size_note FROM pl")
def download_plan(v):
    return acq.in_input_order(acq.download_plan(manifest(v), v("listing"), v("known_hashes")))


@query("size_mismatches", f"""WITH {MAN}, {ctes('listing')} SELECT m.name, m.size, l.size_bytes AS written FROM man AS m JOIN v_listing AS l
  ON m.name = l.name WHERE m.size IS NOT NULL AND m.size <> l.size_bytes""")
def size_mismatches(v):
    return acq.size_mismatches(manifest(v), v("listing")).select("name", "size", "written")


@query("provenance_rows", f"""WITH {_PLAN} SELECT p.name, 'site/' || p.name AS relpath, l.sha256, l.size_bytes,
  CASE WHEN p.action = 'resumed' THEN 'resumed' ELSE 'downloaded' END AS notes FROM pl AS p JOIN v_listing AS l ON p.name = l.name""")
def provenance_rows(v):
    plan = acq.download_plan(manifest(v), v("listing"), v("known_hashes"))
    return acq.provenance_records(plan, v("listing"), "site").select("name", "relpath", "sha256", "size_bytes", "notes")


@query("image_list_manifest", f"""WITH {ctes('image_list')} SELECT public_path AS url, filename AS name, file_size AS size FROM v_image_list
  WHERE contains(filename, '_en_') AND public_path <> ''""")
def image_list_manifest(v):
    return tables.image_list_to_manifest(v("image_list"), "en")


def items(v):
    entry = F.struct(
        F.col("file_name").alias("name"), F.col("file_url").alias("url"), F.col("download_uri").alias("downloadUri"),
        "size", F.lit("image/tiff").alias("contentType"),
    )
    return v("page_items").select("id", "title", F.array(entry).alias("files"))


_SITE = "contains(regexp_replace(lower(title), '[^\\p{L}\\p{N}]', '', 'g'), 'examplenet')"


@query("catalogue_files", f"""WITH {ctes('page_items')} SELECT coalesce(nullif(file_url, ''), nullif(download_uri, '')) AS url, file_name AS name, size,
  id AS parent_item_id, 'image/tiff' AS content_type FROM v_page_items WHERE {_SITE} AND regexp_matches(lower(file_name), '\\.tiff?$')
  AND coalesce(nullif(file_url, ''), nullif(download_uri, '')) IS NOT NULL""")
def catalogue_files(v):
    return tables.catalogue_files(items(v), "Example_Net", P)


@query("site_title_match", f"WITH {ctes('page_items')} SELECT page_id, {_SITE} AS matches FROM v_page_items")
def site_title_match(v):
    return v("page_items").select("page_id", text.looks_like_site(F.col("title"), F.lit("Example Net")).alias("matches"))


@query("extension_filter", f"WITH {ctes('page_items')} SELECT page_id, file_name FROM v_page_items WHERE lower(file_name) LIKE '%.tif' OR lower(file_name) LIKE '%.tiff'")
def extension_filter(v):
    return v("page_items").filter(text.has_extension(F.col("file_name"), P.image_extensions)).select("page_id", "file_name")


@query("name_from_url", "SELECT page_id, list_last(string_split(url, '/')) AS name FROM pages")
def name_from_url(v):
    return v.table("pages").select("page_id", text.basename(F.col("url")).alias("name"))


_ALIASES = (("src0", "Source Zero"), ("src1", "Source One"))


@query("site_alias", """SELECT doc_id, CASE WHEN source = 'src0' THEN 'Source Zero' WHEN source = 'src1' THEN 'Source One'
  ELSE '  ' || upper(source) || ' ' END AS site FROM documents""")
def site_alias(v):
    spelled = F.concat(F.lit("  "), F.upper("source"), F.lit(" "))
    return v.table("documents").select("doc_id", text.normalize_site(spelled, _ALIASES).alias("site"))


@query("quality_scores", f"WITH {ctes('cameras')} SELECT chunk, label, TRY_CAST(trim(quality_raw) AS DOUBLE) AS q FROM v_cameras")
def quality_scores(v):
    from ..functions.classify import quality_score

    return v("cameras").select("chunk", "label", quality_score(F.col("quality_raw")).alias("q"))
