"""Dataset QC rules, computed for every site at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import severity_rank
from ..functions.geo import in_box
from ..functions.quantiles import exact_percentiles
from ..functions.text import blank_to_null, details, filename_parts
from ..joins import join_group_facts, merge_by_key
from ..profile import SurveyProfile
from ..session import stored


#: Entries of the lists in the findings' details; the whole lists are tables of their own.
FIRST_GROUPS, FIRST_FIXES, FIRST_SMALL = 10, 10, 20
#: Transects in the details of one site; a file name pattern allows few, but does not bound them.
MOST_LISTED = 200


def first_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """First ``n`` rows per key. Each task keeps its own first ``n`` before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)


def duplicate_groups(inventory: DataFrame) -> DataFrame:
    """Hashes carried by more than one file: site, sha256, files, first_name."""
    hashed = inventory.filter(F.col("sha256") != "")
    groups = hashed.groupBy("site", "sha256").agg(F.count(F.lit(1)).alias("files"), F.min("name").alias("first_name"))
    return groups.filter(F.col("files") > 1)


def duplicate_files(inventory: DataFrame) -> DataFrame:
    """Every file of every duplicate group, as rows."""
    groups = duplicate_groups(inventory).select("site", "sha256", "files")
    return join_group_facts(inventory.select("site", "sha256", "name"), groups, ["site", "sha256"])


def station_fixes(inventory: DataFrame, profile: SurveyProfile = SurveyProfile()) -> DataFrame:
    """Distinct fixes per site: from the metadata if the site has any, else from the files."""
    both = inventory.select("site", F.explode(F.array(
        F.struct(F.lit("CSV").alias("source"), F.col("csv_lat").alias("lat"), F.col("csv_lon").alias("lon")),
        F.struct(F.lit("EXIF").alias("source"), F.col("gps_lat").alias("lat"), F.col("gps_lon").alias("lon")),
    )).alias("f")).select("site", "f.*")
    fixes = both.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).distinct()
    chosen = fixes.groupBy("site").agg(F.min("source").alias("source"))  # "CSV" sorts before "EXIF"
    return fixes.join(chosen, ["site", "source"]).withColumn("inside", in_box(F.col("lat"), F.col("lon"), profile))


def size_medians(inventory: DataFrame) -> DataFrame:
    """Exact median size per site over files with a positive size."""
    sized = inventory.filter(F.col("size_bytes") > 0)
    return exact_percentiles(sized, ["site"], F.col("size_bytes"), {"median_bytes": 0.5})


def small_files(
    inventory: DataFrame, profile: SurveyProfile = SurveyProfile(), medians: DataFrame | None = None
) -> DataFrame:
    """Files below the outlier fraction of their site's median size. ``medians`` are stored already, if given."""
    sized = inventory.filter(F.col("size_bytes") > 0).select("site", "name", "size_bytes")
    limit = F.col("median_bytes") * F.lit(profile.size_outlier_fraction)
    joined = sized.join(medians, "site") if medians is not None else join_group_facts(sized, size_medians(inventory), ["site"])
    return joined.filter(F.col("size_bytes") < limit)


def transect_uuids(inventory: DataFrame, profile: SurveyProfile = SurveyProfile()) -> DataFrame:
    """Images per site, transect (matched case kept) and dive-event id; the id is null where none is given."""
    transect = filename_parts(F.col("name"), profile.filename_pattern)["transect"]
    rows = inventory.select("site", transect.alias("transect"), blank_to_null(F.col("csv_uuid")).alias("uuid"))
    return rows.filter(F.col("transect").isNotNull()).groupBy("site", "transect", "uuid").agg(F.count(F.lit(1)).alias("images"))


def transect_events(inventory: DataFrame, profile: SurveyProfile = SurveyProfile()) -> DataFrame:
    """Per site and transect: image count and distinct dive-event ids."""
    return transect_uuids(inventory, profile).groupBy("site", "transect").agg(
        F.sum("images").alias("count"), F.count("uuid").alias("uuid_count")
    )


def _facets(inventory: DataFrame, profile: SurveyProfile) -> DataFrame:
    """What the rules count, in one scan and one hash aggregation: rows (site, facet, t1, t2, d1, d2) with images, matched, sized. Stored.

    Facets: ``all``; ``hash`` (digest); ``camera`` (make, model); ``csv`` and ``exif`` fixes (lat, lon); ``event`` (transect, id).
    """
    c, text, number = F.col, F.lit(None).cast("string"), F.lit(None).cast("double")
    transect = filename_parts(c("name"), profile.filename_pattern)["transect"]
    one = lambda kind, on, t1=text, t2=text, d1=number, d2=number: F.when(on, F.struct(
        F.lit(kind).alias("facet"), t1.alias("t1"), t2.alias("t2"), d1.alias("d1"), d2.alias("d2")))
    fix = lambda kind, lat, lon: one(kind, c(lat).isNotNull() & c(lon).isNotNull(), d1=c(lat), d2=c(lon))
    facets = F.array(
        one("all", F.lit(True)), one("hash", c("sha256") != "", c("sha256")),
        one("camera", (c("exif_make") != "") & (c("exif_model") != ""), c("exif_make"), c("exif_model")),
        fix("csv", "csv_lat", "csv_lon"), fix("exif", "gps_lat", "gps_lon"),
        one("event", transect.isNotNull(), transect, blank_to_null(c("csv_uuid"))),
    )
    rows = inventory.select("site", "csv_matched", "size_bytes", F.explode(facets).alias("f")).filter(c("f").isNotNull())
    return stored(rows.groupBy("site", "f.facet", "f.t1", "f.t2", "f.d1", "f.d2").agg(
        F.count(F.lit(1)).alias("images"), F.count_if("csv_matched").alias("matched"),
        F.count_if(c("size_bytes") > 0).alias("sized")))


def site_measures(inventory: DataFrame, profile: SurveyProfile = SurveyProfile(), expected_sites: DataFrame | None = None):
    """One row per site with every number the dataset rules judge.

    One scan counts all facets, two find the median sizes, two the names of small files and of copies: pass a stored table.
    Lists are cut to their first entries before a site's are put together.
    """
    c = F.col
    facets = _facets(inventory, profile)
    medians = stored(size_medians(inventory))
    small = small_files(inventory, profile, medians).select(
        "site", F.lit("small").alias("facet"), c("name").alias("first_name"), c("size_bytes").alias("images"))
    transects = facets.filter("facet = 'event'").groupBy("site", c("t1").alias("first_name")).agg(
        F.sum("images").alias("images"), F.count("t2").alias("matched")).withColumn("facet", F.lit("transect"))
    rows = facets.filter("facet <> 'event'").withColumn("inside", in_box(c("d1"), c("d2"), profile))
    rows = rows.unionByName(small, allowMissingColumns=True).unionByName(transects, allowMissingColumns=True)
    # Texts are told apart here and by the lists only: a least text among the sums would make them sort.
    makers = facets.filter("facet = 'camera'").groupBy("site").agg(F.min("t1").alias("make"), F.min("t2").alias("model"))
    groups = facets.filter("facet = 'hash' AND images > 1").select("site", c("t1").alias("sha256"), c("images").alias("files"))
    copies = join_group_facts(inventory.select("site", "sha256", "name"), groups, ["site", "sha256"])
    copies = copies.groupBy("site", c("sha256").alias("t1")).agg(F.min("name").alias("first_name"), F.count(F.lit(1)).alias("images")).withColumn("facet", F.lit("copies"))

    of = lambda kind, value: F.when(c("facet") == kind, value)
    total = lambda kind, value="images": F.coalesce(F.sum(of(kind, c(value))), F.lit(0))
    kinds = lambda kind, on=F.lit(True): F.count_if((c("facet") == kind) & on)
    again = c("images") > 1
    sums = rows.groupBy("site").agg(
        total("all").alias("n"), total("all", "matched").alias("matched"), total("hash").alias("hashed"), total("all", "sized").alias("sized"),
        kinds("camera").alias("camera_pairs"),
        kinds("hash", again).alias("dup_groups"), F.coalesce(F.sum(F.when((c("facet") == "hash") & again, c("images"))), F.lit(0)).alias("dup_files"),
        *[kinds(k).alias(f"{k}_fixes") for k in ("csv", "exif")], *[kinds(k, ~c("inside")).alias(f"{k}_outside") for k in ("csv", "exif")],
        kinds("small").alias("small_files"), kinds("transect").alias("n_transects"), total("transect").alias("named"),
        total("transect", "matched").alias("uuid_entries"), kinds("transect", c("matched") > 1).alias("multi_event_transects"),
    )
    by_csv = c("csv_fixes") > 0
    sums = sums.withColumns({
        "fixes": F.when(by_csv, c("csv_fixes")).otherwise(c("exif_fixes")), "fixes_outside": F.when(by_csv, c("csv_outside")).otherwise(c("exif_outside")),
        "fix_source": F.when(by_csv, "CSV").when(c("exif_fixes") > 0, "EXIF"),
    })

    listed = rows.filter(c("facet").isin("csv", "exif", "small", "transect")).unionByName(copies, allowMissingColumns=True)
    # Offending transects are a list of their own, so that none hides behind the first ones.
    listed = listed.unionByName(listed.filter("facet = 'transect' AND matched > 1").withColumn("facet", F.lit("offending")))
    heads = first_n(listed, ["site", "facet"], [c("first_name"), c("t1"), c("d1"), c("d2")], MOST_LISTED)
    packed = lambda kind, item: F.transform(
        F.sort_array(F.collect_list(of(kind, F.struct("_rn", item.alias("v"))))), lambda s: s["v"])
    within = (c("facet").isin("transect", "offending")) | (c("_rn") <= F.when(c("facet") == "small", FIRST_SMALL).when(
        c("facet") == "copies", FIRST_GROUPS).otherwise(FIRST_FIXES))
    fix = F.struct(c("d1").alias("lat"), c("d2").alias("lon"))
    heads = heads.filter(within).groupBy("site").agg(
        packed("copies", F.struct(c("t1").alias("sha256"), c("images").alias("files"), "first_name")).alias("dup_heads"),
        packed("csv", fix).alias("csv_heads"), packed("exif", fix).alias("exif_heads"),
        packed("small", F.struct(c("first_name").alias("name"), c("images").alias("size_bytes"))).alias("small_heads"),
        packed("transect", F.struct(c("first_name").alias("transect"), c("images").alias("count"), c("matched").alias("uuid_count"))).alias("transects"),
        packed("offending", c("first_name")).alias("offending"),
    )
    parts = [sums, makers, heads, medians]
    if expected_sites is not None:
        parts.append(expected_sites.select("site").distinct())
    out = merge_by_key(parts, "site")
    out = out.withColumn("fix_heads", F.when(c("csv_fixes") > 0, c("csv_heads")).otherwise(c("exif_heads")))
    zero = ("n", "matched", "hashed", "sized", "camera_pairs", "dup_groups", "dup_files", "fixes", "fixes_outside",
            "small_files", "n_transects", "named", "uuid_entries", "multi_event_transects")
    out = out.withColumn("offending", F.when(F.size("transects") > 0, c("offending")))
    # No list rather than an empty one where the site has none of its kind.
    for name in ("dup_heads", "fix_heads", "small_heads", "transects"):
        out = out.withColumn(name, F.when(F.size(name) > 0, c(name)))
    return out.fillna(0, subset=list(zero))


def dataset_findings(
    inventory: DataFrame, profile: SurveyProfile = SurveyProfile(), expected_sites: DataFrame | None = None
) -> DataFrame:
    """Findings of the seven dataset rules per site; an expected site without files fails ``file_count`` alone."""
    c = F.col
    pct = F.lit(100.0) * c("matched") / c("n")
    judged = {
        "file_count": (
            F.when(c("n") == 0, "fail")
            .when(c("n").between(profile.file_count_min, profile.file_count_max), "ok").otherwise("warn"),
            details(count=c("n")),
        ),
        "dataset_camera_consistency": (
            F.when(c("camera_pairs") == 1, "ok").otherwise("warn"),
            details(pairs=c("camera_pairs"), make=c("make"), model=c("model"), count=c("n")),
        ),
        "hash_uniqueness": (
            F.when(c("hashed") == 0, "unverified").when(c("dup_groups") > 0, "fail").otherwise("ok"),
            details(groups=c("dup_groups"), files=c("dup_files"), first_groups=c("dup_heads")),
        ),
        "gps_consistency": (
            F.when(c("fixes") == 0, "unverified").when(c("fixes_outside") > 0, "fail").otherwise("ok"),
            details(unique_fixes=c("fixes"), outside=c("fixes_outside"), first_fixes=c("fix_heads"), source=c("fix_source")),
        ),
        "size_outliers": (
            F.when(c("sized") < profile.size_outlier_min_files, "unverified")
            .when(c("small_files") > 0, "warn").otherwise("ok"),
            details(median_bytes=F.floor("median_bytes"),
                    threshold_bytes=F.floor(c("median_bytes") * F.lit(profile.size_outlier_fraction)),
                    outliers=c("small_files"), examples=c("small_heads")),
        ),
        "csv_coverage": (
            F.when(c("n") == 0, "unverified").when(c("matched") == c("n"), "ok")
            .when(pct >= profile.coverage_warn_pct, "warn").otherwise("fail"),
            details(matched=c("matched"), total=c("n"), pct=pct),
        ),
        "subsite_cross_reference": (
            F.when(c("n_transects") == 0, "unverified").when(c("uuid_entries") == 0, "unverified")
            .when(c("multi_event_transects") > 0, "fail").otherwise("ok"),
            details(transects=c("transects"), multi_event_transects=c("multi_event_transects"),
                    offending=c("offending"),
                    no_filename_match_count=c("n") - c("named")),
        ),
    }
    as_struct = lambda code: F.struct(
        F.lit(code).alias("code"), judged[code][0].alias("severity"), judged[code][1].alias("details")
    )
    every = F.array(*[as_struct(code) for code in judged])
    some = F.when(c("n") == 0, F.array(as_struct("file_count"))).otherwise(every)
    measures = site_measures(inventory, profile, expected_sites)
    rows = measures.select("site", F.posexplode(some).alias("pos", "f"))
    message = F.concat(F.col("f.code"), F.lit(": "), F.col("f.severity"))
    return rows.select(
        "site", F.lit("dataset").alias("scope"), F.lit("dataset").alias("scope_kind"), "pos", "f.code", "f.severity",
        severity_rank(F.col("f.severity")).alias("rank"), message.alias("message"), "f.details",
    )
