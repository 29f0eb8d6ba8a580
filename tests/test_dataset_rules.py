import json

import pytest

from transectra.operators import dataset_rules as dr
from transectra.operators import report
from transectra.operators.image_rules import image_findings


def severities(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.site, {})[r.code] = r.severity
    return out


def test_rules_by_site(spark, good, table, profile):
    p = profile.replace(file_count_min=10, file_count_max=20)
    rows = [good(i, site="good") for i in range(12)]
    rows += [good(i, site="few") for i in range(9)]
    rows += [good(i, site="twins", sha256="a" * 64 if i < 3 else f"{i:064x}") for i in range(12)]
    rows += [good(i, site="nohash", sha256=None if i % 2 else "") for i in range(12)]
    rows += [good(i, site="cameras", exif_model="other" if i == 3 else "Canon PowerShot S120") for i in range(12)]
    rows += [good(i, site="nocamera", exif_make="") for i in range(12)]
    rows += [good(i, site="small", size_bytes=39 if i == 0 else 100) for i in range(12)]
    rows += [good(i, site="edge", size_bytes=40 if i == 0 else 100) for i in range(12)]
    rows += [good(i, site="outside", csv_lat=26.0 if i == 5 else 24.5) for i in range(12)]
    rows += [good(i, site="csvfix", gps_lat=50.0) for i in range(12)]
    rows += [good(i, site="exiffix", csv_lat=None, gps_lat=24.5 + (i % 2) / 100) for i in range(12)]
    rows += [good(i, site="nofix", csv_lat=None, gps_lat=None) for i in range(12)]
    rows += [good(i, site="partial", csv_matched=i != 0) for i in range(12)]
    rows += [good(i, site="unmatched", csv_matched=i > 5) for i in range(12)]
    rows += [good(i, site="mixed", csv_uuid=f"u{i % 2}") for i in range(12)]
    rows += [good(i, site="blankuuid", csv_uuid="" if i % 2 else "u") for i in range(12)]
    rows += [good(i, site="nouuid", csv_uuid="") for i in range(12)]
    rows += [good(i, site="nonames", name=f"IMG_{i}.tif") for i in range(12)]
    rows += [good(i, site="case", name=f"20220715_EDR_{'T8' if i % 2 else 't8'}_R1_{i:06d}.tif", csv_uuid=f"u{i % 2}") for i in range(12)]
    expected = spark.createDataFrame([("good",), ("absent",)], "site string")
    findings = dr.dataset_findings(table(rows), p, expected)
    got = severities(findings)
    assert list(got["good"]) and set(got["good"].values()) == {"ok"}
    assert got["absent"] == {"file_count": "fail"}
    assert got["few"]["file_count"] == "warn" and got["few"]["size_outliers"] == "unverified"
    assert got["twins"]["hash_uniqueness"] == "fail" and got["nohash"]["hash_uniqueness"] == "unverified"
    assert got["cameras"]["dataset_camera_consistency"] == "warn"
    assert got["nocamera"]["dataset_camera_consistency"] == "warn"
    assert got["small"]["size_outliers"] == "warn"
    assert got["edge"]["size_outliers"] == "ok"  # exactly 0.4 of the median is not an outlier
    assert got["outside"]["gps_consistency"] == "fail"
    assert got["csvfix"]["gps_consistency"] == "ok" and got["exiffix"]["gps_consistency"] == "ok"
    assert got["nofix"]["gps_consistency"] == "unverified"
    assert got["partial"]["csv_coverage"] == "warn" and got["unmatched"]["csv_coverage"] == "fail"
    assert got["mixed"]["subsite_cross_reference"] == "fail"
    assert got["blankuuid"]["subsite_cross_reference"] == "ok"
    assert got["nouuid"]["subsite_cross_reference"] == "unverified"
    assert got["nonames"]["subsite_cross_reference"] == "unverified"
    assert got["case"]["subsite_cross_reference"] == "ok"  # matched case is kept apart

    details = {(r.site, r.code): json.loads(r.details) for r in findings.collect()}
    twins = details["twins", "hash_uniqueness"]
    assert twins["groups"] == 1 and twins["files"] == 3 and twins["first_groups"][0]["files"] == 3
    assert details["outside", "gps_consistency"]["first_fixes"] == [{"lat": 24.5, "lon": good(1)["csv_lon"]}, {"lat": 26.0, "lon": good(1)["csv_lon"]}]
    order = [r.code for r in findings.filter("site = 'good'").orderBy("pos").collect()]
    assert order == ["file_count", "dataset_camera_consistency", "hash_uniqueness", "gps_consistency", "size_outliers",
                     "csv_coverage", "subsite_cross_reference"]


def test_duplicate_files_are_listed_whole(good, table):
    rows = [good(i, sha256="a" * 64) for i in range(40)] + [good(100)]
    assert dr.duplicate_files(table(rows)).count() == 40


@pytest.fixture(scope="module")
def finding_rows():
    return "site string, scope string, scope_kind string, pos int, code string, severity string, rank int"


def test_ties_go_to_the_first(spark, finding_rows):
    rows = [
        ("a", "f1", "image", 1, "x", "warn", 1), ("a", "f1", "image", 9, "y", "unverified", 1),
        ("a", "f2", "image", 8, "x", "unverified", 1), ("a", "f2", "image", 9, "y", "warn", 1),
        ("a", "f3", "image", 0, "x", "ok", 0), ("a", "dataset", "dataset", 4, "d", "unverified", 1),
        ("b", "f1", "image", 0, "x", "ok", 0), ("b", "f0", "image", 7, "x", "fail", 2), ("b", "dataset", "dataset", 0, "d", "warn", 1),
    ]
    df = spark.createDataFrame(rows, finding_rows)
    overall = {r.site: r.overall_severity for r in report.overall_severity(df).collect()}
    assert overall == {"a": "unverified", "b": "fail"}
    worst = {(r.site, r.scope): r.severity for r in report.worst_per_file(df).collect()}
    assert worst["a", "f1"] == "warn" and worst["a", "f2"] == "unverified" and worst["a", "f3"] == "ok"
    assert ("a", "dataset") not in worst
    assert [r.scope for r in report.files_with(df.filter("site = 'a'"), "warn").collect()] == ["f1"]
    gate = {r.site: r.blocked for r in report.strict_gate(df).collect()}
    assert gate == {"a": False, "b": True}
    assert not any(r.blocked for r in report.strict_gate(df, strict=False).collect())


def test_published_survey_numbers(spark, table, good, profile):
    """3,271 images in transects of 2,424, 522 and 325; 1,563 of them touched by the viewer."""
    from pyspark.sql import functions as F

    t = F.when(F.col("id") < 2424, "T1").when(F.col("id") < 2946, "T3").otherwise("T8")
    base = table([good(0)]).drop("name", "sha256", "size_bytes", "software", "csv_uuid")
    inv = spark.range(3271).withColumns({
        "name": F.format_string("20230711_EDR_%s_C3_%06d.tif", t, F.col("id")),
        "sha256": F.sha2(F.col("id").cast("string"), 256), "size_bytes": F.lit(17_000_000) + F.col("id"), "csv_uuid": t,
        "software": F.when(F.col("id") < 1563, "Microsoft Windows Photo Viewer 10").otherwise("Adobe Photoshop 24"),
    }).join(base, F.lit(1) == 1).drop("id")
    images, dataset = image_findings(inv, profile), dr.dataset_findings(inv, profile)
    table_rows = {r.code: (r.ok, r.warn, r.fail, r.unverified) for r in report.rollup(images).collect()}
    assert table_rows.pop("software_lineage") == (1708, 1563, 0, 0)
    assert set(table_rows.values()) == {(3271, 0, 0, 0)} and len(table_rows) == 10
    assert {r.severity for r in dataset.collect()} == {"ok"}
    assert report.overall_severity(report.all_findings(dataset, images)).first().overall_severity == "warn"
    assert report.files_with(images, "warn").count() == 1563 and report.files_with(images, "fail").count() == 0
    events = {r.transect: (r["count"], r.uuid_count) for r in dr.transect_events(inv, profile).collect()}
    assert events == {"T1": (2424, 1), "T3": (522, 1), "T8": (325, 1)}
