import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from tests.tiff_bytes import ASCII, RATIONAL, SHORT, tiff
from transectra.operators.telemetry import cpu_hints, gpu_hints, summarize
from transectra.sources import images, tables, telemetry
from transectra.sources.tiff import with_tags

BASE = [(0x010F, ASCII, "Canon"), (0x0110, ASCII, "Canon PowerShot S120"), (0x013B, ASCII, " Artist é "),
        (0x8298, ASCII, "Public Domain"), (0x0131, ASCII, "Adobe Photoshop 24"), (0x0112, SHORT, 6), (0x010E, ASCII, "abc")]
GPS = [(1, ASCII, "N"), (2, RATIONAL, [(24, 1), (30, 1), (3600, 100)]), (3, ASCII, "W"), (4, RATIONAL, [(81, 1), (15, 1), (0, 1)])]


@pytest.fixture(scope="module")
def tagged(spark):
    files = {
        "plain": tiff(BASE), "big": tiff(BASE, order=">"), "exif": tiff(BASE, exif=[(0x9003, ASCII, "2022:07:15 14:32:00")]),
        "gps": tiff(BASE, gps=GPS), "gps_big": tiff(BASE, exif=[(0x9003, ASCII, "x")], gps=GPS, order=">"), "bare": tiff(),
        "root_date": tiff([(0x9003, ASCII, "root")], exif=[(0x9003, ASCII, "sub")]),
        "bad_gps": tiff(gps=[(1, ASCII, "N"), (2, RATIONAL, [(24, 1), (30, 0), (0, 1)])]),
        "corrupt": b"this is not a tiff", "empty": b"", "header": b"II*\x00", "far": b"II*\x00\xff\xff\xff\x7f", "cut": tiff(BASE)[:40],
        "late_cut": tiff(BASE)[:-25], "blank": tiff([(0x013B, ASCII, "   ")]), "zero": b"II*\x00\x08\x00\x00\x00\x00\x00",
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "name string, content binary")
    return {r.name: r for r in with_tags(df).drop("content").collect()}


def test_tags(tagged):
    for name in ("plain", "big", "exif", "gps", "gps_big"):
        r = tagged[name]
        assert (r.width, r.height, r.exif_make, r.exif_model) == (4000, 3000, "Canon", "Canon PowerShot S120")
        assert (r.exif_artist, r.exif_copyright, r.software, r.orientation) == ("Artist é", "Public Domain", "Adobe Photoshop 24", 6)
        assert r.exif_image_description == "abc" and r.read_errors == []
    assert tagged["exif"].exif_datetime_original == "2022:07:15 14:32:00"
    assert tagged["gps_big"].exif_datetime_original == "x"
    assert tagged["root_date"].exif_datetime_original == "root"
    for name in ("gps", "gps_big"):
        assert tagged[name].gps_lat == pytest.approx(24.51) and tagged[name].gps_lon == pytest.approx(-81.25)
    assert tagged["bad_gps"].gps_lat is None and tagged["bad_gps"].gps_lon is None


def test_files_without_tags(tagged):
    r = tagged["bare"]
    assert (r.width, r.height, r.exif_make, r.exif_artist, r.orientation, r.read_errors) == (4000, 3000, None, None, None, [])
    assert tagged["blank"].exif_artist is None


@pytest.mark.parametrize("name", ["corrupt", "empty", "header", "far", "cut", "zero"])
def test_damaged_files_give_an_error(tagged, name):
    r = tagged[name]
    assert len(r.read_errors) == 1 and r.read_errors[0].startswith("not_a_valid_image: ")
    assert r.width is None and r.exif_make is None


def test_value_outside_the_file_is_null(tagged):
    r = tagged["late_cut"]
    assert r.width == 4000 and r.exif_copyright is None and r.read_errors == []


@pytest.fixture
def survey(tmp_path):
    site = tmp_path / "SiteA"
    site.mkdir()
    for name in ("20230711_EDR_T1_C2_000197.tif", "20230711_EDR_T1_C2_000001.TIF", "20230711_EDR_t3_C2_000002.tiff", "other.tif"):
        (site / name).write_bytes(tiff(BASE))
    (site / "ignore.txt").write_bytes(b"")
    (site / "x.tifx").write_bytes(b"")
    (site / "sub").mkdir()
    (site / "sub" / "deep.tif").write_bytes(b"")
    return site


def test_listing_reads_no_content(spark, survey):
    df = images.list_images(spark, str(survey))
    assert sorted(r.name for r in df.collect()) == [
        "20230711_EDR_T1_C2_000001.TIF", "20230711_EDR_T1_C2_000197.tif", "20230711_EDR_t3_C2_000002.tiff", "other.tif"]
    assert {r.relpath.split("/")[0] for r in df.collect()} == {"SiteA"}
    assert "content" not in df._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_catalogue_reuses_known_hashes(spark, survey):
    known = spark.createDataFrame([("other.tif", "feed"), ("20230711_EDR_T1_C2_000197.tif", "")], "name string, sha256 string")
    rows = {r.name: r for r in images.catalogue_images(spark, str(survey), known).collect()}
    assert len(rows) == 4 and rows["other.tif"].sha256 == "feed"
    want = hashlib.sha256((survey / "20230711_EDR_T1_C2_000197.tif").read_bytes()).hexdigest()
    assert rows["20230711_EDR_T1_C2_000197.tif"].sha256 == want
    assert rows["other.tif"].site == "SiteA" and rows["other.tif"].size_bytes == len(tiff(BASE))


def test_transect_layout(spark, survey, tmp_path):
    flat = tmp_path / "flat"
    flat.mkdir()
    for p in survey.glob("*.tif*"):
        (flat / p.name).write_bytes(b"x")
    rows = {r.name: r.label for r in images.transect_layout(spark, str(flat)).collect()}
    assert rows["20230711_EDR_t3_C2_000002.tiff"] == "EDR_T3" and rows["other.tif"] is None
    assert [r.label for r in images.transect_layout(spark, str(flat), "edr_t3").collect()] == ["EDR_T3"]
    with pytest.raises(FileNotFoundError):
        images.transect_layout(spark, str(flat), "EDR_T9")
    folders = tmp_path / "folders"
    for label in ("EDR_T1", "EDR_T8"):
        (folders / label).mkdir(parents=True)
        (folders / label / "a.tif").write_bytes(b"x")
    assert sorted(r.label for r in images.transect_layout(spark, str(folders)).collect()) == ["EDR_T1", "EDR_T8"]
    assert [r.label for r in images.transect_layout(spark, str(folders), "edr_t8").collect()] == ["EDR_T8"]
    bad = {r.name: r.path for r in images.known_bad(images.list_images(spark, str(flat))).collect()}
    assert bad["20230711_EDR_T1_C2_000197.tif"].endswith("000197.tif") and bad["20230711_EDR_T1_C2_000218.tif"] is None
    listing = images.list_images(spark, str(flat))
    assert images.with_known_bad(listing.filter("name = 'other.tif'"), listing).count() == 2
    assert images.with_known_bad(listing, listing).count() == 3


METADATA = ["id", "uuid", "image_id", "credit", "preservedfilename", "cammake", "cammodel", "artist", "copyright", "dtoriginal", "lat", "lng"]


def test_metadata_csv(spark, tmp_path):
    path = tmp_path / "m.csv"
    lines = [
        ["1", "u1", "10", "", "A.TIF", "Canon", "", "x", "NaN", "2023-07-12 14:39:55+00:00", "24.45913", "-81.84534"],
        ["2", "", "11", "", "b.tif", "Canon", "m", '"line one\nline ""two"""', "c", "", "oops", ""],
        ["3", "u3", "12", "", "  ", "Canon", "m", "x", "c", "", "1", "2"],
        ["4", "u4", "13", "", " a.tif ", "Last", "m", "x", "c", "", "1", "2"],
    ]
    path.write_text("\n".join(",".join(row) for row in [METADATA, *lines]) + "\n")
    rows = {r.key: r for r in tables.read_metadata_csv(spark, str(path), multi_line=True).collect()}
    assert set(rows) == {"a.tif", "b.tif"}
    assert (rows["a.tif"].csv_cammake, rows["a.tif"].image_id, rows["a.tif"].csv_lon) == ("Last", 13, 2.0)
    b = rows["b.tif"]
    assert (b.csv_artist, b.csv_uuid, b.csv_lat, b.csv_lon, b.csv_dtoriginal_utc) == ('line one\nline "two"', "", None, None, None)
    (tmp_path / "short.csv").write_text("uuid,image_id\nu,1\n")
    with pytest.raises(ValueError, match="lacks columns"):
        tables.read_metadata_csv(spark, str(tmp_path / "short.csv"))
    path.write_text(",".join(METADATA) + "\n" + ",".join(["1", "u", "ten", "", "a.tif"] + [""] * 7) + "\n")
    with pytest.raises(Exception, match="bad image_id"):
        tables.read_metadata_csv(spark, str(path)).collect()


def test_last_row_wins_across_files_and_splits(spark, tmp_path):
    for part in range(3):
        body = "".join(f"f{i % 50}.tif,{part * 1000 + i}\n" for i in range(1000))
        (tmp_path / f"{part}.csv").write_text("preservedfilename,image_id\n" + body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        raw = tables.read_csv_text(spark, str(tmp_path), multi_line=False).withColumn("pos", tables.line_order())
        assert raw.select("preservedfilename", "image_id", "pos").rdd.getNumPartitions() > 5
        got = tables.last_row_per_key(raw.select("preservedfilename", "image_id", "pos"), "preservedfilename", "pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.preservedfilename: int(r.image_id) for r in got} == {f"f{i}.tif": 2950 + i for i in range(50)}


def test_manifest_csv(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("url,name,size,parent_item_id,extra\nhttp://h/a.tif,A.tif,10,p,1\n  ,x,1,,\nhttp://h/d/b.tif,,,,z\n")
    rows = [tuple(r)[:4] for r in tables.read_manifest_csv(spark, str(path)).orderBy("pos").collect()]
    assert rows == [("http://h/a.tif", "A.tif", 10, "p"), ("http://h/d/b.tif", "b.tif", None, None)]
    path.write_text("url\nhttp://h/d/b.tif\n")
    assert tables.read_manifest_csv(spark, str(path)).first()["name"] == "b.tif"
    path.write_text("link\nx\n")
    with pytest.raises(ValueError, match="url"):
        tables.read_manifest_csv(spark, str(path))
    path.write_text("url,size\nhttp://h/b.tif,big\n")
    with pytest.raises(Exception, match="bad size"):
        tables.read_manifest_csv(spark, str(path)).collect()


def test_image_list(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_text("public_path,filename,file_size,x\nhttp://h/1,2023_EDR_T1.tif,7,\n,2023_EDR_T2.tif,7,\nhttp://h/3,2023_edr_T1.tif,7,\nhttp://h/4,2023_WS_T1.tif,7,\n")
    assert [tuple(r) for r in tables.read_image_list(spark, str(path), "EDR").collect()] == [("http://h/1", "2023_EDR_T1.tif", "7")]
    path.write_text("filename\nx\n")
    with pytest.raises(ValueError, match="public_path"):
        tables.read_image_list(spark, str(path), "EDR")


def test_catalogue(spark, tmp_path):
    items = [
        {"id": "i1", "title": "Site: Eastern_Dry_Rocks Imagery", "files": [
            {"name": "a.TIF", "url": "http://h/a", "size": 5, "contentType": "image/tiff"}, {"name": "b.tiff", "url": "", "downloadUri": "http://h/b"},
            {"name": "c.tif"}, {"name": "d.txt", "url": "http://h/d"}]},
        {"id": "i2", "title": "Western", "files": [{"name": "z.tif", "url": "http://h/z"}]}, {"id": "i3", "title": "EasternDryRocks"},
    ]
    (tmp_path / "items.json").write_text(json.dumps(items))
    rows = tables.read_catalogue(spark, str(tmp_path / "items.json"), "EasternDryRocks").orderBy("name").collect()
    assert [(r.url, r["name"], r["size"], r.parent_item_id) for r in rows] == [("http://h/a", "a.TIF", 5, "i1"), ("http://h/b", "b.tiff", None, "i1")]
    with pytest.raises(LookupError):
        tables.read_catalogue(spark, str(tmp_path / "items.json"), "Nowhere")


def test_json_documents(spark, tmp_path):
    (tmp_path / "x1.json").write_text(json.dumps([{"SourceFile": "/a/b/x.tif", "AttributionURL": " u ", "Credit": ""}, {"SourceFile": "y.tif", "Contact": "c"}]))
    (tmp_path / "x2.json").write_text(json.dumps([{"SourceFile": "/q/x.tif", "Credit": "later"}]))
    xmp = {r.name: r for r in tables.read_xmp_json(spark, [str(tmp_path / "x1.json"), str(tmp_path / "x2.json")]).collect()}
    assert xmp["x.tif"].iptc_credit == "later" and xmp["x.tif"].xmp_attribution_url is None and xmp["y.tif"].iptc_contact == "c"
    (tmp_path / "p.json").write_text(json.dumps({"schema": "s", "files": [{"name": "a", "sha256": "1"}, {"name": "b", "sha256": "2"}]}, indent=2))
    assert sorted(map(tuple, tables.read_provenance(spark, str(tmp_path / "p.json"), multi_line=True).collect())) == [("a", "1"), ("b", "2")]
    assert tables.read_provenance(spark, None).count() == 0
    (tmp_path / "d.json").write_text(json.dumps({"experiment": "e", "decision": {"verdict": "DECIDED", "chosen_arm": "manual", "rationale": "r"}}, indent=1))
    assert tuple(tables.read_decisions(spark, str(tmp_path / "d.json"), multi_line=True).first()) == ("e", "DECIDED", "manual", "r")
    (tmp_path / "r.json").write_text(json.dumps({"chunks": [{"label": "T1", "cameras_total": 4, "cameras_aligned": 3, "has_dsm": True}]}, indent=1))
    run = tables.read_run_manifest(spark, str(tmp_path / "r.json"), multi_line=True).first()
    assert (run.label, run.cameras_aligned, run.has_dsm, run.markers) == ("T1", 3, True, None)


def test_point_attributes(spark, tmp_path):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "x double, confidence int")
    df.write.parquet(str(tmp_path / "p"))
    points = tables.read_points(spark, str(tmp_path / "p"))
    assert not tables.has_attribute(points) and not tables.has_attribute(points.drop("confidence"))
    assert tables.has_attribute(points.withColumn("confidence", F.lit(3)))


def test_telemetry_newest_file(spark, tmp_path):
    host = tmp_path / "h1"
    host.mkdir()
    header = "timestamp,gpu_util_pct,mem_util_pct,mem_used_MB,mem_total_MB\n"
    (host / "gpu_1.csv").write_text(header + "t, 100, 1, 9, 10\n")
    (host / "gpu_2.csv").write_text(header + "t1, 99, 1, 1636, 23034\nt2, [N/A], 1, , 23034\nt3, 0, 1, 5, 24000\n")
    os.utime(host / "gpu_1.csv", (1_000_000, 1_000_000))
    got = summarize(telemetry.read_telemetry(spark, str(tmp_path / "*" / "gpu_*.csv"), "gpu")).first()
    assert (got.host, got.peak_util, got.mean_util, got.peak_mem, got.mem_total, got.samples) == ("h1", 99.0, 33.0, 1636.0, 24000.0, 3)


@pytest.mark.parametrize("util, mean, mem, swap, gpu, cpu", [
    (100, 90, 80, 100, ("bound", True), (False, True)), (49, 10, 79, 99, ("light", False), (False, False)), (50, 89, 85, 0, ("normal", True), (True, False)),
])
def test_hint_thresholds(spark, util, mean, mem, swap, gpu, cpu):
    s = spark.createDataFrame([(float(util), float(mean), float(mem), 100.0, float(swap))], "peak_util double, mean_util double, peak_mem double, mem_total double, peak_swap double")
    g, c = gpu_hints(s).first(), cpu_hints(s).first()
    assert (g.gpu_load, g.near_capacity) == gpu and (c.near_capacity, c.swapping) == cpu
    assert gpu_hints(s.withColumn("mem_total", F.lit(0.0))).first().mem_pct == 0.0
