import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tests.test_sources import BASE, GPS
from tests.tiff_bytes import tiff
from transectra import ReconstructionProfile
from transectra.operators import acquisition as acq
from transectra.operators import decisions, manifest, points
from transectra.operators.telemetry import summarize
from transectra.plans.acquire import plan_acquisition, record_acquisition
from transectra.plans.intake import validate_intake
from transectra.plans.reconstruction import align_record, dsm_record, filter_record, step4_record
from transectra.sinks import artefacts
from transectra.sources import tables
from transectra.sources.telemetry import read_telemetry
from transectra.sinks.snapshots import current, publish
from transectra.streaming import ledger
from transectra.streaming.intake import read_intake, start_intake
from transectra.streaming.telemetry import read_summary, start_summary, telemetry_stream, without_repeats

METADATA = "image_id,uuid,preservedfilename,cammake,cammodel,artist,copyright,dtoriginal,lat,lng\n"


@pytest.fixture
def site(tmp_path):
    folder = tmp_path / "SiteA"
    folder.mkdir()
    for i in range(12):
        (folder / f"20230711_EDR_T1_C2_{i:06d}.tif").write_bytes(tiff(BASE, gps=GPS) + bytes([i]))
    (folder / "20230711_EDR_T1_C2_000099.tif").write_bytes(b"broken")
    lines = [f"{i},u1,20230711_EDR_T1_C2_{i:06d}.TIF,Canon,Canon PowerShot S120,a,c,2023-07-11 10:00:00+00:00,24.5,-81.5\n" for i in range(12)]
    (tmp_path / "meta.csv").write_text(METADATA + "".join(lines))
    return folder


def read_json(spark, path):
    return [json.loads(r.value) for r in spark.read.text(path).collect()]


def test_validate_intake(spark, site, tmp_path, profile):
    out = str(tmp_path / "out")
    p = profile.replace(file_count_min=5, file_count_max=20, artist="a", copyright="c")
    m = spark.createDataFrame([("20230711_EDR_T1_C2_000000.tif",), ("gone.tif",)], "name string")
    gate = validate_intake(spark, str(site), out, "10.1/x", tables.read_metadata_csv(spark, str(tmp_path / "meta.csv")), manifest=m, profile=p, strict=True,
                           ids_csv_path=str(tmp_path / "meta.csv"))
    assert [tuple(r) for r in gate.collect()] == [("SiteA", "fail", True)]
    report = read_json(spark, f"{out}/qc_report")[0]
    assert report["image_count"] == 13 and report["csv_join_count"] == 12 and report["failed_file_count"] == 1 and report["package_version"]
    assert report["overall_severity"] == "fail" and report["doi"] == "10.1/x" and len(report["dataset_findings"]) == 7
    assert report["per_image_findings_rollup"]["read_errors"] == {"ok": 0, "warn": 0, "fail": 1, "unverified": 0}
    assert report["per_image_findings_rollup"]["iptc_credit"]["warn"] == 12
    assert report["metadata_lineage"]["csv_primary_fields"][0] == "cammake"
    check = report["extra_context"]["manifest_check"]
    assert {k: check[k] for k in ("expected", "on_disk", "missing", "unexpected")} == {"expected": 2, "on_disk": 13, "missing": 1, "unexpected": 12}
    assert check["first_missing"] == ["gone.tif"] and len(check["first_unexpected"]) == 12
    assert report["hostname"] and report["ids_csv_path"] == str(tmp_path / "meta.csv")
    assert spark.read.parquet(f"{out}/transect_uuids").agg({"images": "sum"}).first()[0] == 13
    assert [r["scope"] for r in read_json(spark, f"{out}/files_with_failures")] == ["20230711_EDR_T1_C2_000099.tif"]
    # xmp_attribution_url is unverified before iptc_credit warns: no file counts as warned
    assert read_json(spark, f"{out}/files_with_warnings") == []
    inv = artefacts.read_inventory(spark, f"{out}/inventory")
    assert inv.count() == 13 and inv.filter("csv_matched").select("gps_lat").distinct().first()[0] == pytest.approx(24.51)
    assert read_json(spark, current(spark, f"{out}/inventory") + "/header") == [{"count": 13, "schema": "transectra/inventory/v1"}]


def test_intake_without_metadata(spark, site, tmp_path):
    out = str(tmp_path / "bare")
    validate_intake(spark, str(site), out)
    findings = spark.read.parquet(f"{out}/findings")
    assert {r.severity for r in findings.filter("code = 'csv_join'").collect()} == {"fail"}
    assert {r.severity for r in findings.filter("code = 'datetime_original'").collect()} == {"unverified"}


def test_acquisition_round_trip(spark, tmp_path):
    m = spark.createDataFrame([(0, "u/b", "b", 2, "p"), (1, "u/a", "a", None, None)], "pos int, url string, name string, size bigint, parent_item_id string")
    written = spark.createDataFrame([("a", 1, "ha"), ("b", 2, "hb")], "name string, size_bytes bigint, sha256 string")
    empty = written.limit(0)
    plan = plan_acquisition(m, empty, empty.select("name", "sha256"))
    assert [(r.name, r.action) for r in plan.collect()] == [("b", "download"), ("a", "download")]
    record_acquisition(plan, written, "S", "10.1/x", str(tmp_path / "prov"))
    header = read_json(spark, current(spark, str(tmp_path / "prov")) + "/header")[0]
    assert (header["file_count"], header["total_bytes"], header["site"]) == (2, 3, "S")
    files = {f["name"]: f for f in read_json(spark, current(spark, str(tmp_path / "prov")) + "/files")}
    assert files["a"]["parent_item_id"] is None and files["a"]["relpath"] == "S/a" and files["b"]["notes"] == "downloaded"
    prior = artefacts.read_provenance_rows(spark, str(tmp_path / "prov"))
    again = plan_acquisition(m, written, prior)
    assert {r.action for r in again.collect()} == {"resumed"}
    with pytest.raises(ValueError, match="size differs"):
        record_acquisition(plan, written.withColumn("size_bytes", F.lit(9)), "S", "d", str(tmp_path / "bad"))


def test_small_artefacts(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    cams = spark.createDataFrame([("T1", "c1", True, False)], "chunk string, label string, enabled boolean, aligned boolean")
    artefacts.write_cameras(cams, at("cams"))
    assert read_json(spark, at("cams")) == [{"label": "c1", "enabled": True, "aligned": False}]
    bars = spark.createDataFrame([("T1", "b", 0.25, None)], "chunk string, label string, defined_distance_m double, accuracy_m double")
    artefacts.write_scalebars(bars, at("bars"))
    assert read_json(spark, at("bars")) == [{"label": "b", "defined_distance_m": 0.25, "accuracy_m": None}]
    artefacts.write_manifest_csv(spark.createDataFrame([("u", "n", "3")], "url string, name string, size string"), at("man"))
    assert tables.read_manifest_csv(spark, at("man")).first()["size"] == 3
    imgs = spark.createDataFrame([("T1", "a", "1"), ("T1", "b", "2")], "label string, name string, sha256 string")
    artefacts.write_input_hashes(imgs, at("hash"))
    head = read_json(spark, at("hash/header"))[0]
    assert head == {"transect": "T1", "count": 2, "aggregate_sha256": hashlib.sha256(b"a:1\nb:2").hexdigest()}
    arms = spark.createDataFrame([("e", "fallback", None, 0.0), ("e", "manual", 0.35, 95.0)], "experiment string, arm string, rms double, aligned_pct double")
    artefacts.write_decisions(decisions.decide_arm(arms), at("dec"))
    doc = read_json(spark, at("dec"))[0]
    assert doc["decision"]["chosen_arm"] == "manual" and doc["arms"]["fallback"]["rms"] is None
    back = tables.read_decisions(spark, at("dec"))
    assert back.first().verdict == "DECIDED"
    modes = decisions.resolve_modes(
        spark.createDataFrame([("e",), ("f",)], "chunk string"), spark.createDataFrame([], "chunk string, override string"),
        back.withColumnRenamed("experiment", "chunk"))
    assert sorted(map(tuple, modes.collect())) == [("e", "manual", "resolved"), ("f", None, "refused")]
    artefacts.write_arm_results(arms, at("arms"))
    assert len(read_json(spark, at("arms"))) == 2
    snaps = spark.createDataFrame([("T1", "pre", 1, 5.0), ("T1", "pre", 2, 6.0), ("T1", "post", 3, 1.0)], "chunk string, snapshot string, ts int, size_x double")
    artefacts.write_extents(snaps, at("ext"))
    assert read_json(spark, current(spark, at("ext"))) == [{"chunk": "T1", "pre": {"size_x": 6.0}, "post": {"size_x": 1.0}}]
    facts = spark.createDataFrame([("T1", 4)], "chunk string, cameras_total int")
    stats = spark.createDataFrame([("T1", "align", 1, "{}")], "chunk string, stage string, ts int, payload string")
    prods = spark.createDataFrame([("T1", "dense", "p", 5)], "chunk string, product string, path string, bytes bigint")
    chunks = manifest.with_run_header(manifest.run_chunks(facts, stats, prods), ["gpu"], ReconstructionProfile())
    artefacts.write_run_manifest(chunks, at("run"))
    doc = read_json(spark, current(spark, at("run")))[0]
    assert doc["stage_align"] == "{}" and doc["stage_dsm"] is None and doc["gpu_devices"] == ["gpu"]
    assert json.loads(doc["parameters"])["keypoint_limit"] == 60000
    inv = spark.createDataFrame([("n", None)], "name string, sha256 string")
    artefacts.write_inventory_json(inv, at("inv"))
    assert read_json(spark, at("inv")) == [{"name": "n", "sha256": None}]


def test_a_reader_during_a_rewrite_sees_one_version_whole(spark, tmp_path):
    path = str(tmp_path / "inv")
    table = lambda n: spark.createDataFrame([(f"n{i}", n) for i in range(n)], "name string, v int")
    artefacts.write_inventory(table(3), path)
    seen = []

    def write(folder):
        table(5).write.parquet(f"{folder}/inventory")
        # Rows of the new version are there, its header and pointer are not.
        seen.append((artefacts.read_inventory(spark, path).count(), read_json(spark, current(spark, path) + "/header")[0]["count"]))
        artefacts.write_json(spark.createDataFrame([(5,)], "count int"), f"{folder}/header")

    reader = artefacts.read_inventory(spark, path)
    publish(spark, path, write)
    assert seen == [(3, 3)] and artefacts.read_inventory(spark, path).count() == 5
    assert reader.count() == 3  # a reader that is still at the version before

    def die(folder):
        table(7).write.parquet(f"{folder}/inventory")
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        publish(spark, path, die)
    assert artefacts.read_inventory(spark, path).count() == 5
    for n in (8, 9, 10):
        artefacts.write_inventory(table(n), path)
    assert artefacts.read_inventory(spark, path).count() == 10
    versions = sorted(p.name for p in (tmp_path / "inv").iterdir() if p.name.startswith("v-"))
    assert len(versions) == 2 and current(spark, path).endswith(versions[-1])
    assert not [p for p in (tmp_path / "inv").iterdir() if p.name.startswith("_current.")]


def test_a_table_may_be_published_over_itself(spark, tmp_path):
    path = str(tmp_path / "ext")
    snaps = spark.createDataFrame([("T1", "pre", 1, 5.0)], "chunk string, snapshot string, ts int, size_x double")
    artefacts.write_extents(snaps, path)
    old = spark.read.json(current(spark, path))
    publish(spark, path, lambda folder: artefacts.write_json(old.unionByName(old), folder))
    assert len(read_json(spark, current(spark, path))) == 2


def test_stage_records(spark):
    cams = spark.createDataFrame([("T1", "a", "0.4", True, True), ("T1", "b", None, True, False)], "chunk string, label string, quality_raw string, enabled boolean, aligned boolean")
    assert json.loads(step4_record(cams).first().payload)["disabled"] == 1
    assert json.loads(align_record(cams).first().payload)["alignment_rate"] == 0.5
    cloud = spark.createDataFrame([("T1", 0.0, 0.0, 1.0, 1), ("T1", 0.05, 0.011, 2.0, 9)], "chunk string, x double, y double, z double, confidence int")
    assert json.loads(filter_record(cloud).first().payload)["removed"] == 1
    scale = spark.createDataFrame([("T1", None, [1.0])], "chunk string, transform_scale double, region_size array<double>")
    dsm = json.loads(dsm_record(cloud, scale).first().payload)
    assert (dsm["width"], dsm["height"], dsm["scale_info"]["transform_scale"]) == (6, 2, None)
    assert points.overview_resolution(10.0, 4.0) == 0.005


def test_good_records_raise_no_alarm(spark):
    """Records of all nine stages, written and parsed, for a chunk without faults and for one without anything."""
    from transectra.plans import reconstruction as rec

    make = spark.createDataFrame
    cams = make([("T1", str(i), "0.8", True, True) for i in range(4)], "chunk string, label string, quality_raw string, enabled boolean, aligned boolean")
    cloud = make([("T1", 0.0, 0.0, 1.0, 1), ("T1", 0.5, 0.5, 2.0, 9)], "chunk string, x double, y double, z double, confidence int")
    scale = make([("T1", 1.5, [1.0])], "chunk string, transform_scale double, region_size array<double>")
    both = make([("T1",), ("T2",)], "chunk string")
    records = [
        rec.import_record(cams), step4_record(cams), align_record(cams), rec.markers_record(make([("T1", 1.0)], "chunk string, x double"), both),
        rec.reduce_record(make([("T1", "bar")], "chunk string, label string"), both), rec.dense_record(scale, cloud, both),
        filter_record(cloud, chunks=both), dsm_record(cloud, scale), rec.ortho_record(make([("T1", "dsm")], "chunk string, product string"), chunks=both),
    ]
    rows = records[0]
    for r in records[1:]:
        rows = rows.unionByName(r)
    assert {r.stage for r in rows.collect()} == set(manifest.STAGES)
    found = sorted((r.chunk, r.alarm) for r in decisions.alarms(rec.typed_stages(rows)).collect())
    assert [a for c, a in found if c == "T1" and a != "empty_grid"] == []
    assert [a for c, a in found if c == "T2"] == ["no_cloud", "no_elevation", "no_markers", "no_scalebars", "not_scaled"]
    decisions.enforce(decisions.alarms(rec.typed_stages(rows.filter("chunk = 'T1' AND stage <> 'dsm'"))))


def test_later_and_conflicting_decisions(spark):
    rows = [("a", "DECIDED", "manual", 1), ("a", "DECIDED", "fallback", 2), ("b", "DECIDED", "manual", 5), ("b", "NEEDS_REVIEW", "NEEDS_REVIEW", 6)]
    decided = spark.createDataFrame(rows, "chunk string, verdict string, chosen_arm string, ts int")
    chunks, none = decided.select("chunk"), spark.createDataFrame([], "chunk string, override string")
    assert sorted((r.chunk, r.mode) for r in decisions.resolve_modes(chunks, none, decided).collect()) == [("a", "fallback"), ("b", None)]
    assert {r.mode for r in decisions.resolve_modes(chunks, none, decided.drop("ts")).collect()} == {None}


def test_an_empty_site_fails_the_gate(spark, tmp_path):
    from transectra.plans.intake import validate_intake

    (tmp_path / "in" / "Full").mkdir(parents=True)
    (tmp_path / "in" / "Empty").mkdir()
    (tmp_path / "in" / "Full" / "a.tif").write_bytes(tiff(BASE))
    gate = validate_intake(spark, str(tmp_path / "in" / "*"), str(tmp_path / "out"), strict=True)
    assert {r.site: (r.overall_severity, r.blocked) for r in gate.collect()}["Empty"] == ("fail", True)
    alone = validate_intake(spark, str(tmp_path / "in" / "Empty"), str(tmp_path / "out2"), strict=True)
    assert [(r.site, r.blocked) for r in alone.collect()] == [("Empty", True)]


def test_unlabelled_and_unhashed_images_count(spark):
    rows = [(None, "b", None), (None, "a", "1"), ("T1", "a", None), ("T1", None, "2")]
    out = manifest.input_set_hashes(spark.createDataFrame(rows, "label string, name string, sha256 string"))
    sha = lambda s: hashlib.sha256(s).hexdigest()
    assert {r.label: (r["count"], r.aggregate_sha256) for r in out.collect()} == {None: (2, sha(b"a:1\nb:")), "T1": (2, sha(b":2\na:"))}
    paths = spark.createDataFrame([("T1", "a", "9", "x/1"), ("T1", "a", "3", "x/2")], "label string, name string, sha256 string, path string")
    assert manifest.input_set_hashes(paths).first().aggregate_sha256 == sha(b"a:3")


def test_telemetry_stream_equals_batch(spark, tmp_path):
    header = "timestamp,cpu_util_pct,mem_used_MB,mem_total_MB,swap_used_MB\n"
    for host in ("h1", "h2"):
        (tmp_path / "logs" / host).mkdir(parents=True)
        rows = [f"2026/05/29 12:00:{i:02d}, {i * 3 % 101} ,{i * 100}, {6000 + i},{i % 4}\n" for i in range(30)]
        (tmp_path / "logs" / host / "cpumem_1.csv").write_text(header + "".join(rows) + "2026/05/29 12:01:00,bad,,6100,\n")
    start_summary(telemetry_stream(spark, str(tmp_path / "logs" / "*"), "cpu"), str(tmp_path / "live"), str(tmp_path / "ck")).awaitTermination()
    live = sorted(map(tuple, read_summary(spark, str(tmp_path / "live")).collect()))
    batch = summarize(read_telemetry(spark, str(tmp_path / "logs" / "*" / "*.csv"), "cpu"))
    assert live == sorted(map(tuple, batch.collect())) and len(live) == 2


def test_live_summary_writes_changed_hosts_only_and_counts_repeats_once(spark, tmp_path):
    header = "timestamp,cpu_util_pct,mem_used_MB,mem_total_MB,swap_used_MB\n"
    logs, out = tmp_path / "logs", str(tmp_path / "live")

    def add(host, file, seconds):
        (logs / host).mkdir(parents=True, exist_ok=True)
        rows = [f"2026/05/29 12:{i // 60:02d}:{i % 60:02d},{i % 50},{i},9000,0\n" for i in seconds]
        (logs / host / file).write_text(header + "".join(rows))

    def run():
        samples = without_repeats(telemetry_stream(spark, str(logs / "*"), "cpu"), "10 minutes")
        start_summary(samples, out, str(tmp_path / "ck")).awaitTermination()
        return {r.host: r.samples for r in read_summary(spark, out).collect()}

    add("h1", "a.csv", range(0, 30))
    add("h2", "a.csv", range(0, 5))
    assert run() == {"h1": 30, "h2": 5}
    add("h1", "b.csv", range(20, 40))  # ten seconds of it were there before
    assert run() == {"h1": 40, "h2": 5}
    hosts = {r.batch: r.hosts for r in spark.read.parquet(out).groupBy("batch").agg(F.array_sort(F.collect_set("host")).alias("hosts")).collect()}
    assert hosts[0] == ["h1", "h2"] and all(v == ["h1"] for b, v in hosts.items() if b > 0)
    add("h1", "c.csv", range(2400, 2401))
    run()
    add("h1", "d.csv", [41, 2402])  # forty minutes late, and in time
    assert run() == {"h1": 42, "h2": 5}


def test_incremental_intake(spark, tmp_path):
    folder = tmp_path / "in" / "S"
    folder.mkdir(parents=True)
    (folder / "a.tif").write_bytes(tiff(BASE))
    run = lambda: start_intake(spark, str(folder), str(tmp_path / "cat"), str(tmp_path / "ck")).awaitTermination()
    run()
    (folder / "b.tif").write_bytes(b"junk")
    (folder / "c.txt").write_bytes(b"x")
    run()
    run()
    rows = {r.name: r for r in read_intake(spark, str(tmp_path / "cat")).collect()}
    assert set(rows) == {"a.tif", "b.tif"} and rows["a.tif"].exif_make == "Canon" and rows["b.tif"].read_errors
    assert rows["a.tif"].sha256 == hashlib.sha256(tiff(BASE)).hexdigest()
    batches = ledger.read_ledger(spark, str(tmp_path / "cat")).orderBy("batch").collect()
    assert [(r.batch, r["rows"]) for r in batches] == [(0, 1), (1, 1)]


def test_a_batch_that_dies_before_its_ledger_row_was_never_there(spark, tmp_path):
    folder, out = tmp_path / "in" / "S", str(tmp_path / "cat")
    folder.mkdir(parents=True)
    for i in range(3):
        (folder / f"{i}.tif").write_bytes(tiff(BASE) + bytes([i]))

    def die():
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        start_intake(spark, str(folder), out, str(tmp_path / "ck"), before_ledger=die).awaitTermination()
    assert (tmp_path / "cat" / "data").is_dir() and read_intake(spark, out) is None
    start_intake(spark, str(folder), out, str(tmp_path / "ck")).awaitTermination()
    names = lambda: sorted(r.name for r in read_intake(spark, out).collect())
    assert names() == ["0.tif", "1.tif", "2.tif"]
    assert ledger.remove_unfinished(spark, out) == 1 and ledger.remove_unfinished(spark, out) == 0
    # Another checkpoint starts from nothing and adds only what is new.
    (folder / "3.tif").write_bytes(tiff(BASE))
    start_intake(spark, str(folder), out, str(tmp_path / "other")).awaitTermination()
    assert names() == ["0.tif", "1.tif", "2.tif", "3.tif"]


def test_a_batch_that_died_after_its_ledger_row_adds_nothing_again(spark, tmp_path):
    out = str(tmp_path / "cat")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "path string, v int")
    ledger.commit(rows, out, "s", 0)
    assert ledger.unseen(rows, out, "s", 0, "path").isEmpty()
    assert ledger.unseen(rows, out, "s", 1, "path").count() == 2  # its own checkpoint's business
    assert ledger.unseen(rows.unionByName(spark.createDataFrame([("c", 3)], rows.schema)), out, "t", 5, "path").collect() == [("c", 3)]
    assert sorted(map(tuple, ledger.read_committed(spark, out).collect())) == [("a", 1), ("b", 2)]
    assert ledger.remove_unfinished(spark, str(tmp_path / "none")) == 0


def test_empty_coverage(spark):
    cov = acq.manifest_coverage(spark.createDataFrame([], "name string"), spark.createDataFrame([], "name string"))
    assert tuple(acq.coverage_counts(cov).first()) == (0, 0, 0, 0)
