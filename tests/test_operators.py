import hashlib
import itertools
import random
import statistics

import pytest
from pyspark.sql import functions as F

from transectra import ReconstructionProfile
from transectra.operators import acquisition as acq
from transectra.operators import decisions, layout, manifest, markers, points, quality, residuals
from transectra.plans.reconstruction import typed_stages

R = ReconstructionProfile()


def test_download_plan(spark):
    m = spark.createDataFrame(
        [(i, f"u/{n}", n, s, "p") for i, (n, s) in enumerate(
            [("same", 5), ("wrong_size", 5), ("wrong_hash", 5), ("right_hash", None), ("unknown_size", None), ("absent", 5), ("hash_and_size", 5)])],
        "pos int, url string, name string, size bigint, parent_item_id string")
    disk = spark.createDataFrame([("same", 5, "a"), ("wrong_size", 6, "b"), ("wrong_hash", 5, "c"), ("right_hash", 7, "d"), ("unknown_size", 9, "e"),
                                  ("hash_and_size", 4, "f")], "name string, size_bytes bigint, sha256 string")
    prior = spark.createDataFrame([("wrong_hash", "x"), ("right_hash", "d"), ("hash_and_size", "f")], "name string, sha256 string")
    plan = acq.in_input_order(acq.download_plan(m, disk, prior)).collect()
    assert [r.name for r in plan] == [r.name for r in m.collect()]
    assert {r.name: r.action for r in plan} == {
        "same": "resumed", "wrong_size": "download", "wrong_hash": "download", "right_hash": "resumed", "unknown_size": "resumed",
        "absent": "download", "hash_and_size": "download"}
    assert {r.name for r in plan if r.size_note} == {"wrong_size", "hash_and_size"}
    assert {r.name for r in acq.size_mismatches(m, disk).collect()} == {"wrong_size", "hash_and_size"}


def test_manifest_coverage(spark):
    names = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
    c = acq.manifest_coverage(names("aabcd"), names("cdde"))
    assert tuple(acq.coverage_counts(c).first()) == (4, 3, 2, 1)
    assert [r.name for r in acq.missing_files(c).collect()] == ["a", "b"]
    assert [r.name for r in acq.missing_files(c, 1).collect()] == ["a"]
    assert [r.name for r in acq.unexpected_files(c).collect()] == ["e"]


@pytest.mark.parametrize("fallback, manual, verdict, arm", [
    ((0.30, 95.0), (0.45, 95.0), "DECIDED", "fallback"), ((0.50, 95.0), (0.31, 95.0), "DECIDED", "manual"),
    ((0.300, 90.0), (0.305, 95.0), "DECIDED", "manual"), ((0.300, 95.0), (0.305, 95.5), "DECIDED", "fallback"),
    ((0.50, 98.0), (0.30, 90.0), "NEEDS_REVIEW", "NEEDS_REVIEW"), ((None, 0.0), (0.35, 95.0), "DECIDED", "manual"),
    ((None, 0.0), (None, 0.0), "NEEDS_REVIEW", "NEEDS_REVIEW"), ((0.35, 95.0), (None, 0.0), "DECIDED", "fallback"),
    ((0.30, 98.0), (0.50, 90.0), "DECIDED", "fallback"), ((0.31, 98.0), (0.30, 90.0), "DECIDED", "fallback"),
])
def test_arm_decision(spark, fallback, manual, verdict, arm):
    arms = spark.createDataFrame([("e", "fallback", *fallback), ("e", "manual", *manual)], "experiment string, arm string, rms double, aligned_pct double")
    r = decisions.decide_arm(arms).first()
    assert (r.verdict, r.chosen_arm) == (verdict, arm) and r.rationale


def test_modes(spark):
    df = lambda rows, s: spark.createDataFrame(rows, s)
    chunks = df([("a",), ("b",), ("c",), ("d",)], "chunk string")
    over = df([("a", "manual"), ("b", "")], "chunk string, override string")
    dec = df([("a", "DECIDED", "fallback"), ("b", "DECIDED", "fallback"), ("c", "NEEDS_REVIEW", "NEEDS_REVIEW")], "chunk string, verdict string, chosen_arm string")
    got = {r.chunk: (r["mode"], r.status) for r in decisions.resolve_modes(chunks, over, dec).collect()}
    assert got == {"a": ("manual", "resolved"), "b": ("fallback", "resolved"), "c": (None, "refused"), "d": (None, "refused")}


def test_alarms(spark):
    rows = [("a", "step4", '{"disabled": 201}'), ("b", "step4", '{"disabled": 200}'), ("a", "align", '{"alignment_rate": 0.69}'),
            ("b", "align", '{"alignment_rate": 0.7}'), ("a", "markers", '{"markers_detected": 0}'), ("a", "reduce", '{"scalebars_present": 0}'),
            ("a", "dense", "{}"), ("b", "dense", '{"transform_scale": 1.0}'), ("a", "filter", "{}"), ("b", "filter", '{"has_cloud": true}'),
            ("a", "dsm", '{"cells": 0}'), ("b", "dsm", '{"cells": 100000001}'), ("c", "dsm", '{"cells": 100000000}'), ("a", "ortho", "{}")]
    found = decisions.alarms(typed_stages(spark.createDataFrame(rows, "chunk string, stage string, payload string")))
    got = {(r.chunk, r.alarm) for r in found.collect()}
    assert got == {("a", "too_many_disabled"), ("a", "low_alignment"), ("a", "no_markers"), ("a", "no_scalebars"), ("a", "not_scaled"),
                   ("a", "no_cloud"), ("a", "empty_grid"), ("b", "huge_grid"), ("a", "no_elevation")}
    assert [r.alarm for r in found.filter(~F.col("critical")).collect()] == ["no_markers"]
    with pytest.raises(RuntimeError, match="critical"):
        decisions.enforce(found)
    decisions.enforce(found, ignore=True)
    decisions.enforce(found.filter("alarm = 'no_markers'"))


def test_threshold_study_numbers(spark):
    """Published comparison: 522 cameras, bands of 5, 237 and 280."""
    q = F.when(F.col("id") < 5, "0.2").when(F.col("id") < 242, " 0.4 ").otherwise("0.50")
    cams = spark.range(522).select(
        F.lit("T3").alias("chunk"), F.col("id").cast("string").alias("label"), q.alias("quality_raw"), F.lit(True).alias("enabled"),
        ((F.col("id") >= 242) & (F.col("id") < 382)).alias("aligned_q050"), (F.col("id") >= 7).alias("aligned_q030"))
    arms = {r.arm: (r.disabled, r.enabled, r.aligned, round(r.align_rate_of_enabled, 4), round(r.align_rate_of_total, 4))
            for r in quality.compare_arms(cams).collect()}
    assert arms == {"q050": (242, 280, 140, 0.5, 0.2682), "q030": (5, 517, 515, 0.9961, 0.9866)}
    one = lambda a: cams.select("chunk", "label", F.lit(a).alias("arm"), F.col(f"aligned_{a}").alias("aligned"))
    bands = {(r.arm, r.band): (r.cameras, r.aligned) for r in quality.band_breakdown(cams, one("q050").union(one("q030"))).collect()}
    assert bands == {("q050", "<0.30"): (5, 0), ("q050", "0.30-0.50"): (237, 0), ("q050", ">=0.50"): (280, 140),
                     ("q030", "<0.30"): (5, 0), ("q030", "0.30-0.50"): (237, 235), ("q030", ">=0.50"): (280, 280)}


def test_quality_filter_keeps_unscored(spark):
    cams = spark.createDataFrame([("a", str(i), q, e) for i, (q, e) in enumerate([("0.4", True), ("0.5", True), (None, True), ("", True), ("bad", True), ("0.9", False)])],
                                 "chunk string, label string, quality_raw string, enabled boolean")
    kept = {r.label for r in quality.disable_low_quality(cams, 0.5).filter("enabled").collect()}
    assert kept == {"1", "2", "3", "4"}
    s = quality.quality_stats(cams, 0.5).first()
    assert (s.analyzed, s.with_quality, s.no_metadata, s.disabled, s.min_quality, s.max_quality, s.median_quality) == (6, 3, 3, 1, 0.4, 0.9, 0.5)
    rates = quality.alignment_rates(cams.withColumns({"enabled": F.lit(False), "aligned": F.lit(False)})).first()
    assert (rates.alignment_rate, rates.report_alignment_rate) == (0.0, None)


def test_points(spark):
    cloud = spark.range(1000).select(F.lit("c").alias("chunk"), (F.col("id") / 100.0).alias("x"), (F.col("id") % 7).cast("double").alias("y"),
                                     F.lit(1.0).alias("z"), (F.col("id") % 256).cast("smallint").alias("confidence"), F.lit("created").alias("cls"))
    conf = [i % 256 for i in range(1000)]
    assert points.drop_low_confidence(cloud, 2.9).count() == sum(c >= 2 for c in conf)
    sweep = {r.threshold: r for r in points.confidence_sweep(cloud).collect()}
    for lo, t in zip((0, *R.sweep_thresholds), R.sweep_thresholds):
        r = sweep[t]
        assert (r.in_bucket, r.removed, r.survivors) == (sum(lo <= c < t for c in conf), sum(c < t for c in conf), sum(c >= t for c in conf))
    assert sweep[256].removed_pct == 100.0
    assert points.crop_confidence(cloud, 0, 2).count() == sum(c > 2 for c in conf)
    assert points.remove_classes(cloud, ["created"], 10, 20).count() == sum(not 10 <= c <= 20 for c in conf)
    assert points.reclassify(cloud, "created", "low_point", 0, 1).filter("cls = 'low_point'").count() == sum(c <= 1 for c in conf)
    assert points.reclassify(cloud, "ground", "low_point").filter("cls = 'low_point'").count() == 0
    box = points.select_region(cloud, (5, 3, 1), (2, 2, 1))
    assert box.count() + points.select_region(cloud, (5, 3, 1), (2, 2, 1), invert=True).count() == 1000
    turned = points.select_region(cloud, (5, 3, 1), (2, 20, 1), ((0, 1, 0), (1, 0, 0), (0, 0, 1)))
    assert turned.count() == points.select_region(cloud, (5, 3, 1), (20, 2, 1)).count()
    g = points.grid_summary(points.elevation_grid(cloud, 1.0)).first()
    assert (g.width, g.height, g.cells, g.filled, g.holes) == (10, 7, 70, 70, 0)
    compared = {r.variant: r.removed for r in points.compare_removals(cloud, points.removal_variants(2)).collect()}
    assert compared["clean_below"] == sum(c < 2 for c in conf) and compared["crop_range"] == sum(c <= 2 for c in conf)
    with pytest.raises(RuntimeError):
        points.require_some_removed(points.compare_removals(cloud, {"none": F.lit(True)}))
    assert points.noise_report(cloud, 0).first().nothing_removed


def test_gradual_selection(spark):
    rows = [("c", 1, 31.0, 9.0, 9.0), ("c", 2, 30.0, 3.6, 9.0), ("c", 3, 30.0, 3.5, 0.31), ("c", 4, 30.0, 3.5, 0.3)]
    tagged = points.gradual_selection(spark.createDataFrame(rows, "chunk string, track_id int, ru double, pa double, re double"))
    assert {r.track_id: r.step for r in tagged.collect()} == {1: "reconstruction_uncertainty", 2: "projection_accuracy", 3: "reprojection_error", 4: None}


def test_residuals(spark):
    proj = spark.createDataFrame([("c", "a", 1, 0.3, 0.4), ("c", "a", 2, 9.0, 9.0), ("c", "b", 1, 9.0, 9.0), ("c", "a", 3, 0.0, 0.1), ("c", "a", 9, 1.0, 1.0)],
                                 "chunk string, camera string, track_id int, ex double, ey double")
    cams = spark.createDataFrame([("c", "a", True), ("c", "b", False)], "chunk string, label string, aligned boolean")
    pts = spark.createDataFrame([("c", 1, True), ("c", 2, False), ("c", 3, True)], "chunk string, track_id int, valid boolean")
    r = residuals.residual_rms(proj, cams, pts).first()
    assert r.rms == pytest.approx(((0.25 + 0.01) / 2) ** 0.5) and r.projections_used == 2 and r.envelope == "WITHIN"


def brute_neighbours(ms):
    out = {}
    for p, a in ms.items():
        best = None
        for q, b in ms.items():
            d = sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5
            if p != q and (best is None or d < best[0]):
                best = (d, q)
        if best:
            out[p] = best
    return out


def marker_sets():
    rng = random.Random(5)
    yield "uniform", {i: tuple(rng.random() for _ in range(3)) for i in range(150)}
    yield "scales", {i: tuple(rng.random() * 10.0 ** (-6 * (i % 3)) + (i % 3) for _ in range(3)) for i in range(150)}
    yield "copies", {i: (0.5, 0.5, 0.5) if i % 3 == 0 else tuple(rng.random() for _ in range(3)) for i in range(120)}
    yield "lattice", {i: (float(i % 5), float(i // 5 % 5), float(i // 25)) for i in range(125)}
    yield "line", {i: (float(i), 0.0, 0.0) for i in range(40)}
    yield "far", {0: (0.0, 0.0, 0.0), 1: (1e-9, 0.0, 0.0), 2: (1e7, 0.0, 0.0), 3: (1e7, 1.0, 0.0), 4: (-1e7, 5.0, 5.0)}
    yield "pair", {0: (1.0, 1.0, 1.0), 1: (1.0, 1.0, 1.0)}
    yield "single", {0: (1.0, 2.0, 3.0)}


def test_neighbours_match_brute_force(spark):
    sets = dict(marker_sets())
    rows = [(c, p, f"{c}{p}", *xyz) for c, ms in sets.items() for p, xyz in ms.items()] + [("uniform", 900, "lost", None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "chunk string, pos int, label string, x double, y double, z double")
    got = {(r.chunk, r.pos): (r.distance, r.nn_pos) for r in markers.nearest_neighbours(df).collect()}
    want = {(c, p): nn for c, ms in sets.items() for p, nn in brute_neighbours(ms).items()}
    assert set(got) == set(want)
    for k, (d, q) in want.items():
        assert got[k][0] == pytest.approx(d, rel=1e-12), k
        assert got[k][1] == q, k
    report = {(r.chunk, r.pos): r for r in markers.marker_report(df).collect()}
    for c, ms in sets.items():
        nn = brute_neighbours(ms)
        mutual = {(p, q): d for p, (d, q) in nn.items() if p < q and nn[q][1] == p}
        median = statistics.median(mutual.values()) if mutual else None
        paired = {x: d for pq, d in mutual.items() for x in pq}
        for p in ms:
            r = report[c, p]
            assert r.is_orphan == (p not in paired), (c, p)
            if p in paired:
                assert r.is_outlier == (not 0.6 * median <= paired[p] <= 1.4 * median)
    lost = report["uniform", 900]
    assert lost.is_orphan and not lost.is_reconstructed


def test_contact_sheet(spark):
    n = 36 * 2 + 7
    names = [f"img_{i:04d}.tif" for i in range(n)]
    random.Random(1).shuffle(names)
    rows = layout.contact_sheet_layout(spark.createDataFrame([(x,) for x in names], "name string").repartition(6)).collect()
    placed = {r.name: r for r in rows}
    for i, name in enumerate(sorted(names)):
        r = placed[name]
        sheet, at = divmod(i, 36)
        assert (r.i, r.sheet, r.row, r["col"]) == (i, sheet, at // 6, at % 6)
        assert (r.x, r.y, r.sheet_name) == (8 + at % 6 * 228, 8 + at // 6 * 191, f"contact_sheet_{sheet + 1:03d}.jpg")


def test_arm_results(spark):
    arms = spark.createDataFrame([("c", "a", 0.5), ("c", "b", 0.3)], "chunk string, arm string, threshold double")
    points = spark.createDataFrame([("c", "a", 0.0, 1.0, 2.0), ("c", "a", 1.5, 1.0, 2.123456), ("d", "a", 0.0, 0.0, 0.0)],
                                   "chunk string, arm string, x double, y double, z double")
    runs = spark.createDataFrame([("c", "a", 100), ("c", "a", 101)], "chunk string, arm string, seconds int")
    got = {r.arm: tuple(r)[3:] for r in quality.arm_results(arms, points, runs).collect()}
    assert got == {"a": (2, 1.5, 0.0, 0.1235, 3.4), "b": (0, None, None, None, None)}
    given = spark.createDataFrame([("c", "b", 7.0, 8.0, 9.00006)], "chunk string, arm string, size_x double, size_y double, size_z double")
    got = {r.arm: tuple(r)[3:] for r in quality.arm_results(arms, points, runs, given).collect()}
    assert got == {"a": (2, None, None, None, 3.4), "b": (0, 7.0, 8.0, 9.0001, None)}


def test_contact_sheets_are_numbered_per_site(spark):
    """Equal names in two sites, and sites that no partition boundary respects."""
    rows = [(site, f"img_{i:04d}.tif") for site, n in (("a", 40), ("b", 75), ("c", 1), (None, 2)) for i in range(n)]
    random.Random(2).shuffle(rows)
    placed = layout.contact_sheet_layout(spark.createDataFrame(rows, "site string, name string").repartition(5)).collect()
    assert len(placed) == len(rows)
    for r in placed:
        i = int(r.name[4:8])
        assert (r.i, r.sheet, r.sheet_name) == (i, i // 36, f"contact_sheet_{i // 36 + 1:03d}.jpg")


def test_input_hashes(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(f"T{i % 3}", f"n{i:03d}.tif", f"{i:064x}") for i in range(100)]
        got = {r.label: r for r in manifest.input_set_hashes(spark.createDataFrame(rows, "label string, name string, sha256 string")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for label, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        lines = "\n".join(f"{n}:{h}" for _, n, h in group)
        assert got[label].aggregate_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert got[label]["count"] == len(lines.split("\n"))


def test_stage_assembly(spark):
    stats = spark.createDataFrame([("a", "align", 1, "old"), ("a", "align", 2, "new"), ("a", "dsm", 1, "d"), ("b", "other", 1, "x")],
                                  "chunk string, stage string, ts int, payload string")
    facts = spark.createDataFrame([("a", 1), ("c", 2)], "chunk string, cameras_total int")
    files = spark.createDataFrame([("a", "dense", "p/d.ply", 2048), ("a", "dsm", "p/d.tif", None)], "chunk string, product string, path string, bytes bigint")
    rows = {r.chunk: r for r in manifest.run_chunks(facts, stats, files).collect()}
    assert (rows["a"].stage_align, rows["a"].stage_dsm, rows["a"].stage_ortho) == ("new", "d", None)
    assert rows["c"].stage_align is None and rows["a"].products["dsm"].bytes is None
    work = spark.createDataFrame([("a", "align"), ("a", "ortho")], "chunk string, stage string")
    assert [r.stage for r in manifest.pending_work(work, stats).collect()] == ["ortho"]
    found = spark.createDataFrame([("p/d.ply", 1025), ("p/d.tif", 1024)], "path string, length bigint")
    checked = manifest.product_integrity(files, found)
    assert {r["product"]: r.ok for r in checked.collect()} == {"dense": True, "dsm": False}
    assert tuple(manifest.integrity_verdict(checked).first()) == ("a", False, 1)
