import pytest

from transectra import joins
from transectra.functions.quantiles import exact_percentiles
from transectra.operators import markers, points
from transectra.operators.image_rules import image_findings, image_verdicts
from transectra.operators.report import worst_per_file


@pytest.fixture(params=["-1", "10m"], ids=["shuffled", "broadcast"])
def limit(request, spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, request.param)
    yield request.param
    spark.conf.set(key, before)


def test_hot_group_either_way(spark, limit):
    """One key holds most rows; the result does not depend on the way facts are joined."""
    rows = [("hot" if i % 10 else f"k{i}", float(i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: r.m for r in exact_percentiles(df, ["k"], df["v"], {"m": 0.5}).collect()}
    hot = sorted(v for k, v in rows if k == "hot")
    assert got["hot"] == (hot[449] + hot[450]) / 2 and got["k10"] == 10.0 and len(got) == 101


def test_grid_and_markers_either_way(spark, limit):
    cloud = spark.createDataFrame([("a", float(i % 4), float(i % 3), 1.0 * i) for i in range(24)] + [("b", 100.0, 5.0, 2.0)], "chunk string, x double, y double, z double")
    grid = points.grid_summary(points.elevation_grid(cloud, 1.0))
    assert {r.chunk: (r.width, r.height, r.filled) for r in grid.collect()} == {"a": (4, 3, 12), "b": (1, 1, 1)}
    ms = spark.createDataFrame([("a", i, str(i), 1.0 if i < 3 else float(i), 0.0, 0.0) for i in range(6)], "chunk string, pos int, label string, x double, y double, z double")
    assert {r.pos: r.nn_pos for r in markers.nearest_neighbours(ms).collect()} == {0: 1, 1: 0, 2: 0, 3: 4, 4: 3, 5: 4}


def test_merge_by_key(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, a int")
    b = spark.createDataFrame([("y", [3]), ("z", [4])], "k string, b array<int>")
    rows = {r.k: (r.a, r.b) for r in joins.merge_by_key([a, b], "k").collect()}
    assert rows == {"x": (1, None), "y": (2, [3]), "z": (None, [4])}


def test_verdicts_equal_the_findings_table(good, table, profile):
    inv = table([
        good(1), good(2, read_errors=["x"]), good(3, xmp_attribution_url=None, iptc_credit=None), good(4, software="Microsoft Windows Photo Viewer", csv_dtoriginal_utc=None),
        good(5, csv_dtoriginal_utc=None, software="Adobe Photoshop"), good(6, csv_matched=False, iptc_credit=None),
    ])
    from_rows = {r.scope: r.severity for r in image_verdicts(inv, profile).collect()}
    from_table = {r.scope: r.severity for r in worst_per_file(image_findings(inv, profile)).collect()}
    assert from_rows == from_table
    assert list(dict(sorted(from_rows.items())).values()) == ["ok", "fail", "unverified", "warn", "unverified", "fail"]
