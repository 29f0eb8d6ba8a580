"""What Spark is asked to do: pushed filters, narrow scans, no needless exchange."""

import pytest
from pyspark.sql import functions as F

from transectra.operators import points
from transectra.operators.dataset_rules import duplicate_groups, first_n, transect_events
from transectra.operators.image_rules import image_findings
from transectra.operators.report import overall_severity, rollup


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def cloud(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cloud") / "c")
    spark.range(100).select(
        F.lit("c").alias("chunk"), *[F.col("id").cast("double").alias(a) for a in "xyz"],
        F.col("id").cast("smallint").alias("confidence"), F.lit("k").alias("cls"),
    ).write.parquet(path)
    return spark.read.parquet(path)


def test_point_filters_reach_the_scan(cloud):
    p = plan(points.drop_low_confidence(cloud, 2))
    assert "GreaterThanOrEqual(confidence,2)" in p and "Exchange" not in p


def test_sweep_reads_two_columns_and_shuffles_once(cloud):
    p = plan(points.confidence_sweep(cloud))
    assert "ReadSchema: struct<chunk:string,confidence:smallint>" in p
    assert p.count("Exchange hashpartitioning") == 1 and "partial_count" in p


def test_grid_does_not_shuffle_points_by_chunk(cloud):
    p = plan(points.elevation_grid(cloud, 1.0))
    assert "BroadcastHashJoin" in p and p.count("Exchange hashpartitioning") == 1


@pytest.fixture(scope="module")
def inventory(spark, tmp_path_factory):
    from tests.conftest import INVENTORY_SCHEMA

    path = str(tmp_path_factory.mktemp("inv") / "i")
    spark.createDataFrame([], INVENTORY_SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def test_image_rules_need_no_shuffle(inventory):
    p = plan(image_findings(inventory))
    assert "Exchange" not in p and p.count("Scan parquet") == 1


def test_counting_drops_details(inventory):
    p = plan(rollup(image_findings(inventory)))
    assert "to_json" not in p and "StructsToJson" not in p
    schema = p.split("ReadSchema: ")[1]
    assert "relpath" not in schema and "sha256" not in schema and "exif_image_description" not in schema


def test_first_n_is_cut_before_the_shuffle(inventory):
    p = plan(first_n(duplicate_groups(inventory), ["site"], [F.col("first_name")], 10))
    assert p.count("WindowGroupLimit") == 2


def test_dataset_scans_are_narrow(inventory):
    assert "ReadSchema: struct<site:string,name:string,csv_uuid:string>" in plan(transect_events(inventory))


def test_findings_are_not_sorted_for_the_worst_severity(spark):
    rows = [("a", "x", "image", 1, "warn", 1), ("a", "w", "image", 2, "unverified", 1), ("b", "x", "image", 0, "ok", 0), ("b", "d", "dataset", 0, "fail", 2),
            ("c", "n", "image", 0, "warn", 1), ("c", "dataset", "dataset", 3, "unverified", 1), ("d", "n", "image", 0, "ok", 0), (None, "n", "image", 0, "warn", 1)]
    found = overall_severity(spark.createDataFrame(rows, "site string, scope string, scope_kind string, pos int, severity string, rank int"))
    assert {r.site: r.overall_severity for r in found.collect()} == {"a": "unverified", "b": "fail", "c": "unverified", "d": "ok", None: "warn"}
    assert "SortAggregate" not in plan(found)
