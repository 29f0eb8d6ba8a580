"""Percentiles of a large group are exact, and no window holds all of its values."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from transectra.functions import quantiles


@pytest.mark.parametrize("shape", ["even", "ties", "bunched"])
def test_large_group(spark, shape):
    n = 400_000
    value = {
        "even": F.col("id").cast("double"), "ties": (F.col("id") % 7).cast("double"),
        "bunched": F.when(F.col("id") % 100 == 0, F.col("id") * 1e6).otherwise(F.col("id") * 1e-6),
    }[shape]
    df = spark.range(n).select(F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("k"), value.alias("v"))
    got = quantiles.exact_percentiles(df, ["k"], F.col("v"), {"q1": 0.25, "m": 0.5, "q9": 0.9}).collect()
    want = df.groupBy("k").agg(F.percentile("v", 0.25).alias("q1"), F.percentile("v", 0.5).alias("m"), F.percentile("v", 0.9).alias("q9")).collect()
    assert sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in got) == sorted(
        tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in want)


def test_rounds_are_hash_aggregations(spark):
    """No window and no sketch; values are listed only in cells of few rows."""
    df = spark.range(200_000).select(F.lit("one").alias("k"), F.col("id").alias("v"))
    plan = quantiles.exact_percentiles(df, ["k"], F.col("v"), {"m": 0.5})._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "percentile" not in plan


ODD = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308,
       float("inf"), float("-inf"), 1 / 3, 2 / 3, 0.1, 1e-300, 3.0, 1.9999999999999998, 2.0, 2.0000000000000004, 4503599627370497.0, 9007199254740993.0]


def test_keys_are_in_the_order_of_doubles(spark):
    rng = random.Random(8)
    values = sorted({*ODD, *[rng.choice((-1, 1)) * rng.random() * 10.0 ** rng.randrange(-320, 308) for _ in range(3000)],
                     *[math.nextafter(2.0 ** rng.randrange(-1073, 1023), rng.choice((-math.inf, math.inf))) for _ in range(500)]})
    df = spark.createDataFrame([(v,) for v in values] + [(float("nan"),), (None,)], "v double")
    got = quantiles.with_ordered_key(df, F.col("v"), "k").withColumn("b", quantiles.value_of_key(F.col("k"))).collect()
    got = sorted(got, key=lambda r: (r.v is None, r.v != r.v, r.v))
    keys = [r.k for r in got if r.v is not None and r.v == r.v]
    assert keys == sorted(set(keys)) and len(keys) == len(values)
    assert [r for r in got if r.v == r.v and r.b != r.v] == []
    assert next(r.k for r in got if r.v != r.v and r.v is not None) > keys[-1]
    assert next(r for r in got if r.v is None).k is None


@pytest.mark.parametrize("few", [1, 50, 20_000])
def test_rounds_end_at_any_bound(spark, few):
    """A small bound forces all four rounds; null keys are keys."""
    rng = random.Random(few)
    groups = {"a": [rng.gauss(0, 1e-9) for _ in range(700)], None: [float(rng.randrange(3)) for _ in range(300)], "one": [2.5], "same": [7.0] * 90}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {r.k: (r.q1, r.m, r.top) for r in quantiles.exact_percentiles(df, ["k"], F.col("v"), {"q1": 0.25, "m": 0.5, "top": 1.0}, few).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert got[k] == pytest.approx((np.quantile(v, 0.25), np.quantile(v, 0.5), max(v)), rel=1e-12, abs=1e-20), k


def test_values_beyond_integers_of_doubles(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), (F.col("id") + 10 ** 12).alias("v"))
    assert quantiles.exact_percentiles(df, ["k"], F.col("v"), {"m": 0.5}).first().m == 10 ** 12 + 499.5
