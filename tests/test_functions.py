import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from transectra.functions import classify, geo, text
from transectra.functions.quantiles import exact_percentiles
from transectra.sources.telemetry import reading


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r.o for r in df.orderBy("i").select(fn(F.col("v")).alias("o")).collect()]


def test_text_cleaning(spark):
    assert column(spark, [" a\t\n", " x ", "", None], text.strip) == ["a", "x", "", None]
    assert column(spark, ["NaN", " n/a ", "", "  ", " v ", None], text.csv_cell) == [None, "n/a", None, None, "v", None]
    assert column(spark, ["1.5", " 2 ", "x", "NaN", "", None], text.csv_number) == [1.5, 2.0, None, None, None, None]
    raw = [bytearray(b" a\xff \x00\x00"), bytearray(b"\x00\x00"), bytearray(b" \x00 b\x00 "), None]
    assert column(spark, raw, text.tag_text, "binary") == ["a�", None, "b", None]


def test_sites(spark, profile):
    alias = lambda c: text.normalize_site(c, profile.site_aliases)
    assert column(spark, ["EasternDryRocks", " eastern dry rocks ", "EASTERN_DRY_ROCKS", "Rock Key"], alias) == [
        "EasternDryRocks"] * 3 + ["Rock Key"]
    titles = ["EasternDryRocks", "Eastern Dry Rocks", "Site: Eastern_Dry_Rocks Imagery", "WesternSambo", "Rock Key", ""]
    match = lambda c: text.looks_like_site(c, F.lit("EasternDryRocks"))
    assert column(spark, titles, match) == [True, True, True, False, False, False]


def test_captions(spark):
    assert column(spark, ["a" * 31, "a" * 32], lambda c: text.caption(c, 220)) == ["a" * 31, "a" * 30 + "…"]
    assert column(spark, ["123456789"], lambda c: text.caption(c, 10)) == ["1234567…"]


@pytest.mark.parametrize("raw, wanted", [
    ("2022-07-15T14:32:00+00:00", "2022-07-15 14:32:00"), ("2022-07-15 23:30:00+05:00", "2022-07-15 23:30:00"),
    ("2022-07-15", "2022-07-15 00:00:00"), ("20220715T143200", "2022-07-15 14:32:00"), ("2022-07-15T08:15:30.25Z", "2022-07-15 08:15:30.25"),
    ("2022-07-15T08:15:30.1234567", "2022-07-15 08:15:30.123456"), ("2022-07-15T08:15", "2022-07-15 08:15:00"),
    ("2023", None), ("yesterday", None), ("2022-13-01", None), ("2022-07-15T25:00:00", None), ("2022-07-15T08:15:30+25:00", None), ("", None),
])
def test_wall_clock(spark, raw, wanted):
    assert column(spark, [raw], lambda c: classify.wall_clock(c).cast("string")) == [wanted]


def test_dms(spark):
    df = spark.createDataFrame([(24.0, 30.0, 36.0, "N"), (81.0, 30.0, 0.0, "w"), (1.0, None, 0.0, "S"), (1.0, 0.0, 0.0, None)],
                               "d double, m double, s double, r string")
    got = [r.o for r in df.select(geo.dms_to_degrees(*[F.col(c) for c in "dmsr"]).alias("o")).collect()]
    assert got == [pytest.approx(24.51), -81.5, None, 1.0]
    assert column(spark, [0, 4], lambda c: geo.ratio(F.lit(1), c), "int") == [None, 0.25]


def test_classes(spark):
    env = lambda c: classify.envelope(c, 0.27, 0.52)
    assert column(spark, [0.1, 0.27, 0.52, 0.6, None], env, "double") == ["BELOW", "WITHIN", "WITHIN", "ABOVE", None]
    band = lambda c: classify.quality_band(classify.quality_score(c), 0.3, 0.5)
    assert column(spark, ["0.29", "0.30", "0.5", "", "bad", None], band) == ["<0.30", "0.30-0.50", ">=0.50", None, None, None]
    assert column(spark, [" 12 ", "[N/A]", "", None, "7 MiB", "-3"], reading) == [12.0, 0.0, 0.0, 0.0, 7.0, -3.0]


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_percentiles_are_exact(spark, accuracy):
    """A low accuracy forces the bracketed path; results must not change."""
    rng = np.random.default_rng(3)
    groups = {
        "many": rng.normal(size=5000).round(6), "heavy": np.repeat(rng.integers(0, 5, 2000), 1).astype(float),
        "two": np.array([1.0, 4.0]), "one": np.array([3.0]), "skew": np.concatenate([np.zeros(3000), rng.random(1001)]),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("many", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    probs = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}
    got = {r.k: r for r in exact_percentiles(df, ["k"], F.col("v"), probs, accuracy).collect()}
    for k, vs in groups.items():
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(vs, p), abs=1e-12), (k, name)
        assert got[k].p50 == pytest.approx(statistics.median(vs))
