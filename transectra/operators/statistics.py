"""Exploratory summaries of the inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_percentiles
from ..functions.text import transect_token
from ..profile import SurveyProfile


def camera_counts(inventory: DataFrame) -> DataFrame:
    known = inventory.filter(F.col("exif_make").isNotNull() & F.col("exif_model").isNotNull())
    return known.groupBy("exif_make", "exif_model").agg(F.count(F.lit(1)).alias("images"))


def describe(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """count, mean, std, min, quartiles, max per named column; quartiles are exact and interpolated."""
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), c.cast("double").alias("value")) for n, c in columns.items()])
    rows = df.select(F.explode(pairs).alias("p")).select("p.field", "p.value").filter(F.col("value").isNotNull())
    base = rows.groupBy("field").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quartiles = exact_percentiles(rows, ["field"], F.col("value"), {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return base.join(quartiles, "field")


def code_by_severity(findings: DataFrame) -> DataFrame:
    """Crosstab in long form: only combinations that occur."""
    return findings.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


def images_per_transect(images: DataFrame, profile: SurveyProfile = SurveyProfile()) -> DataFrame:
    """Image count per transect token; the null label counts names without one."""
    label = transect_token(F.col("name"), profile.transect_token_pattern)
    return images.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("images"))
