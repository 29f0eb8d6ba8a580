"""Resource telemetry logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..joins import join_group_facts
from .tables import line_order

# Columns of the two log kinds.
GPU_SCHEMA = "timestamp string, gpu_util_pct string, mem_util_pct string, mem_used_MB string, mem_total_MB string"
CPU_SCHEMA = "timestamp string, cpu_util_pct string, mem_used_MB string, mem_total_MB string, swap_used_MB string"
LOG_SCHEMAS = {"gpu": GPU_SCHEMA, "cpu": CPU_SCHEMA}


def reading(c: Column) -> Column:
    """Log cell to number as a shell tool reads it: a leading number counts, other text is 0."""
    head = F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.coalesce(head.try_cast("double"), F.lit(0.0))


def numeric_samples(raw: DataFrame, kind: str) -> DataFrame:
    """Text samples to (host, pos, util_pct, mem_used_mb, mem_total_mb, swap_used_mb)."""
    swap = reading(F.col("swap_used_MB")) if kind == "cpu" else F.lit(0.0)
    keep = [c for c in ("host", "pos") if c in raw.columns]
    return raw.select(
        *keep,
        reading(F.col(f"{kind}_util_pct")).alias("util_pct"),
        reading(F.col("mem_used_MB")).alias("mem_used_mb"),
        reading(F.col("mem_total_MB")).alias("mem_total_mb"),
        swap.alias("swap_used_mb"),
    )


def newest_file(logs: DataFrame) -> DataFrame:
    """Rows of each host's newest log file (needs host, file, modified)."""
    newest = logs.groupBy("host").agg(F.max_by("file", F.struct("modified", "file")).alias("file"))
    return join_group_facts(logs, newest, ["host", "file"], "left_semi")


def read_telemetry(spark: SparkSession, path, kind: str, host: Column | None = None) -> DataFrame:
    """Samples of the newest log per host; ``host`` defaults to the log's folder name."""
    raw = spark.read.schema(LOG_SCHEMAS[kind]).csv(path, header=True)
    raw = raw.withColumns({
        "file": F.col("_metadata.file_path"),
        "modified": F.col("_metadata.file_modification_time"),
        "pos": line_order(),
    })
    folder = F.element_at(F.split("file", "/"), -2)
    return numeric_samples(newest_file(raw.withColumn("host", host if host is not None else folder)), kind)
