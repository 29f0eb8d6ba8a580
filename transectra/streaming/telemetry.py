"""Live telemetry summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.telemetry import summarize
from ..sources.telemetry import LOG_SCHEMAS, numeric_samples


def telemetry_stream(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Samples arriving as new log files; the host is the log's folder, order is the sample time."""
    raw = spark.readStream.schema(LOG_SCHEMAS[kind]).option("header", True).csv(path)
    raw = raw.withColumns({
        "host": F.element_at(F.split("_metadata.file_path", "/"), -2), "pos": F.trim("timestamp"),
    })
    return numeric_samples(raw, kind)


def without_repeats(samples: DataFrame, delay: str, fmt: str = "yyyy/MM/dd HH:mm:ss") -> DataFrame:
    """Samples of a stream, each (host, time) once.

    Logs that are copied again or overlap repeat samples. What was seen is kept as state until the
    event time has moved on by ``delay``, and then expires; a sample that comes later than
    that is left out, as it could not be told from a repeat. Samples whose time cannot be read are left out too.
    """
    timed = samples.withColumn("at", F.try_to_timestamp(F.col("pos"), F.lit(fmt))).filter(F.col("at").isNotNull())
    return timed.withWatermark("at", delay).dropDuplicatesWithinWatermark(["host", "at"])


def start_summary(samples: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep one running row per host; state grows with hosts, not with samples.

    Each batch writes the rows of hosts that changed in it to its own folder below ``out``, from the
    executors, so output follows change and a retried batch replaces its folder; :func:`read_summary` takes each host's last.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        summarize(samples).writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_summary(spark: SparkSession, out: str) -> DataFrame:
    """The last row that :func:`start_summary` wrote for each host."""
    rows = spark.read.parquet(out)
    facts = [c for c in rows.columns if c not in ("host", "batch")]
    last = rows.groupBy("host").agg(F.max_by(F.struct(*facts), F.col("batch")).alias("last"))
    return last.select("host", "last.*")
