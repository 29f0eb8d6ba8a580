"""A ledger of finished batches: what it does not name was never written.

A batch first writes its rows to a folder of its own, ``data/commit=<name>``; then one
row goes to ``ledger``, in a single file that appears whole. Readers take the folders
that the ledger names. A batch that dies in between leaves a folder that nobody reads
and :func:`remove_unfinished` deletes. A batch that comes again, and a stream that begins
anew with another checkpoint, find their files in the ledger's folders and leave
them out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER_SCHEMA = "commit string, stream string, batch bigint, rows bigint, at timestamp"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_ledger(spark: SparkSession, out: str) -> DataFrame:
    """(commit, stream, batch, rows, at) of every finished batch."""
    if not _exists(spark, f"{out}/ledger"):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(f"{out}/ledger")


def read_committed(spark: SparkSession, out: str, commits: DataFrame | None = None) -> DataFrame | None:
    """Rows of finished batches, or of those in ``commits``; None before the first. Other folders are not opened."""
    names = sorted(r["commit"] for r in (read_ledger(spark, out) if commits is None else commits).select("commit").collect())
    if not names:
        return None
    # One name per batch, not per row; a listing of folders that are being written could miss or meet half of one.
    return spark.read.option("basePath", f"{out}/data").parquet(*[f"{out}/data/commit={n}" for n in names]).drop("commit")


def unseen(rows: DataFrame, out: str, stream: str, batch: int, key: str) -> DataFrame:
    """``rows`` whose key no finished batch of another stream, nor an earlier run of this batch, holds.

    Other batches of the same stream are left to its checkpoint, so that a running stream does not read its whole past at every batch.
    """
    spark = rows.sparkSession
    other = read_ledger(spark, out).filter((F.col("stream") != stream) | (F.col("batch") == batch))
    held = read_committed(spark, out, other)
    return rows if held is None else rows.join(held.select(key).distinct(), key, "left_anti")


def commit(rows: DataFrame, out: str, stream: str, batch: int, before_ledger: Callable[[], None] = lambda: None) -> None:
    """Write a batch and then its ledger row. ``before_ledger`` runs in between (tests fail there)."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    rows.write.parquet(f"{out}/data/commit={name}")
    n = spark.read.schema(rows.schema).parquet(f"{out}/data/commit={name}").count()
    before_ledger()
    line = spark.createDataFrame([(name, stream, batch, n)], "commit string, stream string, batch bigint, rows bigint")
    line.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{out}/ledger")


def remove_unfinished(spark: SparkSession, out: str) -> int:
    """Delete folders of batches that never reached the ledger; run it while no stream writes. Returns how many."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    root = Path(f"{out}/data")
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(root):
        return 0
    done = {r["commit"] for r in read_ledger(spark, out).select("commit").collect()}
    gone = [f.getPath() for f in store.listStatus(root) if f.getPath().getName().removeprefix("commit=") not in done]
    for path in gone:
        store.delete(path, True)
    return len(gone)
