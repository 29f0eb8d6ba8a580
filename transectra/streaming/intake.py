"""Incremental image intake: only new files are read, hashed and catalogued, each once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import has_extension
from ..profile import SurveyProfile
from ..sources.headers import reachable
from ..sources.images import tags_by_ranges
from ..sources.tiff import with_tags
from . import ledger


def catalogue_batch(files: DataFrame, profile: SurveyProfile = SurveyProfile(), ranged: bool = False) -> DataFrame:
    """Catalogue rows of scanned files; with ``ranged`` the scan's contents are not used and headers are read by ranges."""
    parts = F.split("path", "/")
    named = files.filter(has_extension(F.col("path"), profile.image_extensions)).withColumns({
        "name": F.element_at(parts, -1), "site": F.element_at(parts, -2), "relpath": F.array_join(F.slice(parts, -2, 2), "/"),
    })
    if ranged:
        return tags_by_ranges(named.select("path", "name", "site", "relpath", F.col("length").alias("size_bytes")), None).drop("_known")
    tagged = with_tags(named.withColumn("sha256", F.sha2("content", 256))).withColumnRenamed("length", "size_bytes")
    return tagged.withColumn("bytes_read", F.col("size_bytes")).drop("content", "modificationTime")


def start_intake(
    spark: SparkSession, folder: str, out: str, checkpoint: str, profile: SurveyProfile = SurveyProfile(),
    files_per_batch: int = 1000, before_ledger: Callable[[], None] = lambda: None,
) -> StreamingQuery:
    """Catalogue files that appeared since the last run, ``files_per_batch`` at a time.

    The stream's checkpoint remembers which files were done, and the ledger below ``out`` which batches were
    finished (see :mod:`.ledger`): a batch that died is not seen, one that comes again
    adds nothing, and a new checkpoint does not catalogue old files twice. Read with :func:`read_intake`.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = (
        spark.readStream.schema(schema).format("binaryFile").option("pathGlobFilter", "*.[tT][iI][fF]*")
        .option("maxFilesPerTrigger", files_per_batch).load(folder)
    )

    def append(batch: DataFrame, batch_id: int) -> None:
        new = ledger.unseen(batch, out, checkpoint, batch_id, "path")
        rows = catalogue_batch(new, profile, reachable(folder))
        ledger.commit(rows, out, checkpoint, batch_id, before_ledger)

    return (
        files.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_intake(spark: SparkSession, out: str) -> DataFrame | None:
    """Catalogue rows of all finished batches; None before the first."""
    return ledger.read_committed(spark, out)
