"""Artefacts of several parts that readers see whole: versions and one pointer.

A writer puts all parts into a new version folder, and then replaces the small pointer
file, in one rename. A reader asks the pointer once and reads that version,
whatever is being written meanwhile; a writer that dies leaves the old version in
place. The versions before the current one stay for readers that are still at them, up to a number.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

POINTER = "_current"
#: Versions that stay, the current one included.
KEEP = 2


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _number(name: str) -> int:
    return int(name.split("-")[1])


def current_name(spark: SparkSession, path: str) -> str | None:
    place, files = _files(spark, f"{path}/{POINTER}")
    if not files.exists(place):
        return None
    stream = files.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def current(spark: SparkSession, path: str) -> str:
    """Folder of the current version; ``path`` itself where nothing was published, as artefacts of other writers have no versions."""
    name = current_name(spark, path)
    return f"{path}/{name}" if name else path


def _point(spark: SparkSession, path: str, name: str) -> None:
    jvm = spark._jvm
    place, files = _files(spark, f"{path}/{POINTER}.{uuid.uuid4().hex}")
    out = files.create(place)
    out.write(bytearray(name.encode()))
    out.close()
    conf = spark._jsc.hadoopConfiguration()
    target = files.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}"))
    source = files.makeQualified(place)
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(source, target, how)


def publish(spark: SparkSession, path: str, write: Callable[[str], None], keep: int = KEEP) -> str:
    """Let ``write`` fill a new version folder below ``path``, make it the current one, remove versions beyond ``keep``; returns the folder.

    Two writers at once both finish; the last to point wins. Folders newer than the
    current version are left alone, as somebody may be writing them.
    """
    before = current_name(spark, path)
    name = f"v-{(_number(before) if before else 0) + 1:010d}-{uuid.uuid4().hex[:12]}"
    write(f"{path}/{name}")
    _point(spark, path, name)
    place, files = _files(spark, path)
    old = sorted(n for n in (f.getPath().getName() for f in files.listStatus(place) if f.isDirectory()) if n.startswith("v-") and _number(n) < _number(name))
    # Keep the version that was current before ours, and the latest of the others.
    old.sort(key=lambda n: (n == before, n))
    for n in old[:max(0, len(old) - (keep - 1))]:
        files.delete(_files(spark, f"{path}/{n}")[0], True)
    return f"{path}/{name}"
