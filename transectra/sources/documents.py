"""One huge CSV or JSON document read by many tasks.

A row of a CSV export may run over several lines, and a JSON array may be one line or
many; where a record begins depends on all quotes and braces before it. So the text is
cut at every delimiter (line break, or closing brace) into chunks, by byte ranges, and
each chunk's effect is computed for both states it may be entered in, inside a quoted
text or outside. Effects of a byte range are added up to one row per range;
these rows are composed in order, which gives every range its true entry state; then
each range cuts its own records. Only records of several chunks are put together by a
shuffle of theirs. One record must fit in memory, a document need not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored

_PLACE = ("file", "block")


def _chunks(spark: SparkSession, path, delimiter: str) -> DataFrame:
    """(file, block, row, text): pieces between delimiters; rows of a block (a byte range) rise."""
    raw = spark.read.option("lineSep", delimiter).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.col("value").alias("text"))


def _before(value: str, *more: str) -> Column:
    """Sum over the earlier chunks of the block."""
    w = Window.partitionBy(*_PLACE).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def _earlier_blocks(value) -> Column:
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def _joined(chunks: DataFrame, joint: str, closed: bool) -> DataFrame:
    """(file, record, text) of chunks with ``record`` (how many ended before), ``first`` and ``last``: whether a record begins and ends there.

    With ``closed``, chunks after the last end are no record.
    """
    alone = F.col("first") & F.col("last")
    whole = chunks.filter(alone).select("file", "record", "text")
    parts = chunks.filter(~alone).groupBy("file", "record").agg(
        F.sort_array(F.collect_list(F.struct("block", "row", "text"))).alias("p"), F.max("last").alias("ends"))
    if closed:
        parts = parts.filter("ends")
    return whole.unionByName(parts.select("file", "record", F.array_join(F.transform("p", lambda x: x["text"]), joint).alias("text")))


def csv_records(spark: SparkSession, path) -> DataFrame:
    """(file, record, text): rows of CSV files, numbered from 0, with the line breaks that stand in quotes.

    A doubled quote counts as two, so the state of a line is the parity of the quotes
    before it. An open quote at the end of a file closes there. Lines without anything on them are no rows.
    """
    lines = _chunks(spark, path, "\n")
    quotes = lines.withColumn("q", F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit(""))))
    facts = stored(quotes.select(*_PLACE, "row", F.col("q").cast("long").alias("q")))
    within = facts.withColumn("rel", _before("q") + F.col("q"))
    # Per block: quotes, and line ends outside quotes if it is entered outside (even) or inside (odd).
    ranges = within.groupBy(*_PLACE).agg(
        F.sum("q").alias("q"), F.count_if(F.col("rel") % 2 == 0).alias("even"), F.count_if(F.col("rel") % 2 == 1).alias("odd"))
    ranges = ranges.withColumn("entry", _earlier_blocks("q") % 2)
    ends = F.when(F.col("entry") == 0, F.col("even")).otherwise(F.col("odd"))
    ranges = stored(ranges.select(*_PLACE, "entry", _earlier_blocks(ends).alias("ended")))
    placed = quotes.join(ranges, list(_PLACE)).withColumn("before", F.col("entry") + _before("q"))
    placed = placed.withColumns({"first": F.col("before") % 2 == 0, "last": (F.col("before") + F.col("q")) % 2 == 0})
    placed = placed.withColumn("n", F.col("last").cast("long")).withColumn("record", F.col("ended") + _before("n"))
    out = _joined(placed, "\n", closed=False)
    text = F.regexp_replace(F.regexp_replace("text", "\r$", ""), "^﻿", "")
    return out.withColumn("text", text).filter(F.trim("text") != "")


def read_csv_split(spark: SparkSession, path) -> DataFrame:
    """Rows of CSV files with a header line, every cell text, read like the multi-line reader but by many tasks.

    Besides the columns there is ``_pos``, a struct in row order. All files have the first one's header.
    """
    rows = stored(csv_records(spark, path))
    head = rows.orderBy("file", "record").select("text").first()
    if head is None:
        return spark.createDataFrame([], "_pos struct<file: string, record: bigint>")
    options = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "nullValue": "\u0000",
               "emptyValue": "", "maxCharsPerColumn": "-1"}
    width = spark.range(1).select(F.lit(head["text"]).alias("t"))
    names = width.select(F.from_csv("t", ", ".join(f"c{i} string" for i in range(_cells(head["text"]))), options).alias("h")).first()["h"]
    schema = ", ".join(f"`{(n or f'_c{i}').replace('`', '``')}` string" for i, n in enumerate(names))
    first = rows.groupBy("file").agg(F.min("record").alias("_head"))
    body = rows.join(first, "file").filter("record > _head")
    parsed = body.select(F.struct("file", "record").alias("_pos"), F.from_csv("text", schema, options).alias("_row"))
    return parsed.select("_row.*", "_pos")


def _cells(header: str) -> int:
    quoted, n = False, 1
    for c in header:
        if c == '"':
            quoted = not quoted
        n += c == "," and not quoted
    return n


def json_objects(spark: SparkSession, path, depth: int = 0) -> DataFrame:
    """(file, record, text): the objects that open at brace ``depth``, numbered from 0, each as JSON text.

    Depth 0 gives the elements of a top-level array, or one object per line, or one per file; depth 1
    the elements of the arrays inside a top-level object. Brackets need not be counted:
    an object ends where as many braces are closed as were opened, outside quoted
    texts. A last object cut off by the end of the file is closed there.
    """
    chunks = _chunks(spark, path, "}")
    plain = F.regexp_replace("text", "(?s)\\\\.", "")
    pieces = F.split(plain, '"', -1)
    braces = lambda odd: (lambda t: F.length(t) - F.length(F.replace(t, F.lit("{"), F.lit(""))))(
        F.array_join(F.filter(pieces, lambda x, i: i % 2 == odd), ""))
    # What a chunk does if entered outside (0) or inside (1) a quoted text; its closing brace counts if it is left outside.
    chunks = chunks.withColumns({"q": (F.size(pieces) - 1).cast("long"), "open0": braces(0).cast("long"), "open1": braces(1).cast("long")})
    facts = stored(chunks.drop("text"))

    def effects(rows: DataFrame, entry: Column, names: tuple[str, str]) -> DataFrame:
        """Braces opened (first name) and closed by each chunk under an entry state of its block."""
        at = (entry + _before("q")) % 2
        opened = F.when(at == 0, F.col("open0")).otherwise(F.col("open1"))
        closed = F.when((at + F.col("q")) % 2 == 0, 1).otherwise(0)
        return rows.withColumns({names[0]: opened, names[1]: closed.cast("long"), "quoted": at == 1})

    both = effects(effects(facts, F.lit(0), ("o0", "c0")), F.lit(1), ("o1", "c1"))
    ranges = both.groupBy(*_PLACE).agg(F.sum("q").alias("q"), *[F.sum(F.col(f"o{s}") - F.col(f"c{s}")).alias(f"d{s}") for s in (0, 1)])
    ranges = ranges.withColumn("entry", _earlier_blocks("q") % 2)
    gained = F.when(F.col("entry") == 0, F.col("d0")).otherwise(F.col("d1"))
    ranges = stored(ranges.select(*_PLACE, "entry", _earlier_blocks(gained).alias("level")))

    def placed(rows: DataFrame) -> DataFrame:
        out = effects(rows.join(ranges, list(_PLACE)), F.col("entry"), ("o", "c")).withColumn("gain", F.col("o") - F.col("c"))
        out = out.withColumn("at", F.col("level") + _before("gain"))
        return out.withColumn("last", (F.col("c") == 1) & (F.col("at") + F.col("gain") == depth)).withColumn("n", F.col("last").cast("long"))

    ended = placed(facts).groupBy(*_PLACE).agg(F.sum("n").alias("n"))
    ended = stored(ended.select(*_PLACE, _earlier_blocks("n").alias("ended")))
    rows = placed(chunks).join(ended, list(_PLACE)).withColumn("record", F.col("ended") + _before("n"))
    rows = rows.withColumn("first", F.col("at") <= depth)
    # Up to the brace that opens the object: other texts, and braces of the levels around it.
    skip = '(?s)^(?:[^{"]++|"(?:[^"\\\\]++|\\\\.)*+")*+'
    outside = F.when(F.col("quoted"), F.regexp_replace("text", '(?s)^(?:[^"\\\\]++|\\\\.)*+"', "")).otherwise(F.col("text"))
    start = F.col("text")
    for level in range(depth + 1):
        cut = F.regexp_replace(outside, skip + ("\\{" + skip[5:]) * (depth - level), "")
        start = F.when(F.col("first") & (F.col("at") == level), cut).otherwise(start)
    between = F.col("first") & (F.col("at") + F.col("o") <= depth)
    out = _joined(rows.withColumn("text", start).filter(~between), "}", closed=True)
    return out.withColumn("text", F.concat("text", F.lit("}")))
