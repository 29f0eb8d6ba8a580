"""URL lists over time: validity intervals and an as-of join.

A list is a log of dated entries: from a time on, a pattern is added or removed. The
log of each pattern is turned into validity intervals ``[valid_from, valid_to)``, and a
capture is judged by the entries that were active when it was fetched, not by today's
list. Patterns are of three kinds: ``host`` (that host), ``domain`` (it and all hosts
below it) and ``prefix`` (a host and whole leading path segments).

The as-of join is an equi-join on pattern and period: an interval is laid out over the
fixed periods it overlaps, so captures of one very common host are spread over periods,
and intervals of one pattern never overlap, so a capture meets at most one of them.
Everything is built of DataFrame expressions.

Defined results: a null or unparsable URL and a null fetch time match nothing.
Of entries for one pattern at one time the removal counts. Entries with a null field
are ignored; entries that repeat change nothing. Rows that repeat a capture are judged
alike and stay rows of their own; empty tables give an empty result or no match; other
columns of the captures are passed on by :func:`judge`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import settle

#: Days of one period.
PERIOD = 16


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.rtrim(host, F.lit(".")), F.lit(""))


def path_of(url: Column) -> Column:
    """Path without query and fragment, as it is written."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def patterns_of(url: Column) -> Column:
    """All (kind, pattern) that would match a URL, as an array of structs."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    segments = F.filter(F.split(path_of(url), "/"), lambda s: s != "")

    def of(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("pattern"))

    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: of("domain", F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefixes = F.transform(
        F.sequence(F.lit(0), F.size(segments)),
        lambda i: of("prefix", F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/"))))
    return F.when(host.isNotNull(), F.concat(F.array(of("host", host)), domains, prefixes))


def validity(entries: DataFrame) -> DataFrame:
    """Intervals (list, kind, pattern, valid_from, valid_to) of a log (list, kind, pattern, action, at); an open end is null."""
    key = ["list", "kind", "pattern"]
    log = entries.select(*key, "action", "at").dropna().filter(F.col("action").isin("add", "remove"))
    # One entry per pattern and time, combined before the shuffle: 'remove' is the later word.
    log = log.groupBy(*key, "at").agg(F.max("action").alias("action"))
    order = Window.partitionBy(*key).orderBy("at")
    changed = log.withColumn("before", F.lag("action").over(order)).filter("before IS NULL OR before <> action")
    ends = changed.withColumn("valid_to", F.lead("at").over(order))
    return ends.filter("action = 'add'").select(*key, F.col("at").alias("valid_from"), "valid_to")


def _period(at: Column) -> Column:
    return F.floor(F.datediff(at, F.lit("1970-01-01").cast("date")) / PERIOD)


def matches(captures: DataFrame, intervals: DataFrame, url_col: str = "url", at_col: str = "fetched") -> DataFrame:
    """(url, at, list, kind, pattern) of every distinct capture and active entry."""
    wanted = captures.select(F.col(url_col).alias("url"), F.col(at_col).alias("at")).dropna().distinct()
    keyed = wanted.select("url", "at", F.explode(patterns_of(F.col("url"))).alias("k")).select("url", "at", "k.*", _period(F.col("at")).alias("period"))
    # One row: an open interval is laid out up to the last capture only.
    last = captures.agg(F.max(at_col)).first()[0]
    end = F.least(F.coalesce("valid_to", F.lit(last)), F.lit(last))
    laid = (
        intervals.filter(F.col("valid_from") <= F.lit(last))
        .withColumn("period", F.explode(F.sequence(_period(F.col("valid_from")), _period(end))))
    )
    active = (F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    return keyed.join(laid, ["kind", "pattern", "period"]).filter(active).select("url", "at", "list", "kind", "pattern")


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", at_col: str = "fetched") -> DataFrame:
    """Captures with ``blocked``, ``n_matches`` and ``matched`` (the first of ``list:kind:pattern``, null if none).

    Other columns are passed on, whatever their names; columns named like the three results are replaced.
    """
    said = F.concat_ws(":", "list", "kind", "pattern")
    found = settle(
        matches(captures, validity(entries), url_col, at_col).groupBy("url", "at")
        .agg(F.count(F.lit(1)).alias("n_matches"), F.min(said).alias("matched"))
    )
    # The caller's columns travel as one, so that no name of theirs meets one of ours.
    rows = captures.select(F.struct("*").alias("row"), F.col(url_col).alias("url"), F.col(at_col).alias("at"))
    out = rows.join(found, ["url", "at"], "left")
    others = [F.col("row").getField(c).alias(c) for c in captures.columns if c.lower() not in ("blocked", "n_matches", "matched")]
    return out.select(
        *others, F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), "matched", F.col("n_matches").isNotNull().alias("blocked"))
