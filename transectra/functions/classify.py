"""Severity, date, lineage and envelope classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

SEVERITIES = ("ok", "warn", "fail", "unverified")
# Rank of each severity; warn and unverified share a rank.
SEVERITY_RANK = {"ok": 0, "warn": 1, "unverified": 1, "fail": 2}

_DATE = r"(\d{4}-\d{2}-\d{2}|\d{8})"
_CLOCK = r"(?:.(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?"
_OFFSET = r"(?:Z|[+-](?:[01]\d|2[0-3])(?::?[0-5]\d(?::?[0-5]\d(?:\.\d+)?)?)?)?)?"
ISO_PATTERN = f"^{_DATE}{_CLOCK}{_OFFSET}$"


def severity_rank(severity: Column) -> Column:
    return (
        F.when(severity == "fail", 2)
        .when(severity.isin("warn", "unverified"), 1)
        .otherwise(0)
    )


def wall_clock(c: Column) -> Column:
    """ISO 8601 text to TIMESTAMP_NTZ, dropping any offset without converting.

    Null for text that is not ISO 8601 (a bare year, a free-form date).
    """
    part = lambda i: F.regexp_extract(c, ISO_PATTERN, i)
    two = lambda i: F.when(part(i) == "", "00").otherwise(part(i))
    day = F.regexp_replace(part(1), "-", "")
    text = F.concat(
        F.substring(day, 1, 4), F.lit("-"), F.substring(day, 5, 2), F.lit("-"), F.substring(day, 7, 2), F.lit(" "),
        two(2), F.lit(":"), two(3), F.lit(":"), two(4), F.lit("."), F.rpad(part(5), 6, "0"),
    )
    return F.when(c.rlike(ISO_PATTERN), text.try_cast("timestamp_ntz"))


def in_window(ts: Column, lo: str, hi: str) -> Column:
    return ts.between(F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz"))


def is_one_of_sizes(width: Column, height: Column, sizes: tuple[tuple[int, int], ...]) -> Column:
    hit = F.lit(False)
    for w, h in sizes:
        hit = hit | ((width == w) & (height == h))
    return hit


def software_severity(software: Column, ok_prefix: str, warn_prefixes: tuple[str, ...]) -> Column:
    warn = F.lit(False)
    for prefix in warn_prefixes:
        warn = warn | software.startswith(prefix)
    return (
        F.when(software.isNull(), "fail")
        .when(software.startswith(ok_prefix), "ok")
        .when(warn, "warn")
        .otherwise("fail")
    )


def envelope(value: Column, lo: float, hi: float) -> Column:
    return F.when(value.between(lo, hi), "WITHIN").when(value < lo, "BELOW").when(value > hi, "ABOVE")


def quality_score(raw: Column) -> Column:
    """Score text to double; missing, blank or unparseable is null."""
    return strip(raw).try_cast("double")


def quality_band(q: Column, lo: float, hi: float) -> Column:
    """Half-open bands of the threshold study."""
    return (
        F.when(q < lo, f"<{lo:.2f}")
        .when(q < hi, f"{lo:.2f}-{hi:.2f}")
        .when(q >= hi, f">={hi:.2f}")
    )
