"""Coordinates: rationals, degrees-minutes-seconds, boxes, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """Rational to double; a zero denominator has no value."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def dms_to_degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Signed decimal degrees; null when any part is missing."""
    deg = d + m / F.lit(60.0) + s / F.lit(3600.0)
    return F.when(F.upper(ref).isin("S", "W"), -deg).otherwise(deg)


def in_box(lat: Column, lon: Column, profile) -> Column:
    return lat.between(profile.bbox_south, profile.bbox_north) & lon.between(profile.bbox_west, profile.bbox_east)


def distance(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column) -> Column:
    dx, dy, dz = ax - bx, ay - by, az - bz
    return F.sqrt(dx * dx + dy * dy + dz * dz)
