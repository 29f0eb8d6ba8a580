"""Exact percentiles by radix selection, without any task holding a group's values.

``percentile``/``median`` keep every distinct value of a group in one buffer, which a
group with a third of a large table would overflow. Here a value becomes a 64-bit
integer in the same order. Rows are counted by group and leading 16 bits, a hash
aggregation combined before its shuffle; the counts say in which of these cells each
wanted rank lies. Only rows of such cells are looked at again, by the next 16 bits, for all
groups and ranks together. After four rounds at the latest a cell is one value; it is
settled as soon as it holds few rows or one distinct value, which for most data is
after the first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Bits that one round looks at: at most ``2 ** DIGIT`` cells per group and round.
DIGIT = 16
#: Rows that a cell may hold for its values to be listed.
FEW = 20_000

_LEAST_NORMAL, _LEAST = 2.0 ** -1022, 2.0 ** -1074
_FRACTION = 1 << 52
_NAN = 0x7FF8 << 48


def with_ordered_key(rows: DataFrame, value: Column, name: str = "_k") -> DataFrame:
    """Add a double as a long in the same order (both zeros are 0, NaN is last): exponent and fraction, negated for negatives.

    Powers of two and divisions by them are exact, so different doubles get different
    keys. In steps, so that nothing is computed twice.
    """
    v, a, e = F.col("_kv"), F.col("_ka"), F.col("_ke")
    rows = rows.withColumn("_kv", value).withColumn("_ka", F.abs(v))
    rows = rows.withColumn("_ke", F.when((a >= _LEAST_NORMAL) & (a < float("inf")), F.floor(F.log2(a))))
    rows = rows.withColumn("_ke", e + F.when(F.pow(F.lit(2.0), e + 1) <= a, 1).when(F.pow(F.lit(2.0), e) > a, -1).otherwise(0))
    fraction = ((a / F.pow(F.lit(2.0), e) - 1.0) * float(_FRACTION)).cast("long")
    size = (
        F.when(F.isnan(v), F.lit(_NAN)).when(a == float("inf"), F.lit(0x7FF << 52))
        .when(a < _LEAST_NORMAL, (a / _LEAST).cast("long")).otherwise((e + 1023).cast("long") * _FRACTION + fraction)
    )
    rows = rows.withColumn("_ke", size)
    return rows.withColumn(name, F.when(v.isNotNull(), F.when(v < 0, -e).otherwise(e))).drop("_kv", "_ka", "_ke")


def value_of_key(key: Column) -> Column:
    """The double of :func:`with_ordered_key`."""
    size = F.abs(key)
    exponent, fraction = F.shiftright(size, 52), size.bitwiseAND(_FRACTION - 1)
    normal = (fraction / float(_FRACTION) + 1.0) * F.pow(F.lit(2.0), exponent - 1023)
    plain = F.when(exponent == 0, size * _LEAST).when(exponent < 0x7FF, normal).when(fraction == 0, float("inf")).when(fraction > 0, float("nan"))
    return F.when(key < 0, -plain).otherwise(plain)


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    other = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    joined = left.join(other, on, how)
    return joined if how == "left_semi" else joined.drop(*[f"_r_{k}" for k in keys])


def _cells(rows: DataFrame, by: list[str], shift: int) -> DataFrame:
    """Per ``by``: its cells (digit, rows, least and greatest key) in order; at most ``2 ** DIGIT``."""
    digit = F.shiftright("_k", shift)
    counted = rows.groupBy(*by, digit.alias("_d")).agg(F.count(F.lit(1)).alias("_c"), F.min("_k").alias("_lo"), F.max("_k").alias("_hi"))
    cell = F.struct(F.col("_d").alias("d"), F.col("_c").alias("c"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"))
    return counted.groupBy(*by).agg(F.array_sort(F.collect_list(cell)).alias("_cells"), F.sum("_c").alias("_n"))


def _locate(rank: Column) -> Column:
    """The cell of ``_cells`` that holds the row of a rank (from 0), and the row's rank inside it."""
    start = F.struct(rank.cast("long").alias("left"), F.lit(None).cast("struct<d:bigint,c:bigint,lo:bigint,hi:bigint>").alias("cell"))
    step = lambda s, c: F.when(s["cell"].isNotNull(), s).when(
        s["left"] < c["c"], F.struct(s["left"].alias("left"), c.alias("cell"))).otherwise(
        F.struct((s["left"] - c["c"]).alias("left"), s["cell"].alias("cell")))
    return F.aggregate("_cells", start, step)


def _wanted(located: DataFrame, keys: list[str], shift: int) -> DataFrame:
    """One row per group and wanted rank; ``_found`` is its key once known. Stored."""
    c = F.col("_at.cell")
    return stored(located.select(
        *keys, "_n", "_slot", c["d"].alias("_prefix"), F.col("_at.left").alias("_left"), c["c"].alias("_size"),
        F.when((c["lo"] == c["hi"]) | F.lit(shift == 0), c["lo"]).alias("_found")))


def exact_percentiles(df: DataFrame, keys: list[str], value: Column, probs: dict[str, float], few: int = FEW) -> DataFrame:
    """One row per key: ``keys`` + one linearly interpolated percentile per entry of ``probs``.

    Nulls are ignored; null keys are keys; ``keys`` must not be empty. Values are taken as doubles. One to four rounds run
    as jobs when the function is called; reading the values of the last cells is lazy.
    """
    if df.isStreaming:
        raise ValueError("percentiles need a bounded table")
    names = sorted(probs)
    # Nulls go before keys are made: a filter on a key would be pushed below and compute it once more.
    rows = df.select(*keys, value.cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    rows = with_ordered_key(rows, F.col("_v")).drop("_v")
    shift = 64 - DIGIT
    at = [(F.col("_n") - 1) * F.lit(probs[n]) for n in names]
    ranks = F.array(*[f(h) for h in at for f in (F.floor, F.ceil)])
    first = _cells(rows, keys, shift)
    wanted = _wanted(first.select(*keys, "_n", "_cells", F.posexplode(ranks).alias("_slot", "_rank")).withColumn("_at", _locate(F.col("_rank"))), keys, shift)

    open_ = F.col("_found").isNull()
    while shift and not wanted.filter(open_ & (F.col("_size") > few)).isEmpty():
        inside = wanted.filter(open_).select(*keys, "_prefix").distinct()
        left = _null_safe(rows.withColumn("_prefix", F.shiftright("_k", shift)), inside, [*keys, "_prefix"], "left_semi")
        shift -= DIGIT
        cells = _cells(left, [*keys, "_prefix"], shift).drop("_n")
        located = _null_safe(wanted.filter(open_), cells, [*keys, "_prefix"]).withColumn("_at", _locate(F.col("_left")))
        wanted = wanted.filter(~open_).unionByName(_wanted(located, keys, shift))

    done = wanted.filter(~open_).select(*keys, "_n", "_slot", "_found")
    # Few rows per cell from here on.
    inside = wanted.filter(open_).select(*keys, "_prefix").distinct()
    left = _null_safe(rows.withColumn("_prefix", F.shiftright("_k", shift)), inside, [*keys, "_prefix"], "left_semi")
    lists = left.groupBy(*keys, "_prefix").agg(F.sort_array(F.collect_list("_k")).alias("_list"))
    listed = _null_safe(wanted.filter(open_), lists, [*keys, "_prefix"])
    done = done.unionByName(listed.select(*keys, "_n", "_slot", F.get("_list", F.col("_left").cast("int")).alias("_found")))
    values = [F.max(F.when(F.col("_slot") == i, F.col("_found"))).alias(f"_s{i}") for i in range(2 * len(names))]
    picked = done.groupBy(*keys).agg(F.max("_n").alias("_n"), *values)
    out = []
    for i, n in enumerate(names):
        lo, hi = value_of_key(F.col(f"_s{2 * i}")), value_of_key(F.col(f"_s{2 * i + 1}"))
        out.append((lo + (hi - lo) * (at[i] - F.floor(at[i]))).alias(n))
    ordered = dict(zip(names, out))
    return picked.select(*keys, *[ordered[n] for n in probs])
