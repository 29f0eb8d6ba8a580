"""Running sums against plain loops."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from transectra.functions.prefix import running_sums


def test_running_sums_per_group(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), rng.randrange(50), rng.randrange(9)) for _ in range(800)]
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(7)
    got = running_sums(df, ["g"], ["k"], {"s": "v", "i": F.lit(1)}).collect()
    assert sorted(((r.g, r.k, r.v) for r in got), key=repr) == sorted(rows, key=repr)
    groups = defaultdict(list)
    for r in got:
        groups[r.g].append(r)
    for rs in groups.values():
        rs.sort(key=lambda r: r.i_before)
        assert [r.i_before for r in rs] == list(range(len(rs)))
        assert [r.k for r in rs] == sorted(r.k for r in rs)
        total = 0
        for r in rs:
            assert (r.s_before, r.i_all) == (total, len(rs))
            total += r.v
        assert {r.s_all for r in rs} == {total}


def test_one_group_of_equal_rows_is_spread(spark):
    df = spark.range(4000).select(F.lit("x").alias("g"), F.lit(1).alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running_sums(df, ["g"], ["k"], {"i": F.lit(1)})
        assert sorted(r.i_before for r in got.collect()) == list(range(4000))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_groups_and_no_rows(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "k int")
    got = running_sums(df, [], ["k"], {"s": "k"})
    assert sorted((r.k, r.s_before, r.s_all) for r in got.collect()) == [(1, 0, 6), (2, 1, 6), (3, 3, 6)]
    assert running_sums(df.limit(0), [], ["k"], {"s": "k"}).collect() == []


def test_facts_come_along(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "g string, k int")
    facts = spark.createDataFrame([("a", 10), (None, 20)], "g string, f int")
    got = running_sums(df, ["g"], ["k"], {"s": "k"}, facts)
    assert sorted(((r.g, r.f) for r in got.collect()), key=repr) == sorted([("a", 10), (None, 20), ("b", None)], key=repr)
