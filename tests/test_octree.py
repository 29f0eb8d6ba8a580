"""Neighbours by the tree against brute force, and how the work grows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from transectra.operators import octree

SCHEMA = "chunk string, id int, x double, y double, z double"


def clouds():
    rng = random.Random(11)
    ball = lambda n, s, at: [tuple(c + rng.gauss(0, s) for c in at) for _ in range(n)]
    yield "uniform", [tuple(rng.random() for _ in range(3)) for _ in range(300)]
    yield "outlier", ball(150, 1e-13, (0.25, 0.5, 0.5)) + [(1e9, 0.0, 0.0)]
    yield "tiny at zero", ball(150, 1e-30, (0.0, 0.0, 0.0)) + [(-1e6, 1.0, 1.0), (1e6, 1.0, 2.0)]
    yield "nested", [(2.0 ** -i, 0.0, 0.0) for i in range(80)]
    yield "plane", [(float(i % 14), float(i // 14), 0.0) for i in range(196)]
    yield "huge", [(rng.choice((-1, 1)) * 1e307 * rng.random(), 0.0, rng.random()) for _ in range(90)]
    yield "lonely", [tuple(10.0 ** rng.randrange(-3, 9) * rng.random() for _ in range(3)) for _ in range(200)]
    yield "two", [(0.0, 0.0, 0.0), (3.0, 4.0, 0.0)]
    yield "one", [(1.0, 1.0, 1.0)]


def brute(points):
    out = {}
    for i, p in enumerate(points):
        ds = [(math.sqrt((p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]) + (p[2] - q[2]) * (p[2] - q[2])), j) for j, q in enumerate(points) if j != i]
        if ds:
            out[i] = min(ds)
    return out


@pytest.mark.parametrize("leaf", [7, 64])
def test_equals_brute_force(spark, leaf):
    sets = {k: list(dict.fromkeys(v)) for k, v in clouds() if leaf > 7 or k != "nested"}
    df = spark.createDataFrame([(k, i, *p) for k, ps in sets.items() for i, p in enumerate(ps)], SCHEMA)
    got = {(r.chunk, r.id): (r.distance, r.nn) for r in octree.nearest(df, leaf=leaf).collect()}
    want = {(k, i): v for k, ps in sets.items() if k != "huge" for i, v in brute(ps).items()}
    assert {k: v for k, v in got.items() if k[0] != "huge"} == want


def test_no_points(spark):
    assert octree.nearest(spark.createDataFrame([], SCHEMA)).collect() == []


def work(spark, monkeypatch, n):
    """Rows that balls make on their way down for a dense cluster of ``n`` beside a far point."""
    rng = random.Random(n)
    rows = [("c", i, rng.gauss(0, 1e-6), rng.gauss(0, 1e-6), rng.gauss(0, 1e-6)) for i in range(n)] + [("c", n, 1e8, 0.0, 0.0)]
    made, down = [], octree._down

    def counted(*args):
        out = down(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(octree, "_down", counted)
    found = octree.nearest(spark.createDataFrame(rows, SCHEMA))
    assert found.count() == n + 1
    monkeypatch.undo()
    return sum(made)


def test_a_dense_cluster_beside_a_far_point_stays_linear(spark, monkeypatch):
    small, large = work(spark, monkeypatch, 2_000), work(spark, monkeypatch, 16_000)
    assert large < 12 * small and large < 12 * 16_000


def test_cells_hold_few_points_and_depth_follows_density(spark):
    df = spark.range(5000).select(F.lit("c").alias("chunk"), F.col("id").cast("int").alias("id"), *[F.rand(s).alias(a) for s, a in enumerate("xyz")])
    far = spark.createDataFrame([("c", 5000, 1e12, 1e12, 1e12)], SCHEMA)
    levels, placed = octree.build(df.unionByName(far), "chunk")
    assert placed.groupBy("cell").count().agg(F.max("count")).first()[0] <= octree.LEAF
    assert placed.count() == 5001 and len(levels) <= 5
