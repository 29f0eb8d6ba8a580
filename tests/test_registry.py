"""Every registered query equals its SQL on the smallest data set."""

import pytest

from __spark_entry__ import SMOKE_DIR, entry, oracle_sql, queries
from scripts.check_queries import compare, connect
from transectra.workload import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SMOKE_DIR)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["code", "ok", "warn", "fail", "unverified"] and df.count() == 12


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, con, name):
    text, good = compare(spark, con, SMOKE_DIR, name)
    assert good, text
