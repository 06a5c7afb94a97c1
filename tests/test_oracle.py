"""Every query beside its SQL on the smallest data, and every query without SQL at least runs."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    if name in SQL:
        why, _, _ = compare(spark, con, sf, QUERIES[name], SQL[name])
        assert not why
    else:
        df = QUERIES[name](spark, sf)
        assert len(set(df.columns)) == len(df.columns) and df.count() >= 0
