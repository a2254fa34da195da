"""Every registered query runs on the smallest tables; those with SQL must agree with it."""

import pytest

import __spark_entry__ as entry
from check import compare, duck

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(tiny):
    return duck(tiny)


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tiny, con, name):
    df = QUERIES[name](spark, tiny)
    rows = [tuple(r) for r in df.collect()]
    if name in SQL:
        cur = con.execute(SQL[name])
        cols = [d[0] for d in cur.description]
        assert compare(rows, df.columns, cur.fetchall(), cols) is None
    else:
        assert rows, name


def test_entry(spark):
    assert entry.entry(spark).count() > 0
