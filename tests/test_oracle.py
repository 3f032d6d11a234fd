"""Every registered query against its SQL on the smallest tables; the rest must run and give rows."""

import pytest
from compare import difference, oracle, type_names

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_the_sql(name, spark, con):
    df = QUERIES[name](spark, SF_DIR)
    report, _ = difference(df, con, SQL[name])
    assert report is None, report
    assert type_names(df, con, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(name, spark):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 5
