"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["query_id", "id", "score", "rank"] and df.count() > 0


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        problem = difference(spark, con, QUERIES[name], SQL[name], FOLDER)
        assert problem is None or problem == "no rows", problem
    else:
        assert QUERIES[name](spark, FOLDER).count() >= 0
