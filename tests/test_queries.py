import pytest

from tagquarry.queries import QUERIES, SQL

from .oracle import DATA, connect, oracle_rows, rows_of


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    names, rows = rows_of(QUERIES[name](spark, DATA))
    if name in SQL:
        assert (names, rows) == oracle_rows(con, SQL[name])
    else:
        assert rows
