"""Every query of the core against DuckDB, on the smallest tables."""

import pytest
from helpers import connection, rows

import factloom.queries as q


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, sf, con, name):
    found = q.QUERIES[name](spark, sf).toPandas()
    if name in q.ORACLE_SQL:
        assert rows(found) == rows(con.execute(q.ORACLE_SQL[name]).df())
    else:
        assert list(found.columns)


def test_guarded_rows_are_whole(spark):
    """More rows than a reader's bound (500)."""
    folder, name = "/root/testdata/sf0.1", "set_union_all"
    want = rows(connection(folder).execute(q.ORACLE_SQL[name]).df())
    assert len(want[1]) == 1484 and rows(q.QUERIES[name](spark, folder).toPandas()) == want


def test_every_oracle_has_a_query():
    assert set(q.ORACLE_SQL) <= set(q.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
