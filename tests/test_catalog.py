"""Every query of the core against the SQL that gives the same rows."""

import pytest

from foldstone.plans import catalog
from tables import order, rows

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    expected = duck.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert rows(df, *columns) == order(expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0


def test_entry_point(spark, data):
    import __spark_entry__ as entry

    assert {"visible_values", "p2_found", "p5_found"} <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
