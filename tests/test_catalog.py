"""Every query with SQL, against DuckDB on the smallest data."""

import duckdb
import pytest

from tidemark.plans import catalog

DATA = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("events", "orders"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    rows = df.collect()
    if name not in SQL:
        assert rows
        return
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    show = lambda x: repr(float(x)) if isinstance(x, float) else str(x)
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(tuple(map(show, r)) for r in rows) == sorted(tuple(show(r[k]) for k in order) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
