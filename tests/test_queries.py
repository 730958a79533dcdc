"""Every query with SQL against DuckDB on the smallest tables; every other one runs."""

import os

import pytest

from spectraloom.plans import dirty_fields, reports, spectral, structures

MODULES = (dirty_fields, spectral, structures, reports)
ALL = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in MODULES for name, s in m.SQL.items()}


@pytest.fixture(scope="module")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return con


def plain(v):
    return "" if v is None else str(v) if isinstance(v, bool) else f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, sf_dir, duck, name):
    df = ALL[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name in SQL:
        rel = duck.sql(SQL[name])
        assert sorted(rel.columns) == columns
        at = [rel.columns.index(c) for c in columns]
        assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_the_entry_point_names_them_all():
    import __spark_entry__ as entry

    assert set(ALL) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
