"""Every query with SQL gives the SQL's rows; the others give rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessella import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return f"{float(v):.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in catalog.ORACLE_SQL:
        assert len(set(df.columns)) == len(df.columns)
        return
    r = duck.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
