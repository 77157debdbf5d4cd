"""Every query with SQL gives the same rows as DuckDB."""

import datetime
import decimal

import duckdb
import pytest

from lodestrata.plans import catalog


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, decimal.Decimal):
        return float(v) if v % 1 else int(v)
    return v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in catalog.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    r = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = [tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall()]
    assert sorted(rows, key=str) == sorted(want, key=str)
