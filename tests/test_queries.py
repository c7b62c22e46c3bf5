"""Registered queries against their SQL, and the entry points."""

import os

import duckdb
import pytest
from sieveline.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(catalog.queries()) + sorted(catalog.FIXED))
def test_query(spark, name):
    query, oracle = catalog.FIXED.get(name) or (catalog.queries()[name], catalog.oracle_sql().get(name))
    out = query(spark, SF)
    rows = out.collect()
    if oracle is None:
        assert rows
        return
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    r = con.execute(oracle)
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(out.columns)
    assert sorted((tuple(map(plain, x)) for x in r.fetchall()), key=repr) == sorted((tuple(plain(x[n]) for n in names) for x in rows), key=repr)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).first().total == 200
    assert set(e.oracle_sql()) <= set(e.queries())
