"""Driver contract: entry smoke run, registry shape, oracle agreement at sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tillwise.plans import registry
from tillwise.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert {"customer_id", "frequency", "monetary", "recency", "recency_scaled"} <= set(df.columns)
    assert df.count() > 0


registry.load_all()


def test_registry_shape():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60
    for name, fn in q.items():
        assert fn.__doc__, name
    assert set(registry.QUERIES) <= set(q) and set(registry.ORACLE) <= set(o)
    assert not any(name.startswith("op") for name in registry.QUERIES)


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_oracle_agreement(spark, duck, name):
    sdf = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    srows = sdf.collect()
    so = sorted(range(len(sdf.columns)), key=lambda i: sdf.columns[i])
    do = sorted(range(len(dcols)), key=lambda i: dcols[i])
    a = sorted(repr(tuple(_norm(r[i]) for i in so)) for r in srows)
    b = sorted(repr(tuple(_norm(r[i]) for i in do)) for r in drows)
    assert a == b
