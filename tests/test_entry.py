import os
import re

import pytest

import __spark_entry__ as entry
from crawlquarry.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_names_match():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 80
    assert {"host_heads", "p3_found"} <= set(q)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = catalog.queries()[name](spark, DATA)
    cur = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(r[names.index(c)]) for c in df.columns) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(plain(x) for x in r) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_plans_push_down(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    plan = catalog.queries()["page_totals"](spark, DATA)._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[.*IsNotNull\(url_hash\)", plan)
