import os

import pytest

from crawlquarry.llm import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
COLUMNS = {
    "p1_found": ["url_hash", "line_no"], "p2_found": ["url_hash"], "p4_found": ["url_hash_a", "url_hash_b"], "p5_found": ["url_hash"], "p6_found": ["url_hash", "line_no"],
    "p7_found": ["url_hash"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "kind", "matched"],
}


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_runs_with_the_stated_columns(spark, name):
    df = catalog.queries()[name](spark, DATA)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(rows) == len({tuple(map(str, r)) for r in rows})


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    df = catalog.queries()[name](spark, DATA)
    cur = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(cur.fetchall())
