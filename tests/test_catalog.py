"""Every query with SQL against DuckDB on the smallest tables; and on tables without rows."""

import decimal
import os

import duckdb
import pytest

from corpusloom.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return float(f"{v:.6g}") if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for f in os.listdir(DATA):
        spark.read.parquet(f"{DATA}/{f}").limit(0).write.parquet(f"{d}/{f}")
    return d


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    mine = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    cur = duck.execute(catalog.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


LITERAL = {"manifest_npm", "manifest_go", "manifest_py", "model_registry", "scan_files", "implements", "implementations_of", "dir_tree"}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - LITERAL))
def test_empty_tables(spark, empty, name):
    assert catalog.QUERIES[name](spark, empty).count() == 0
