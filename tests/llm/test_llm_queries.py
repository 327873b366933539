"""The registered queries on the smallest tables, on tables without rows, and against their SQL."""

import os

import duckdb
import pytest
from conftest import rows

from corpusloom.llm import queries as Q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_runs(spark, name):
    Q.queries()[name](spark, DATA).collect()


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for f in os.listdir(DATA):
        spark.read.parquet(f"{DATA}/{f}").limit(0).write.parquet(f"{d}/{f}")
    return d


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - {"p8_report"}))
def test_empty(spark, empty, name):
    assert Q.queries()[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    df = Q.queries()[name](spark, DATA)
    cur = con.execute(Q.oracle_sql()[name])
    assert [c[0] for c in cur.description] == df.columns
    assert rows(df) == sorted(cur.fetchall(), key=repr)
