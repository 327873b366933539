import numpy as np
import pytest
from conftest import rows

from corpusloom.llm import neighbours as N


def records(spark, x, extra=()):
    data = [(f"r{i:04d}", None if v is None else [None if c is None else float(c) for c in v], '{"updated_at": "1"}') for i, v in enumerate(x)]
    return spark.createDataFrame([*data, *extra], "id string, vector array<float>, metadata string").repartition(4)


def exact(x, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return s, np.argsort(-s, axis=1, kind="stable")[:, :k]


@pytest.fixture(scope="module")
def clustered():
    r = np.random.default_rng(1)
    c = r.standard_normal((60, 64))
    return (np.repeat(c, 50, 0) + 0.25 * r.standard_normal((3000, 64))).astype(np.float32)


def test_recall_over_the_index(spark, clustered):
    _, want = exact(clustered.astype(np.float64))
    got = N.nearest(records(spark, clustered), leaf=100).collect()
    found = {(r.id, r.neighbour) for r in got}
    true = {(f"r{i:04d}", f"r{j:04d}") for i, row in enumerate(want) for j in row}
    assert len(found & true) / len(true) >= 0.9
    assert all(r.rank <= 5 for r in got) and len(found) == len(got)


def test_full_leaves_are_worked_in_blocks(spark, clustered):
    x = clustered[:600]
    a = {(r.id, r.neighbour) for r in N.nearest(records(spark, x), leaf=300, block=64).collect()}
    b = {(r.id, r.neighbour) for r in N.nearest(records(spark, x), leaf=300).collect()}
    assert a == b


def test_small_collections_are_exact(spark):
    x = np.random.default_rng(2).standard_normal((40, 64)).astype(np.float32)
    s, want = exact(x.astype(np.float64))
    got = {(r.id, r.neighbour) for r in N.nearest(records(spark, x)).collect()}
    assert got == {(f"r{i:04d}", f"r{j:04d}") for i, row in enumerate(want) for j in row}


def test_unusable_and_repeated(spark):
    v = [1.0] + [0.0] * 63
    w = [1.0, 0.1] + [0.0] * 62
    bad = [("null", None, None), ("empty", [], None), ("short", v[:32], None), ("zero", [0.0] * 64, None), ("nan", [float("nan"), *v[1:]], None), ("inf", [float("inf"), *v[1:]], None), ("hole", [None, *v[1:]], None), (None, v, None)]
    good = [("a", v, "{bad"), ("a", v, None), ("b", w, '{"updated_at": "5"}'), ("b", [-1.0] * 64, '{"updated_at": "3"}')]
    df = spark.createDataFrame([*bad, *good], "id string, vector array<float>, metadata string")
    assert rows(N.close_pairs(df)) == [("a", "b")]
    assert N.close_pairs(df.filter("id = 'a'")).count() == 0 and N.close_pairs(df.limit(0)).count() == 0


def test_copies(spark):
    v = [1.0] + [0.0] * 63
    w = [1.0, 0.2] + [0.0] * 62
    df = spark.createDataFrame([(f"c{i}", v, None) for i in range(8)] + [("x", w, None)], "id string, vector array<float>, metadata string")
    got = {}
    for r in N.nearest(df).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    assert got["c0"] == ["c1", "c2", "c3", "c4", "c5"] and got["c7"] == ["c0", "c1", "c2", "c3", "c4"] and got["x"] == ["c0", "c1", "c2", "c3", "c4"]


def test_registered_query_gives_all_five(spark, tmp_path):
    from corpusloom.llm import queries as Q

    r = np.random.default_rng(4)
    x = (np.repeat(r.standard_normal((60, 64)), 50, 0) + 0.55 * r.standard_normal((3000, 64))).astype(np.float32)
    records(spark, x).write.parquet(f"{tmp_path}/records.parquet")
    s, want = exact(x.astype(np.float64))
    got = Q.queries()["p6_neighbours"](spark, str(tmp_path)).collect()
    assert len(got) == 5 * len(x) and sum(a.cosine < 0.8 for a in got) > 1000
    true = {(f"r{i:04d}", f"r{j:04d}") for i, row in enumerate(want) for j in row}
    assert len({(a.id, a.neighbour) for a in got} & true) / len(true) >= 0.9
