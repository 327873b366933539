"""Operators on small literal tables, against brute force or worked results."""

import itertools
import random

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from corpusloom.operators import analysis, chunking, fusion, graph, lexical, store, vectors


def test_store(spark, tmp_path):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, None)], "id int, v string")
    assert rows(store.upsert(base, new, ["id"])) == [(1, "a"), (2, "c"), (3, None)]
    assert rows(store.delete(base, new, ["id"])) == [(1, "a")]
    assert rows(store.patch(base, new, ["id"], "v")) == [(1, "a"), (2, "c")]
    assert rows(store.current(spark.createDataFrame([(1, 5, "x"), (1, None, "z"), (1, 7, "y")], "id int, t int, v string"), ["id"], "t")) == [(1, 7, "y")]
    s = store.Store(spark, str(tmp_path))
    assert s.read("t") is None
    s.append("t", base)
    s.upsert("t", new, ["id"])
    s.append("t", spark.createDataFrame([(9, "n")], "id int, v string"))
    s.delete("t", spark.createDataFrame([(1,)], "id int"), ["id"])
    assert rows(s.read("t")) == [(2, "c"), (3, None), (9, "n")]


def test_contained_against_pairs(spark):
    r = random.Random(4)
    c = {(r.choice("xy"), *sorted((r.randint(1, 20), r.randint(1, 20)))) for _ in range(120)}
    want = [a for a in c if not any(b[0] == a[0] and b[1] <= a[1] and b[2] >= a[2] and b[2] - b[1] > a[2] - a[1] for b in c)]
    df = spark.createDataFrame(sorted(c), "k string, start_line int, end_line int")
    assert rows(chunking.drop_contained(df, ["k"]).select("k", "start_line", "end_line")) == sorted(want, key=repr)


def test_knn_exact_and_ivf(spark):
    x = np.random.default_rng(0).standard_normal((300, 8))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(None, [0.0] * 8), (900, None)], "id long, v array<double>").repartition(5)
    q = v.filter("id < 7")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(7) for j in np.argsort(d[i])[:5]}
    assert {(r.query_id, r.id) for r in vectors.knn(v, q, 5).collect()} == want
    ivf = {(r.query_id, r.id) for r in vectors.ivf_knn(v, q, 5, lists=8, probes=8).collect()}
    assert ivf == want
    part = {(r.query_id, r.id) for r in vectors.ivf_knn(v, q, 5, lists=8, probes=4).collect()}
    assert len(part & want) / len(want) >= 0.6
    assert vectors.knn(v.filter("id is null"), q, 5).count() == 0 and vectors.knn(v, q.filter("id > 99"), 5).count() == 0


def test_knn_ties_take_the_smaller_id(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(6)], "id long, v array<double>").repartition(3)
    got = [r.id for r in vectors.knn(v, v.filter("id = 3"), 3, "cosine").orderBy("rank").collect()]
    assert got == [0, 1, 2]


def test_normalise_and_quantise(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(vectors.l2_normalize(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert df.select(vectors.quantize(F.col("v"))).first()[0] == [76, 102]


def test_lexical(spark):
    docs = spark.createDataFrame([(1, "the retry queue"), (2, "queue retry queue queue"), (3, None), (4, "")], "id long, text string")
    got = lexical.bm25(docs, ["queue"], 10).collect()
    assert [r.id for r in got] == [2, 1]
    assert lexical.bm25(docs, ["absent"], 10).count() == 0 and lexical.bm25(docs, [], 3).count() == 0
    assert rows(lexical.postings(docs))[0] == (1, "queue", 1)
    assert [r.id for r in docs.filter(lexical.phrase(F.col("text"), ["retry", "queue"])).collect()] == [1, 2]
    assert rows(lexical.grep(docs, "RETRY")) == [(1, 1, "the retry queue"), (2, 1, "queue retry queue queue")]
    assert rows(lexical.keyword_topk(docs, ["queue"], 1).select("id", "tf")) == [(2, 3)]


def test_rrf_is_symmetric(spark):
    a = spark.createDataFrame([(i, r + 1) for r, i in enumerate([5, 3, 9])], "id int, rank int")
    b = spark.createDataFrame([(i, r + 1) for r, i in enumerate([3, 7])], "id int, rank int")
    x, y = fusion.rrf(a, b, 10).collect(), fusion.rrf(b, a, 10).collect()
    assert x == y and x[0].id == 3 and len(x) == 4


def test_budget(spark):
    df = spark.createDataFrame([("a", 1, 50), ("a", 2, 1), ("b", 1, 4), ("b", 2, 5), ("b", 3, 9)], "g string, o int, n int")
    got = rows(fusion.within_budget(df, F.col("n"), 10, ["g"], F.col("o")).select("g", "o"))
    assert got == [("a", 1), ("b", 1), ("b", 2)]


def test_dead_and_tests(spark):
    c = spark.createDataFrame(
        [("a.go", ["X.used", "gone"], ["other"]), ("b.go", ["other"], ["used"]), ("t/test_a.go", ["only"], ["gone"]), ("internal/c.go", ["inner"], None), ("n.go", None, None)],
        "path string, symbols array<string>, calls array<string>",
    )
    assert rows(analysis.dead_symbols(c)) == [("gone", "a.go"), ("inner", "internal/c.go")]
    assert rows(analysis.dead_symbols(c, library=True)) == [("inner", "internal/c.go")]
    assert {r[0] for r in rows(analysis.missing_tests(c))} == {"X.used", "other", "inner"}


def test_rules_against_pairs(spark):
    deps = ["slice", "Map", "a", "no"]
    texts = ["there is No slice here", "forbidden: map", "no amap", "know slices", "No", ""]
    c = spark.createDataFrame([(f"p{i}", [d]) for i, d in enumerate(deps)], "path string, relationships array<string>")
    r = spark.createDataFrame([(f"r{i}", t) for i, t in enumerate(texts)], "rule_id string, text string")
    want = [(f"p{i}", d, f"r{j}") for (i, d), (j, t) in itertools.product(enumerate(deps), enumerate(texts)) if f"no {d.lower()}" in t.lower() or f"forbidden: {d.lower()}" in t.lower()]
    assert rows(analysis.rule_violations(c, r)) == sorted(want, key=repr)


def test_dependencies(spark):
    df = spark.createDataFrame([("a", d) for d in ("./x", "fs", "@s/p/q", "lodash/fp", "useState", "Api", "react", "jest")], "path string, dep string")
    assert rows(analysis.undeclared(df, ["jest"], "npm").select("package")) == [("@s/p",), ("lodash",), ("react",)]
    assert rows(analysis.resolve_aliases(df, [("@s/", "lib/")])) == [("@s/p/q", "lib/p/q")]


def test_sync(spark):
    d = spark.createDataFrame([("a", 5), ("b", 9), ("c", None)], "path string, mtime long")
    i = spark.createDataFrame([("a", 5), ("a", 4), ("b", 8), ("z", 1)], "path string, updated_at long")
    assert rows(analysis.sync_diff(d, i, ["path"])) == [("deleted", 1, 1), ("missing", 1, 0), ("modified", 1, 1), ("same", 1, 2)]


def test_implements(spark):
    g = spark.createDataFrame(
        [("i", "I", "interface_type", '{"method:a": "", "method:b": ""}'), ("e", "E", "interface", "{}"), ("s", "S", "struct", '{"method:a": "", "method:b": "", "field:x": ""}'), ("h", "H", "class", '{"method:a": ""}'), ("n", None, "class", '{"method:a": "", "method:b": ""}'), ("b", "B", "class", "{broken"), ("s", "S", "struct", None)],
        "id string, name string, node_type string, structural_metadata string",
    )
    assert rows(graph.implements(g)) == [("s", "i")]
    assert ("s", "field", "x") in rows(graph.members(g))
