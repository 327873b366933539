"""Columns on literal rows: imports, scores, patches, guards, text."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import code, text
from corpusloom.operators import chunking
from corpusloom.sources import files


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "ext, content, wanted",
    [
        ("js", "import { foo } from './foo';\nimport * as b from \"bar\";\nconst z = require('baz');", {"./foo", "foo", "bar", "baz"}),
        ("go", 'import "fmt"\nimport (\n\t"os"\n\t"path/filepath"\n)', {"fmt", "os", "path/filepath"}),
        ("rs", "use std::collections::HashMap;\nuse crate::db::Store;", {"std::collections::HashMap", "crate::db::Store"}),
        ("php", "use App\\A as B, App\\C;\nrequire_once('x.php');", {"App\\A", "App\\C", "x.php"}),
        ("py", "import os", set()),
        ("ts", "import 'vue';", {"vue"}),
    ],
)
def test_imports(spark, ext, content, wanted):
    got = one(spark, code.imports(F.col("c"), F.col("e")), c=content, e=ext)
    assert set(got) == wanted and len(got) == len(set(got))


@pytest.mark.parametrize("content, lines", [("a 😀\nb\nc", [(1, 3)]), ("A\nB\nC\n", [(1, 4)]), ("A\nB\nC", [(1, 3)]), ("A" * 3000 + "\n", [(1, 1), (1, 2)]), ("", [])])
def test_windows(spark, content, lines):
    df = spark.createDataFrame([("p", content), ("q", None)], "path string, content string")
    got = chunking.windows(df, ["path"], "content").orderBy("chunk_index").collect()
    assert [(r.start_line, r.end_line) for r in got] == lines


def test_windows_reassemble(spark):
    t = "".join(chr(97 + i % 26) for i in range(10_001))
    got = chunking.windows(spark.createDataFrame([(1, t)], "i int, t string"), ["i"], "t").orderBy("chunk_index").collect()
    assert got[0].chunk + "".join(r.chunk[500:] for r in got[1:]) == t


def test_patch_and_guard(spark):
    p = lambda t, a, b: one(spark, code.patch_first(F.col("t"), F.col("a"), F.col("b")), t=t, a=a, b=b)
    assert p("x.y.x", "x", "zz") == "zz.y.x" and p("abc", "d", "e") == "abc" and p("abc", "", "e") == "abc"
    g = lambda path: one(spark, code.path_allowed(F.col("p")), p=path)
    assert g("a/b.txt") and g("a/../b") and not g("../outside.txt") and not g("a/../../b") and not g("/etc/x") and not g("/".join("a" * 21))


def test_score_and_labels(spark):
    df = spark.createDataFrame([(1, 2, ["a"]), (1, 20, ["a", "b"]), (None, None, None), (9, 3, [])], "s int, e int, c array<string>")
    assert [r[0] for r in df.select(code.importance(F.col("s"), F.col("e"), F.col("c"))).collect()] == [0.8, 1.4, 0.7, 0.7]
    ok = spark.createDataFrame([("pdf", 10_000_000), ("go", 1_000_000), ("go", 1_000_001), ("jsx", 5), ("py", None)], "e string, n long")
    assert [r[0] for r in ok.select(code.is_indexable(F.col("e"), F.col("n"))).collect()] == [True, True, False, False, False]


def test_text(spark):
    assert one(spark, F.array_join(text.tokens(F.col("t")), "|"), t="Ab-c 12 " + "x" * 40) == "ab|c|12"
    assert one(spark, F.array_join(text.split_list(F.col("t")), "|"), t=" a, ,b ") == "a|b"
    assert one(spark, text.field(F.col("t"), "k"), t="{broken") == "" and one(spark, text.field(F.col("t"), "k"), t='{"k": 1}') == "1"
    assert one(spark, text.with_prefix(F.col("t"), "q: "), t="q: a") == "q: a"
    bad = spark.createDataFrame([(bytearray(b"a\xffb"),)], "b binary").select(text.utf8_lossy(F.col("b"))).first()[0]
    assert bad == "a�b"


def test_manifests(spark):
    assert one(spark, files.npm_dependencies(F.col("t")), t="{bad") == [] and one(spark, files.go_dependencies(F.col("t")), t="module x\ngo 1.2\na.b/c v1") == ["a.b/c"]
    assert one(spark, files.python_dependencies(F.col("t")), t="# x\na==1\nb\n") == ["a", "b"]


def test_scan(spark, tmp_path):
    for name in ("a.go", "node_modules/b.js", ".git/c", "sub/d.py", "sub/.hidden"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x\xff")
    assert {r.path for r in files.scan(spark, str(tmp_path)).collect()} == {"a.go", "sub/d.py"}
    got = {r.path: r.content for r in files.read(spark, str(tmp_path)).collect()}
    assert got["a.go"] == "x�"
