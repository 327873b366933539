import os

import pytest
from conftest import rows

from corpusloom.engine import Engine, PathError, RateLimiter, guard
from corpusloom.operators.entities import scan

GO = 'package a\n\nimport "x.example/b"\n\n// c {\ntype T struct {\n\tA int\n}\n\nfunc (t *T) Load(s string) error {\n\tx := "}" + `{`\n\treturn save(x)\n}\n\nfunc save(s string) error { return nil }\n'


def write(root, name, content):
    p = os.path.join(root, name)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w") as f:
        f.write(content)


def test_index_search_and_change(spark, tmp_path):
    src, store = str(tmp_path / "src"), str(tmp_path / "store")
    write(src, "pkg/a.go", GO)
    write(src, "lib/b.py", "def alpha(x):\n    return beta(x)\n\nclass C:\n    def m(self):\n        pass\n")
    write(src, "docs/c.md", "# Notes\n\nThe retry queue keeps the vector table.\n")
    write(src, "node_modules/d.js", "function hidden() {}\n")
    e = Engine(spark, store, "p")
    assert e.index(src, now=1)["indexed"] == 3
    c = {(r.path, r.symbols[0] if r.symbols else None): r for r in e.chunks().collect()}
    assert {k for k in c if k[0] == "pkg/a.go"} == {("pkg/a.go", "T"), ("pkg/a.go", "Load"), ("pkg/a.go", "save")}
    assert c["pkg/a.go", "Load"].content.endswith("return save(x)\n}") and c["pkg/a.go", "Load"].calls == ["save"]
    assert c["pkg/a.go", "Load"].relationships == ["x.example/b"] and c["docs/c.md", None].category == "document"
    assert e.index(src, now=2) == {"status": "ready", "indexed": 0, "skipped": 3}
    write(src, "lib/b.py", "def gamma(x):\n    return x\n")
    os.remove(os.path.join(src, "docs/c.md"))
    assert e.index(src, now=3)["indexed"] == 1
    assert {r.path for r in e.chunks().collect()} == {"pkg/a.go", "lib/b.py"}
    assert e.call("search_workspace", "vector", query="save load", limit=2).collect()[0].path == "pkg/a.go"
    assert e.call("search_workspace", "graph", query="GAM").collect()[0].name == "gamma"
    assert e.call("search_workspace", "regex", query="SAVE(X)").count() >= 1
    assert e.call("search_workspace", "turbo", query="save", limit=3).count() == 3
    assert {r.symbol for r in e.call("analyze_code", "dead_code").collect()} >= {"T", "gamma"}
    assert rows(e.call("analyze_code", "architecture")) == [("pkg", "x.example/b")]
    assert [r.package for r in e.call("analyze_code", "dependencies", manifest="module a\n", kind="go").collect()] == ["x.example/b"]
    assert "Godoc" in e.call("analyze_code", "docstring", path="pkg/a.go", entity="Load")
    assert {r.state for r in e.call("search_workspace", "index_status", root=src).collect()} <= {"modified", "same", "missing", "deleted"}
    e.call("workspace_manager", "store_context", text_="note")
    assert e.contexts().count() == 1
    e.call("workspace_manager", "delete_context", path="pkg/a.go")
    assert "pkg/a.go" not in {r.path for r in e.chunks().collect()}
    e.call("workspace_manager", "delete_context", path="ALL")
    assert e.chunks().count() == 0 and e.contexts().count() == 0
    with pytest.raises(KeyError):
        e.call("search_workspace", "nothing")


def test_scan():
    assert [(k, n, a, b) for k, n, a, b in scan(GO, "go")] == [("struct_type", "T", 6, 8), ("method_declaration", "Load", 10, 13), ("function_declaration", "save", 15, 15)]
    assert scan("", "go") == [] and scan("x", "md") == [] and scan("func a() {", "go")[0][1] == "a"


def test_guard(tmp_path):
    base, out = tmp_path / "base", tmp_path / "out"
    base.mkdir()
    out.mkdir()
    (base / "a.txt").write_text("x")
    (base / "link").symlink_to(out)
    assert guard(str(base), "a.txt") and guard(str(base), "new/b.txt", create=True)
    for bad, create in (("../out/x", True), ("../out", False), ("link/x", True), ("missing", False), ("/".join("a" * 30), True)):
        with pytest.raises(PathError):
            guard(str(base), bad, create)


def test_rate_limiter():
    now = [0.0]
    r = RateLimiter(2, 3, lambda: now[0])
    assert [r.allow("k") for _ in range(4)] == [True, True, True, False]
    now[0] = 1.0
    assert [r.allow("k") for _ in range(3)] == [True, True, False] and r.allow("j")
    now[0] = 99.0
    assert r.cleanup(10) == 2
