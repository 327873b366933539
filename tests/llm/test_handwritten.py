import itertools

import numpy as np
from conftest import rows

from corpusloom.llm import handwritten as H

CODE = "def load(value):\n    if value is None:\n        return value\n    return other(value)\n" * 4
MIN = "function aB(a,b){return a.x?b(a):3}var c=d.e||{},f=[1,2];" * 12


def evidence_label(path, text):
    return H.LABELS[int(H.evidence(path, text).argmax())]


def test_evidence():
    assert evidence_label("a.go", "// Code generated by tool. DO NOT EDIT.\npackage a\n") == "generated"
    assert evidence_label("a.py", "# Generates the lookup tables at start-up; edit freely.\n" + CODE) == "handwritten"
    assert evidence_label("a.py", "# Do not edit the order of these rules without a test.\n" + CODE) == "handwritten"
    assert evidence_label("a.py", 'BANNER = "auto-generated, do not edit"\n' + CODE) == "handwritten"
    assert evidence_label("a.py", "# Imported from the X distribution, release 1.2.3. Local patches: none.\n" + CODE) == "vendored"
    assert evidence_label("a.py", "# Inspired by X 0.1, written anew for this project.\n" + CODE) == "handwritten"
    assert evidence_label("a.js", MIN) == "minified"
    assert evidence_label("a.py", "X = [\n" + "    0x12, 0xaf, 0x00, 0x7b, 0x12, 0xaf, 0x00, 0x7b, 0x00, 0x11,\n" * 40 + "]\n") == "blob"
    assert evidence_label("a.ts", 'export const A = "' + "The words of a long text go on. " * 60 + '";\nexport const B = 2;\n' + CODE) == "handwritten"
    assert evidence_label("a.pb.go", CODE) == "generated"


def files(spark, data):
    return spark.createDataFrame([(p, f, t, 1, "x") for p, f, t in data], "project_id string, path string, content string, updated_at long, label string").repartition(3)


def test_propagation_equals_enumeration(spark):
    """Marginals of a small tree against the sum over all labellings."""
    data = [("p", "a.py", "x\n"), ("p", "lib/b.go", "// Code generated by x. DO NOT EDIT.\n"), ("p", "lib/c.go", CODE), ("p", "lib/deep/d.js", "y")]
    got = {r.path: r for r in H.labels(files(spark, data)).collect()}
    dirs = ["", "lib", "lib/deep"]
    n = len(H.LABELS)
    marginal = {f: np.zeros(n) for _, f, _ in data}
    ed = {d: H.directory_evidence(d.split("/")) for d in dirs}
    for combo in itertools.product(range(n), repeat=len(dirs)):
        at = dict(zip(dirs, combo))
        w = np.log(H.ROOT[at[""]]) + ed[""][at[""]]
        for d, up in (("lib", ""), ("lib/deep", "lib")):
            w += np.log(H.DIRECTORY[at[up], at[d]]) + ed[d][at[d]]
        each = {}
        for _, f, t in data:
            each[f] = np.log(H.FILE[at[f.rpartition("/")[0]]]) + H.evidence(f, t)
        sums = {f: np.logaddexp.reduce(v) for f, v in each.items()}
        total = w + sum(sums.values())
        for f, v in each.items():
            marginal[f] += np.exp(total - sums[f] + v)
    for f, m in marginal.items():
        m = m / m.sum()
        assert got[f].label == H.LABELS[int(m.argmax())] and abs(got[f].confidence - m.max()) < 1e-6


def test_rows(spark):
    data = [("p", f"vendor/pkg/f{i}.py", CODE) for i in range(4)] + [("p", f"src/f{i}.py", CODE) for i in range(9)]
    data += [("p", "src/g.py", "# @generated by x from y.idl\n" + CODE), ("p", "packages/vendor/h.py", CODE), ("p", "src/vendor_push.go", CODE), ("p", "internal/generated/k.go", CODE), ("p", "dist/l.bundle.js", MIN), ("p", "src/e.py", None), ("p", "src/e2.py", ""), ("p", "readme.md", "# x"), ("q", "top.js", MIN), ("p", "src/g.py", "# @generated by x from y.idl\n" + CODE)]
    want = [("p", f"vendor/pkg/f{i}.py") for i in range(4)] + [("p", "src/g.py"), ("p", "internal/generated/k.go"), ("p", "dist/l.bundle.js"), ("q", "top.js")]
    assert rows(H.not_handwritten(files(spark, data))) == sorted(want, key=repr)
    assert H.not_handwritten(files(spark, data).limit(0)).count() == 0
    odd = [("r", f, CODE) for f in ("/x/y.py", "/z.py", "w.py", "a//b/c.py", "a/b/d.py", "/vendor/pkg/e.py")]
    assert rows(H.labels(files(spark, odd)).select("path", "label")) == sorted([(f, "vendored" if "vendor" in f else "handwritten") for _, f, _ in odd], key=repr)


def test_a_few_marked_files_do_not_mark_their_directory(spark):
    data = [("p", f"lib/f{i}.py", CODE) for i in range(60)] + [("p", f"lib/v{i}.py", "# Upstream: X, tag 1.2.3; please send fixes there.\n" + CODE) for i in range(5)] + [("p", f"lib/g{i}.py", "# @generated by x from y\n" + CODE) for i in range(5)]
    got = {r.path for r in H.not_handwritten(files(spark, data)).collect()}
    assert got == {f"lib/{k}{i}.py" for k in "vg" for i in range(5)}


def test_whole_header():
    licence = [f"line {i} of a long licence" for i in range(60)]
    notice, owner = "Code generated by tool. DO NOT EDIT.", "Copyright (c) The Frame Contributors"
    assert evidence_label("a.py", "".join(f"# {x}\n" for x in [*licence, notice]) + CODE) == "generated"
    for begin, end in (("/*", "*/"), ("<?php /*", "*/"), ("<?php\n/**", " */"), ('"""', '"""'), ("<!--", "-->")):
        for text, label in ((notice, "generated"), (owner, "vendored"), ("plain words", "handwritten")):
            assert evidence_label("a.js", "\n".join([begin, *licence, "", text, "more", end]) + "\n" + CODE) == label
        assert H.header("\n".join([begin, "head", end, "run()", f"// {notice}"])).split() == ["head"]
    assert H.header("/* one */\n// two\nrun()\n/* three */") == "one\ntwo"


def test_notices_below_the_head():
    code = "import x\n\ndef f(a):\n    return a\n"
    for line in ("# Code generated by forge. DO NOT EDIT.", "# This file was automatically produced from a.proto; manual changes will be lost.", "# Do not modify by hand: output of forge"):
        assert H.notice_below(code + line + "\n") and H.evidence("lib/a.py", code + line)[1] > 8
        assert H.notice_below(code + line + "\n" + code)
    for line in ('BANNER = "Code generated by forge. DO NOT EDIT."', "# writes the files below generated/ and skips those marked as not to be edited", "# Do not edit the order of these rules without a test.", "# Generates tables at start-up; edit freely.", "", "#"):
        assert not H.notice_below(code + line + "\n")
