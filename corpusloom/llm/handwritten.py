"""Generated, minified, vendored and blob files among source files (problem 1), by belief propagation over
directory trees."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, written

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
SALT = 8

#: P(label of a file | label of its directory), and of a directory given its parent; rows by the parent's label.
FILE = np.array([
    [0.930, 0.030, 0.015, 0.010, 0.015],
    [0.010, 0.950, 0.015, 0.010, 0.015],
    [0.100, 0.030, 0.840, 0.020, 0.010],
    [0.005, 0.020, 0.040, 0.925, 0.010],
    [0.100, 0.050, 0.020, 0.030, 0.800],
])
DIRECTORY = np.array([
    [0.988, 0.002, 0.004, 0.005, 0.001],
    [0.050, 0.920, 0.010, 0.010, 0.010],
    [0.100, 0.020, 0.850, 0.020, 0.010],
    [0.010, 0.005, 0.015, 0.965, 0.005],
    [0.100, 0.050, 0.020, 0.030, 0.800],
])
ROOT = np.array([0.99, 0.003, 0.003, 0.003, 0.001])

# Conventional names of directories and files.
VENDOR_DIRS = {"vendor", "third_party", "thirdparty", "third-party", "3rdparty", "node_modules", "bower_components", "jspm_packages", "external", "externals", "extern", "deps", "godeps", "_vendor", "vendored", "pods", "carthage", "site-packages"}
PLAIN_DIRS = {"test", "tests", "src", "lib", "docs", "doc", "static", "generated", "gen", "internal", "spec", "bin", "cmd", "examples", "scripts", "fixtures", "testdata", "utils", "core", "types"}
GENERATED_DIRS = {"generated", "gen", "__generated__", "autogen", "auto-generated", "_generated", "generated-sources", "gen-src"}
_GENERATED_NAME = re.compile(r"(?:\.pb(?:\.gw|\.validate)?\.\w+|_pb2?(?:_grpc)?\.\w+|_grpc_pb\.\w+|\.(?:generated|gen|g|designer|auto)\.\w+|[_-]generated\.\w+|^zz_generated\..*|_string\.go|_gen\.go|\.freezed\.\w+|_autogen\.\w+)$")
_MINIFIED_NAME = re.compile(r"[^./][.-](?:min|bundle|bundled|packed|prod|chunk)\.\w+$")

_GENERATED_TEXT = re.compile(
    r"(?i)@generated\b|<auto-?generated\b|\bauto-?matically[ -](?:generated|produced|created|written)|\bauto-?generated\b(?! by hand)|\bcode generated\b.{0,80}|\bgenerated (?:by|from|with|using|code|file|automatically)\b"
    r"|\bproduced by\b.{0,60}\b(?:edit|change|overwritten|build)|\b(?:do not|don't|never|must not) (?:edit|modify|change)\b(?: this file| by hand| manually|[.:!*/ -]*$)|(?:any|manual|all|your) (?:edits?|changes|modifications) (?:is|are|will be|would be|get) (?:overwritten|lost|discarded)"
    r"|\bautomatisch (?:erzeugt|generiert|erstellt)|\bg[ée]n[ée]r[ée] automatiquement|\bgenerad[oa] autom[áa]ticamente|\bgerad[oa] automaticamente|\bgenerat[oa] automaticamente|\bthis (?:file|code) (?:is|was) (?:auto|machine|tool)\S*"
)
_NOT_GENERATED = re.compile(r"(?i)edit freely|\bnot (?:auto|generated)|\bgenerates?\b|hand-?written|\border of\b|without a test")
_VENDORED_TEXT = re.compile(
    r"(?i)\bupstream\b|\bbundled copy\b|\bvendored\b|\b(?:imported|copied|taken|adapted|extracted|borrowed|backported) (?:verbatim )?from\b|\blocal (?:patches|changes|modifications)\s*:|\bkept unchanged\b|\bthird[- ]party (?:copy|code from)"
    r"|\(c\) (?:\d{4}[-, \d]* )?the [\w.-]+ (?:contributors|authors|developers|team)\b|\bcopyright\b.{0,30}\bthe [\w.-]+ (?:contributors|authors|developers)\b|/\*!\s*[\w.-]+ v?\d+\.\d|\bpermissive licen[cs]e"
)
_NOT_VENDORED = re.compile(r"(?i)inspired by|written anew|talks to|read here|rewritten|compatible with|our own|public interface")
_KEYWORD = re.compile(r"\b(?:function|func|fn|def|class|return|if|for|foreach|while|const|let|var|import|use|pub|await|impl|struct|type|interface|package|namespace|export|static)\b")
_DATA = re.compile(r"[A-Za-z0-9+/=\\x]{40,}|(?:[-+]?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)[fFuUlL]?\s*,\s*){8,}|(?:\\x[0-9a-fA-F]{2}){10,}")
_IDENTIFIER = re.compile(r"[A-Za-z_$][\w$]*")
_COMMENT = re.compile(r"\s*(?://+!?|#+!?(?!\[)|/\*+!?|\*+/?|<!--|--|;+|\"\"\"|''')\s?(.*)")


_BLOCKS = (("/*", "*/"), ("<!--", "-->"), ('"""', '"""'), ("'''", "'''"))


def header(text: str) -> str:
    """The whole comment with which a file begins, blocks up to their ends; an opening tag and blank lines apart."""
    out, closing = [], ""
    for line in text.split("\n"):
        s = line.strip()
        if not s:
            continue
        if closing:
            body = re.sub(r"^\*+/?\s?", "", s)
            closing = "" if closing in s else closing
        else:
            if s.startswith("<?php"):
                line = line.replace("<?php", "", 1)
                s = line.strip()
                if not _COMMENT.match(line):
                    continue
            elif s.startswith(("#!", "'use strict'", '"use strict"')):
                continue
            m = _COMMENT.match(line)
            if not m:
                break
            body = m.group(1)
            closing = next((end for begin, end in _BLOCKS if s.startswith(begin) and end not in s[len(begin) :]), "")
        out.append(re.sub(r"\s*(?:\*+/|\"\"\"|'''|-->)\s*$", "", body))
    return "\n".join(out)


# Parts of words that every notice of a tool holds; searched before the notices themselves.
_HINTS = ("generate", "produced", "overwritten", "edit", "modify", "automat", "lost", "discarded", "génér", "generad", "gerado", "gerada", "generat")


def notice_below(text: str) -> bool:
    """Whether a comment line below the head is a tool's notice about the file itself: the notice is what the line begins with."""
    low, seen = text.lower(), -1
    for hint in _HINTS:
        at = low.find(hint)
        while at >= 0:
            a, b = low.rfind("\n", 0, at) + 1, low.find("\n", at)
            b = len(low) if b < 0 else b
            if a != seen and b - a < 400:
                seen = a
                m = _COMMENT.match(low[a:b])
                g = _GENERATED_TEXT.search(m.group(1)) if m else None
                if g and g.start() < 30 and not _NOT_GENERATED.search(m.group(1)):
                    return True
            at = low.find(hint, b)
    return False


def evidence(path: str, text: str) -> np.ndarray:
    """Log-likelihoods of what a file is, from its name and content, by label. Ordinary code may be
    handwritten or vendored, the latter less often if its head does not say so."""
    e = np.zeros(len(LABELS))
    name = path.rpartition("/")[2].lower()
    if _GENERATED_NAME.search(name):
        e[1] += 8
    if _MINIFIED_NAME.search(name):
        e[2] += 8
    t = text.lstrip("\ufeff").replace("\r\n", "\n")
    n = len(t)
    if not t.strip():
        return e
    head = header(t)
    for line in head.split("\n"):
        if _GENERATED_TEXT.search(line) and not _NOT_GENERATED.search(line):
            e[1] += 10
            break
    else:
        if notice_below(t):
            e[1] += 10
    for line in head.split("\n"):
        if _VENDORED_TEXT.search(line) and not _NOT_VENDORED.search(line):
            e[3] += 11.5
            break
    longest = max(map(len, t.split("\n")))
    space = sum(map(t.count, " \n\t")) / n
    names = _IDENTIFIER.findall(t)
    single = sum(len(x) <= 2 for x in names) / max(1, len(names))
    words = len(_KEYWORD.findall(t)) * 100 / n
    data = sum(m.end() - m.start() for m in _DATA.finditer(t)) / n
    if n >= 120 and data > 0.6 and words < 0.3:
        e[4] += 14
    elif n >= 150 and space < 0.09 and single > 0.35 and longest > 120:
        e[2] += 14
    elif words > 0.3 or space > 0.08:
        e += (4, 1.5, 0, 2.5, 0)
    return e


def directory_evidence(path: list[str]) -> np.ndarray:
    """Log-likelihoods from the names of a directory and those above it: a package below a vendor directory,
    or a place for output. A vendor directory without packages says little, since modules may be about
    vendors; a directory outside any such place is hardly a foreign tree."""
    e = np.zeros(len(LABELS))
    path = [x.lower() for x in path]
    name = path[-1]
    package = [a in VENDOR_DIRS and b not in PLAIN_DIRS and b not in VENDOR_DIRS for a, b in zip(path, path[1:])]
    if package and package[-1]:
        e[3] += 30
    elif name in VENDOR_DIRS:
        e[3] += 1.5
    elif not any(package):
        e[3] -= 6
    if name in GENERATED_DIRS:
        e[1] += 30
    elif name in ("dist", "build", "public", "min"):
        e[2] += 1
    return e


def _pass(b: np.ndarray, table: np.ndarray) -> np.ndarray:
    """log of sum over the last axis of exp(b) times the table's columns, row by row."""
    top = b.max(1, keepdims=True)
    return np.log(np.exp(b - top) @ table.T) + top


def _rows(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten(), np.float64).reshape(-1, len(LABELS))


def _list(x: np.ndarray) -> pa.Array:
    return pa.array(list(x), pa.list_(pa.float64()))


def _sum(col: str, name: str):
    return F.array(*[F.sum(F.col(col)[i]) for i in range(len(LABELS))]).alias(name)


def _up(df: DataFrame, table: np.ndarray) -> DataFrame:
    """Adds ``m``: the message of belief ``b`` to the parent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                yield pa.RecordBatch.from_arrays([*x.columns, _list(_pass(_rows(x.column(x.schema.get_field_index("b"))), table))], [*x.schema.names, "m"])

    return df.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in df.dtypes) + ", m array<double>")


def _down(df: DataFrame, table: np.ndarray) -> DataFrame:
    """Replaces ``t`` (total belief of the parent), ``b`` and ``m`` by the total belief ``t`` of the child."""
    keep = [c for c in df.columns if c not in ("t", "b", "m")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                t, b, m = (_rows(x.column(x.schema.get_field_index(c))) for c in ("t", "b", "m"))
                yield pa.RecordBatch.from_arrays([*[x.column(x.schema.get_field_index(c)) for c in keep], _list(b + _pass(t - m, table.T))], [*keep, "t"])

    kinds = dict(df.dtypes)
    return df.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", t array<double>")


def _depth(col):
    return F.when(col == "", 0).otherwise(F.size(F.split(col, "/")))


def _totals(levels: DataFrame) -> DataFrame:
    """(project_id, dir, t): the total belief of each directory, from beliefs ``b`` and messages ``m`` of itself and
    those above it, each at its ``level``; that of an absolute path has an empty name at two levels. A directory meets them all in one join, as many rows as it is deep; those above, however
    many lie below them, are sent out in ``SALT`` parts."""
    names = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), _depth(F.col("dir"))), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(names, F.lit(1), k), "/").alias("a")))
    chain = levels.filter(F.col("level") == _depth(F.col("dir"))).select("project_id", "dir", F.pmod(F.xxhash64("dir"), F.lit(SALT)).cast("int").alias("_s"), F.explode(above).alias("x")).select("project_id", "dir", "_s", F.col("x.k").alias("level"), "x.a")
    shared = levels.select("project_id", "level", F.col("dir").alias("a"), "b", "m", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_s"))
    met = chain.join(shared, ["project_id", "level", "a", "_s"]).groupBy("project_id", "dir").agg(F.array_sort(F.collect_list(F.struct("level", "b", "m"))).alias("c"))
    root = np.log(ROOT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                c = x.column(2)
                flat, n = c.flatten(), np.diff(c.offsets.to_numpy())
                b, m, at = _rows(flat.field("b")), _rows(flat.field("m")), np.cumsum(n) - n
                t = b[at] + root
                for k in range(1, int(n.max())):
                    i = np.flatnonzero(n > k)
                    t[i] = b[at[i] + k] + _pass(t[i] - m[at[i] + k], DIRECTORY.T)
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), _list(t)], ["project_id", "dir", "t"])

    return met.mapInArrow(run, "project_id string, dir string, t array<double>")


def _parent(col):
    return F.when(F.instr(col, "/") > 0, F.regexp_replace(col, r"/[^/]*$", "")).otherwise(F.lit(""))


def labels(files: DataFrame) -> DataFrame:
    """(project_id, path, label, confidence): what each file most likely is.

    Files and directories are the variables of one tree for each project. Evidence goes up level by level,
    summed for each directory before it is sent on, and comes down along each path, so that parents and siblings
    count; on trees this is exact. Of repeated rows of a file the latest content counts; null contents count as
    empty; null keys give no rows.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                e = np.stack([evidence(p, t) for p, t in zip(x.column(1).to_pylist(), x.column(2).to_pylist())])
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), x.column(3), _list(e)], ["project_id", "path", "at", "b"])

    src = files.filter("project_id is not null and path is not null").select("project_id", "path", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("updated_at", F.lit(0)).cast("long").alias("at"))
    seen = spread(src).mapInArrow(look, "project_id string, path string, at long, b array<double>")
    leaf = seen.groupBy("project_id", "path").agg(F.max(F.struct("at", "b")).alias("x")).select("project_id", "path", F.col("x.b").alias("b"))
    leaf = written(_up(leaf, FILE).withColumn("dir", _parent(F.col("path"))), "files")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                e = np.stack([directory_evidence(d.split("/")) for d in x.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), _list(_rows(x.column(2)) + e)], ["project_id", "dir", "b"])

    from_files = written(leaf.groupBy("project_id", "dir").agg(_sum("m", "s")).withColumn("depth", _depth(F.col("dir"))), "directories")
    deepest = from_files.agg(F.max("depth")).first()[0]
    if deepest is None:
        return files.sparkSession.createDataFrame([], "project_id string, path string, label string, confidence double")
    levels, above = {}, None
    for d in range(deepest, -1, -1):
        here = from_files.filter(F.col("depth") == d).select("project_id", "dir", "s")
        if above is not None:
            here = here.unionByName(above.select("project_id", _parent(F.col("dir")).alias("dir"), F.col("m").alias("s")))
        belief = here.groupBy("project_id", "dir").agg(_sum("s", "b")).mapInArrow(name, "project_id string, dir string, b array<double>")
        above = levels[d] = written(_up(belief, DIRECTORY), f"up-{d}")
    every = None
    for d, level in levels.items():
        level = level.select("project_id", F.lit(d).alias("level"), "dir", "b", "m")
        every = level if every is None else every.unionByName(level)
    every = _totals(every)
    # a directory may hold a third of all files: its belief goes to every part of them
    shared = every.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    parts = leaf.withColumn("_s", F.pmod(F.xxhash64("path"), F.lit(SALT)).cast("int"))
    out = _down(parts.join(shared, ["project_id", "dir", "_s"]).select("project_id", "path", "b", "m", "t"), FILE)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                t = _rows(x.column(2))
                p = np.exp(t - t.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                k = p.argmax(1)
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array([LABELS[i] for i in k]), pa.array(p[np.arange(len(k)), k])], ["project_id", "path", "label", "confidence"])

    return out.select("project_id", "path", "t").mapInArrow(decide, "project_id string, path string, label string, confidence double")


def not_handwritten(files: DataFrame) -> DataFrame:
    """(project_id, path) of the files, md excluded, that are not handwritten in their project."""
    code = files.filter(~F.lower("path").endswith(".md"))
    return labels(code).filter("label <> 'handwritten'").select("project_id", "path")
