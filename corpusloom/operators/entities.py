"""Functions and types of source files by scanning: signatures at line starts, bodies by balanced braces.

An approximation of syntax trees for Go, Rust, TypeScript, JavaScript and PHP; Python is parsed
(``chunking.python_entities``).
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import spread

_SKIP = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\.)'|'(?:[^'\\\n]|\\.)*'|[{}]|\n", re.S)
_SKIP_RUST = re.compile(r"//[^\n]*|/\*.*?\*/|r(#*)\".*?\"\1|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\\n]|\\.)'|[{}]|\n", re.S)

#: Kind and signature by language; the name is the group.
SIGNATURES: dict[str, list[tuple[str, re.Pattern]]] = {
    "go": [
        ("method_declaration", re.compile(r"^func\s*\([^)\n]*\)\s*(\w+)", re.M)),
        ("function_declaration", re.compile(r"^func\s+(\w+)", re.M)),
        ("struct_type", re.compile(r"^type\s+(\w+)(?:\[[^\]\n]*\])?\s+struct\b", re.M)),
        ("interface_type", re.compile(r"^type\s+(\w+)(?:\[[^\]\n]*\])?\s+interface\b", re.M)),
    ],
    "rs": [
        ("function_item", re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+(\w+)", re.M)),
        ("struct_item", re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)", re.M)),
        ("impl_item", re.compile(r"^[ \t]*(?:unsafe\s+)?impl\b(?:<[^{\n]*?>)?\s*(?:[\w:<>', ]+\s+for\s+)?(\w+)", re.M)),
    ],
    "ts": [
        ("function_declaration", re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([\w$]+)", re.M)),
        ("class_declaration", re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([\w$]+)", re.M)),
        ("interface_declaration", re.compile(r"^[ \t]*(?:export\s+)?interface\s+([\w$]+)", re.M)),
        ("lexical_declaration", re.compile(r"^(?:export\s+)?(?:const|let)\s+([\w$]+)[^=\n]*=\s*(?:async\s*)?(?:\([^)\n]*\)|[\w$]+)[^=\n]*=>", re.M)),
        ("method_definition", re.compile(r"^[ \t]+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)([\w$#]+)\s*(?:<[^>\n]*>)?\([^)\n]*\)[^;{\n]*\{", re.M)),
    ],
    "php": [
        ("class_declaration", re.compile(r"^[ \t]*(?:(?:abstract|final|readonly)\s+)*class\s+(\w+)", re.M | re.I)),
        ("method_declaration", re.compile(r"^[ \t]+(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?\s*(\w+)", re.M | re.I)),
        ("function_declaration", re.compile(r"^function\s+&?\s*(\w+)", re.M | re.I)),
    ],
}
SIGNATURES["js"] = SIGNATURES["jsx"] = SIGNATURES["tsx"] = SIGNATURES["ts"]


def scan(text: str, ext: str) -> list[tuple[str, str, int, int]]:
    """(kind, name, start_line, end_line) of the entities of a text, in order of place; lines count from 1.

    An entity ends with the brace that closes the first one after its signature, or with its line if a
    semicolon or none comes first.
    """
    rules = SIGNATURES.get(ext)
    if not rules or not text:
        return []
    text = text.lstrip("\ufeff").replace("\r\n", "\n")
    opens, close, depth, feeds, hidden = [], {}, [], [0], []
    for m in (_SKIP_RUST if ext == "rs" else _SKIP).finditer(text):
        c = m.group()
        if c == "{":
            depth.append(m.start())
            opens.append(m.start())
        elif c == "}":
            if depth:
                close[depth.pop()] = m.start()
        elif c == "\n":
            feeds.append(m.end())
        else:
            hidden.append((m.start(), m.end()))
            k = c.find("\n")
            while k >= 0:
                feeds.append(m.start() + k + 1)
                k = c.find("\n", k + 1)
    starts = [a for a, _ in hidden]
    out = []
    for kind, pattern in rules:
        for m in pattern.finditer(text):
            k = bisect_right(starts, m.start(1)) - 1
            if k >= 0 and hidden[k][1] > m.start(1):
                continue  # within a comment or string
            o = bisect_left(opens, m.end() - 1)
            stop = text.find(";", m.end())
            if o < len(opens) and (stop < 0 or opens[o] < stop):
                end = close.get(opens[o], len(text) - 1)
            else:
                end = stop if stop >= 0 else m.end()
            at = m.start() + len(m.group()) - len(m.group().lstrip())
            out.append((kind, m.group(1), bisect_right(feeds, at), bisect_right(feeds, end)))
    return sorted(out, key=lambda e: (e[2], -e[3]))


def entities(files: DataFrame) -> DataFrame:
    """(project_id, path, kind, name, start_line, end_line) of all files of the languages scanned; null contents give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for project, path, text in zip(*(c.to_pylist() for c in b.columns)):
                for e in scan(text, path.rpartition(".")[2]):
                    for col, v in zip(out, (project, path, *e)):
                        col.append(v)
            s, i = pa.string(), pa.int32()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (s, s, s, s, i, i))], ["project_id", "path", "kind", "name", "start_line", "end_line"])

    src = files.filter("path is not null and content is not null").select("project_id", "path", "content")
    return spread(src).mapInArrow(run, "project_id string, path string, kind string, name string, start_line int, end_line int")
