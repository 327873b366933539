"""Functions paired with their documentation (problem 3), by island grammars.

For each language the grammar knows documentation, attributes, signatures and balanced bodies; all other
text is water and skipped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

# The node types of functions and methods.
FUNCTIONS = ("function_declaration", "function_item", "function_definition", "method_declaration", "method_definition", "lexical_declaration")
LEAST_WORDS = 4


@dataclass(frozen=True)
class Grammar:
    line: tuple[str, ...]
    block: tuple[tuple[str, str], ...]
    attribute: re.Pattern | None
    signature: re.Pattern
    docstring: bool = False
    raw: re.Pattern | None = None


_C_BLOCK = (("/*", "*/"),)
_SLASH = ("//",)
_JS = re.compile(
    r"(?:(?:export|default|declare|abstract|public|private|protected|static|readonly|override|async|get|set)\s+)*(?:"
    r"function\s*\*?\s*(?P<a>[\w$]+)|(?:const|let|var)\s+(?P<b>[\w$]+)|(?P<c>[\w$#]+)\s*(?:<[^<>()]*>)?\s*\()"
)
GRAMMARS = {
    "go": Grammar(_SLASH, _C_BLOCK, None, re.compile(r"func\s*(?:\([^()]*\)\s*)?(?P<a>\w+)\s*[\[(]")),
    "rs": Grammar(_SLASH, _C_BLOCK, re.compile(r"#!?\["), re.compile(r"(?:pub(?:\s*\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+(?P<a>\w+)")),
    "py": Grammar(("#",), (), re.compile(r"@"), re.compile(r"(?:async\s+)?def\s+(?P<a>\w+)"), docstring=True),
    "js": Grammar(_SLASH, _C_BLOCK, re.compile(r"@"), _JS),
    "ts": Grammar(_SLASH, _C_BLOCK, re.compile(r"@"), _JS),
    "php": Grammar(("//", "#"), _C_BLOCK, re.compile(r"#\["), re.compile(r"(?:(?:public|private|protected|static|final|abstract|readonly)\s+)*function\s*&?\s*(?P<a>\w+)")),
}
GRAMMARS["jsx"], GRAMMARS["tsx"] = GRAMMARS["js"], GRAMMARS["ts"]
_ANY = ("go", "rs", "py", "ts", "php")

_CLOSE = {"(": ")", "[": "]", "{": "}"}


def skip_string(text: str, at: int) -> int:
    """The place behind the string literal that begins at a place; an open one ends with its line or the text."""
    q = text[at : at + 3] if text[at : at + 3] in ('"""', "'''") else text[at]
    if q == "'" and re.match(r"'\w+(?!')", text[at:]) and not re.match(r"'[^'\n]*'", text[at : at + 200]):
        return at + 1  # a lifetime
    i = at + len(q)
    while i < len(text):
        if text[i] == "\\" and q != "`":
            i += 2
            continue
        if text.startswith(q, i):
            return i + len(q)
        if text[i] == "\n" and len(q) == 1 and q != "`":
            return i
        i += 1
    return len(text)


def balanced(text: str, at: int, g: Grammar) -> int:
    """The place behind the bracket that closes the one at a place, strings and comments aside."""
    stack = [_CLOSE[text[at]]]
    i = at + 1
    while i < len(text) and stack:
        c = text[i]
        if c in "\"'`":
            i = skip_string(text, i)
            continue
        m = _comment(text, i, g)
        if m:
            i = m
            continue
        if c in _CLOSE:
            stack.append(_CLOSE[c])
        elif c == stack[-1]:
            stack.pop()
        i += 1
    return i


def _comment(text: str, at: int, g: Grammar) -> int:
    if g.attribute is not None and g.attribute.match(text, at) and text[at] == "#":
        return 0
    for mark in g.line:
        if text.startswith(mark, at):
            e = text.find("\n", at)
            return len(text) if e < 0 else e
    for a, b in g.block:
        if text.startswith(a, at):
            e = text.find(b, at + len(a))
            return len(text) if e < 0 else e + len(b)
    return 0


@dataclass
class Island:
    name: str
    doc: str
    start: int
    body: int


def first_function(text: str, ext: str) -> Island | None:
    """The first function of a text, with the comment directly above it (attributes between allowed) and,
    in Python, the docstring of its body."""
    g = GRAMMARS[ext]
    i, n, doc, began = 0, len(text), [], None
    while i < n:
        m = re.compile(r"\s*").match(text, i)
        if m.end() > i:
            if m.group(0).count("\n") > 1:
                doc, began = [], None
            i = m.end()
            continue
        e = _comment(text, i, g)
        if e:
            began = i if began is None else began
            doc.append(text[i:e])
            i = e
            continue
        if g.attribute is not None and g.attribute.match(text, i):
            began = i if began is None else began
            o = re.compile(r"#!?\[|@[\w.]+\(?").match(text, i)
            i = balanced(text, o.end() - 1, g) if o and text[o.end() - 1] in _CLOSE else (o.end() if o else i + 1)
            continue
        s = g.signature.match(text, i)
        if s and not re.match(r"(?:if|for|while|switch|return|catch|else)\b", s.group(0)):
            name = next((v for v in s.groupdict().values() if v), "")
            body = s.end()
            if g.docstring:
                p = text.find("(", s.start())
                if p >= 0:
                    body = balanced(text, p, g)
                h = re.compile(r"[^:\n]*:[ \t]*(?:#[^\n]*)?\s*[rRuU]?(?=[\"'])").match(text, body)
                if h:
                    doc.append(text[h.end() : skip_string(text, h.end())])
            return Island(name, "\n".join(doc), i if began is None else began, body)
        e = text.find("\n", i)
        doc, began = [], None
        i = n if e < 0 else e
    return None


def function_code(text: str, ext: str) -> str:
    """The attributes, signature and balanced body of the first function, without its comment above; all if there is none."""
    f = first_function(text, ext)
    if f is None:
        return text
    g = GRAMMARS[ext]
    if g.docstring:
        return text[f.start :].rstrip()
    b = text.find("{", f.body)
    return text[f.start : balanced(text, b, g) if b >= 0 else len(text)]


_MARK = re.compile(r"^\s*(?:/\*+!?|\*+/|\*+(?!\w)|//+!?|#+(?!\[)|\"\"\"|''')?\s?|\s*(?:\*+/|\"\"\"|''')\s*$")
_PARAM = re.compile(r"\s*(?:[@\\:](?:param(?:eter)?|arg(?:ument)?|tparam|template|type|typeparam|prop(?:erty)?)\b|[@:]param\[)")
_SECTION = re.compile(r"\s*(?:#+\s*)?(?:args?|arguments?|param(?:eter)?s?|keyword arg(?:ument)?s|other parameters)\s*:?\s*$", re.I)
_HEAD = re.compile(r"\s*(?:#+\s*)?(?:returns?|yields?|raises?|throws?|examples?|notes?|see also|errors?|panics?|safety|warnings?)\s*:?\s*$", re.I)
# The marks of instructions to tools.
_TOOL = re.compile(
    r"\s*(?:@?(?:pylint|eslint|tslint|jshint|jscs|jslint|flake8|noqa|nolint|nosec|nosemgrep|mypy|pyright|pytype|isort|yapf|fmt|black|ruff|bandit|rustfmt|clippy|phpcs|phpstan|psalm|prettier|istanbul|c8|coverage|pragma|cspell|spell-?checker|codespell|sonar|noinspection|suppress|lint|swc|webpack\w*|vite|esbuild|biome|deno-lint|golangci|swagger|export_test)\b"
    r"|type:\s*ignore|@ts-|@codecoverageignore|@phan|@formatter:|@no\w+|go:\w|\+build|end-?region\b|#?region\b|-\*-|vim?:|editorconfig|spdx-|@flow|@jsx|@psalm|@phpstan|@suppress|(?:dis|en)able[- ]?(?:next-?line|line)?\b[^.]*$(?<!\.))",
    re.I,
)
_REMARK = re.compile(
    r"(?i)\s*(?:todo|fixme|tbd|xxx|hack|wip)\b.*"
    r"|.*\b(?:(?:missing|no|without|lacks?|needs?|add|write|fill in|insert)\b.{0,20}\b(?:docs?|documentation|docstrings?|descriptions?|comments?)|(?:docs?|documentation|docstring|description|comment)s?\b.{0,30}\b(?:to be|will (?:be|follow)|missing|pending|later|soon|needed|follows?|elsewhere|coming|absent|wanted|outstanding|lives?|found|moved)|undocumented|not (?:yet )?(?:been )?documented|(?:is |are )?(?:documented|described|explained) (?:elsewhere|in|at|on|by|above|below|there)|(?:to be|will be) (?:documented|described|written|added))\b.*"
    r"|\s*(?:please )?(?:see|refer to|cf\.?|compare|look at|consult|check|inherit(?:ed|s)?(?: from| docs)?|same as|as above|copied from|ditto)\b[^.]{0,80}\.?\s*"
)
_CODE_END = re.compile(r"(?:[;{}]|\)\s*(?:=>|:)|=>|\($|,$(?<=[)\]],))\s*$")
_CODE_IN = re.compile(r"(?::=|\+=|-=|=>|->|==|!=|&&|\|\||\w\s=\s\S|\$\w+)|^\s*(?:return|const|let|var|import|from|def|func|fn|pub|if|for|while|else|try|except|raise|throw|await|print|echo|self\.|this\.)\b.*[()\[\]{}=:;]|^\s*[\w.$>-]+\(.*\)\s*;?\s*$|^\s*(?:return|break|continue|pass)(?:\s+[\w.$]+)?\s*;?\s*$")
#: An assignment whose right side ends in a bracket, however many words it has.
_CODE_SET = re.compile(r"\s*(?:(?:let|const|var|mut|final|auto)\s+)*[\w.$\[\]\"']+(?:\s*,\s*[\w.$]+)*\s*(?::=|[-+*/|&.?]{0,2}=(?!=))\s*\S.*[\])};]\s*$")
_PIECE = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_A-Za-z]+")
_TOKEN = re.compile(r"\w+")


def _is_code(line: str) -> bool:
    bare = re.sub(r"`[^`]*`", "x", line)
    if _CODE_END.search(bare) and re.search(r"[(){}=;$]", bare):
        return True
    if _CODE_SET.match(bare):
        return True
    return bool(_CODE_IN.search(bare)) and not re.search(r"(?:\w+ ){5}", bare)


def description(doc: str | None) -> str:
    """What a documentation comment says: without marks, parameter descriptions, instructions to tools,
    remarks on missing documentation and disabled code."""
    if not doc:
        return ""
    out, skip, indent = [], False, 0
    for raw in doc.replace("\r\n", "\n").split("\n"):
        body = _MARK.sub("", raw)
        line = body.strip()
        depth = len(body) - len(body.lstrip())
        if skip and (not line or _HEAD.match(line) or (depth <= indent and not re.match(r"[*-]?\s*`?\$?[\w.*]+`?\s*(?:\([^)]*\))?\s*[:-]", line))):
            skip = False
        if _SECTION.match(line):
            skip, indent = True, depth
            continue
        if _PARAM.match(line):
            skip, indent = True, depth
            continue
        if skip and line.startswith("@"):
            skip = False
        if skip or _HEAD.match(line) or _TOOL.match(line) or _is_code(line) or not re.search(r"\w", line):
            continue
        if skip is False:
            out.append(line)
    text = " ".join(out)
    parts = [s for s in re.split(r"(?<=[.!?])\s+", text) if not _REMARK.fullmatch(s)]
    return " ".join(parts)


def is_telling(text: str, names: tuple[str | None, ...], least: int = LEAST_WORDS) -> bool:
    """Whether at least ``least`` words of a description remain without those of the function's names."""
    own = {p.lower() for n in names if n for p in _PIECE.findall(n)} | {n.lower() for n in names if n}
    left = 0
    for t in _TOKEN.findall(text):
        parts = [p.lower() for p in _PIECE.findall(t)]
        if any(p.isalpha() for p in parts) and t.lower() not in own and not all(p in own for p in parts):
            left += 1
            if left >= least:
                return True
    return False


def _islands(chunks: DataFrame, code: bool) -> DataFrame:
    """(id, found, doc[, code]): name and documentation of the first function of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, docs, codes = [], [], []
            for path, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                ext = (path or "").rpartition(".")[2].lower()
                text = text.replace("\r\n", "\n").lstrip("\ufeff")
                f = None
                for e in (ext,) if ext in GRAMMARS else _ANY:
                    f = first_function(text, e)
                    if f:
                        ext = e
                        break
                names.append(f.name if f else None)
                docs.append(f.doc if f else None)
                if code:
                    codes.append(function_code(text, ext) if ext in GRAMMARS else text)
            s = pa.string()
            cols = [b.column(0), pa.array(names, s), pa.array(docs, s)] + ([pa.array(codes, s)] if code else [])
            yield pa.RecordBatch.from_arrays(cols, ["id", "found", "doc"] + ["code"] * code)

    rows = chunks.select("id", "path", F.coalesce("content", F.lit("")).alias("content")).filter("id is not null")
    return spread(rows).mapInArrow(run, "id string, found string, doc string" + ", code string" * code)


def pairs(nodes: DataFrame, chunks: DataFrame, least: int = LEAST_WORDS, code: bool = True) -> DataFrame:
    """(id, name, description[, code]): functions with telling documentation, from the docstring of the node
    or, failing that, from its chunk. Ids without a chunk, other node types, and functions whose
    documentation is missing or trivial give no rows; an id gives one row however often it recurs.
    """
    fn = nodes.filter(F.col("node_type").isin(*FUNCTIONS) & F.col("id").isNotNull()).select("id", "name", "docstring").distinct()
    both = fn.join(_islands(chunks, code).distinct() if not code else _islands(chunks, code), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, names, said = [], [], []
            for k, (name, docstring, found, doc) in enumerate(zip(*(b.column(c).to_pylist() for c in (1, 2, 3, 4)))):
                for d in (docstring, doc):
                    text = description(d)
                    if is_telling(text, (name, found), least):
                        keep.append(k)
                        names.append((name or "").strip() or found)
                        said.append(text)
                        break
            at = pa.array(keep, pa.int64())
            cols = [b.column(0).take(at), pa.array(names, pa.string()), pa.array(said, pa.string())] + ([b.column(5).take(at)] if code else [])
            yield pa.RecordBatch.from_arrays(cols, ["id", "name", "description"] + ["code"] * code)

    schema = "id string, name string, description string" + ", code string" * code
    found = both.select("id", "name", "docstring", "found", "doc", *["code"] * code).mapInArrow(run, schema)
    rest = ["name", "description"] + ["code"] * code
    return found.groupBy("id").agg(F.max(F.struct(*rest)).alias("m")).select("id", *[F.col(f"m.{c}") for c in rest])


def documented(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ids of the functions that ``pairs`` keeps."""
    return pairs(nodes, chunks, code=False).select("id")
