"""Source files that do not parse (problem 5): lexers, and recognition by every dialect of the language."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from . import grammars
from .gll import Grammar

#: Extension: language.
LANGUAGES = {"py": "python", "go": "go", "rs": "rust", "ts": "typescript", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "php": "php"}
#: Grammar, the start rules of its dialects, and the rules whose shapes are worth remembering.
_SPEC = {
    "python": (grammars.PYTHON, ("File",), ("Simple", "Test")),
    "go": (grammars.GO, ("File",), ("Stmt", "Func", "Expr")),
    "rust": (grammars.RUST, ("File",), ("Stmt", "Expr", "Type")),
    "typescript": (grammars.TYPESCRIPT, ("Script", "Module"), ("Stmt", "Element", "Assign", "Params")),
    "javascript": (grammars.JAVASCRIPT, ("Script", "Module"), ("Stmt", "Element", "Assign", "Params")),
    "php": (grammars.PHP, ("File",), ("Stmt", "Member", "Expr")),
}
_built: dict[str, Grammar] = {}


def grammar(language: str) -> Grammar:
    if language not in _built:
        _built[language] = Grammar(*_SPEC[language])
    return _built[language]


class LexError(ValueError):
    pass


_C_SPACE = r"(?:[ \t\r\n\f\v\xa0\ufeff\u2028\u2029]+|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)+"

# -- Go --

_GO = re.compile(
    r"(?P<s>[ \t\r]+|//[^\n]*)|(?P<n>\n)|(?P<c>/\*(?:[^*]|\*(?!/))*\*/)|(?P<w>[^\W\d]\w*)"
    r"|(?P<d>0[xX][0-9a-fA-F_.]+(?:[pP][+-]?\d+)?i?|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?i?|0[bBoO][\d_]+)"
    r"|(?P<q>\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\[^\n][^'\n]*)')"
    r"|(?P<o><<=|>>=|&\^=|\.\.\.|[-+*/%&|^]=|==|!=|<=|>=|:=|<-|\+\+|--|&&|\|\||<<|>>|&\^|[-+*/%&|^<>=!()\[\]{},;.:~])"
)
_GO_END = {"NAME", "NUM", "STR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}


def lex_go(text: str, g: Grammar) -> list[int]:
    kinds, out, last = g.kinds, [], ""
    i, n, match = 0, len(text), _GO.match
    semi = kinds[";"]
    while i < n:
        m = match(text, i)
        if m is None:
            raise LexError(i)
        k = m.lastgroup
        i = m.end()
        if k == "s":
            continue
        v = m.group()
        if k == "n" or k == "c":
            if (k == "n" or "\n" in v) and last in _GO_END:
                out.append(semi)
                last = ";"
            continue
        if k == "w":
            last = v if v in kinds and v != "NAME" else "NAME"
        elif k == "d":
            last = "NUM"
        elif k == "q":
            last = "STR"
        else:
            last = v if v in kinds else ("ASSIGN" if v[-1] == "=" and v not in ("==", "!=", "<=", ">=") else "OP")
        out.append(kinds[last])
    if last in _GO_END:
        out.append(semi)
    return out


# -- Rust --

_RUST = re.compile(
    r"(?P<s>[ \t\r\n\f\v\u200e\u200f\x85\u2028\u2029]+|//[^\n]*)|(?P<c>/\*)|(?P<r>(?:br|cr|r)(?P<h>#*)\"(?:.|\n)*?\"(?P=h))|(?P<q>[bc]?\"(?:[^\"\\]|\\(?:.|\n))*\")"
    r"|(?P<x>b?'(?:[^'\\\n]|\\(?:u\{[0-9a-fA-F_]+\}|x[0-9a-fA-F]{2}|.))')|(?P<l>'[^\W\d]\w*)|(?P<w>r#[^\W\d]\w*|[^\W\d]\w*)"
    r"|(?P<d>0[xob][0-9a-fA-F_]+(?:[iu](?:8|16|32|64|128|size))?|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?(?:[iuf](?:8|16|32|64|128|size))?(?:\.(?![.\w]))?)"
    r"|(?P<o><<=|\.\.=|\.\.\.|[-+*/%^&|]=|==|!=|<=|&&|\|\||<<|->|=>|::|\.\.|[-+*/%^!&|<>=@.,;:#$?~()\[\]{}])"
)


def lex_rust(text: str, g: Grammar) -> list[int]:
    kinds, out = g.kinds, []
    i, n, match = 0, len(text), _RUST.match
    if text.startswith("#!") and not re.match(r"#!\s*\[", text):
        i = text.find("\n") if "\n" in text else n
    while i < n:
        m = match(text, i)
        if m is None:
            raise LexError(i)
        k = m.lastgroup
        i = m.end()
        if k == "s":
            continue
        if k == "c":
            depth = 1
            while depth:
                m = re.compile(r"/\*|\*/").search(text, i)
                if not m:
                    raise LexError(i)
                depth += 1 if m.group() == "/*" else -1
                i = m.end()
            continue
        v = m.group()
        if k == "w":
            out.append(kinds.get(v, kinds["NAME"]) if v != "NAME" else kinds["NAME"])
        elif k == "o":
            t = kinds.get(v)
            out.append(t if t is not None else kinds["ASSIGN" if v[-1] == "=" and v not in ("==", "!=", "<=") else "OP"])
        else:
            out.append(kinds[{"r": "STR", "h": "STR", "q": "STR", "x": "CHAR", "l": "LIFETIME", "d": "NUM"}[k]])
    return out


# -- JavaScript and TypeScript --

_WORDS_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "instanceof", "new", "throw", "do", "else", "yield", "await", "extends", "default"}
_SCRIPT = re.compile(
    rf"(?P<s>{_C_SPACE})|(?P<w>(?:[^\W\d]|[$]|\\u\{{?[0-9a-fA-F]+\}}?)(?:\w|[$\u200c\u200d]|\\u\{{?[0-9a-fA-F]+\}}?)*)"
    r"|(?P<d>0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)"
    r"|(?P<q>\"(?:[^\"\\\n]|\\(?:\r\n|.|\n))*\"|'(?:[^'\\\n]|\\(?:\r\n|.|\n))*')|(?P<p>\#[^\W\d]\w*)|(?P<b>`)"
    r"|(?P<o>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|==|!=|<=|>=|=>|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|\*\*|<<|>>|[-+*/%&|^]=|[-+*/%&|^<>=!~?:.,;@(){}\[\]])"
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-zA-Z]*")
_TPL = re.compile(r"(?:[^`\\$]|\\(?:.|\n)|\$(?!\{))*(`|\$\{)")


def lex_script(text: str, g: Grammar) -> list[int]:
    kinds, out, shift = g.kinds, [], g.plain
    split = "as" in kinds and "keyof" in kinds  # types: closing angles come one by one
    i, n, match = 0, len(text), _SCRIPT.match
    line, regex, braces = True, True, []
    if text.startswith("#!"):
        i = text.find("\n") if "\n" in text else n
    while i < n:
        m = match(text, i)
        if m is None:
            raise LexError(i)
        k = m.lastgroup
        v = m.group()
        if k == "s":
            i = m.end()
            if not line and ("\n" in v or "\u2028" in v):
                line = True
            continue
        if k == "o":
            if v[0] == "/" and regex:
                r = _REGEX.match(text, i)
                if not r:
                    raise LexError(i)
                i = r.end()
                t, regex = "REGEX", False
            elif v == "}" and braces and braces[-1] == "`":
                r = _TPL.match(text, i + 1)
                if not r:
                    raise LexError(i)
                i = r.end()
                if r.group(1) == "`":
                    braces.pop()
                    t, regex = "TPLTAIL", False
                else:
                    t, regex = "TPLMID", True
            else:
                if v[0] == ">" and split:
                    v = ">"
                i += len(v)
                if v == "{":
                    braces.append("{")
                elif v == "}" and braces:
                    braces.pop()
                t = v if v in kinds else ("ASSIGN" if v[-1] == "=" and v not in ("==", "!=", "===", "!==", "<=", ">=") else "OP")
                regex = v not in (")", "]", "++", "--")
        elif k == "b":
            r = _TPL.match(text, i + 1)
            if not r:
                raise LexError(i)
            i = r.end()
            if r.group(1) == "`":
                t, regex = "TPL", False
            else:
                braces.append("`")
                t, regex = "TPLHEAD", True
        else:
            i = m.end()
            if k == "w":
                t = v if v in kinds and not v.isupper() and v not in ("ObjType", "TypeRef") else "NAME"
                regex = v in _WORDS_BEFORE_REGEX
            else:
                t = {"d": "NUM", "q": "STR", "p": "PRIVATE"}[k]
                regex = False
        out.append(kinds[t] + (shift if line else 0))
        line = False
    return out


# -- PHP --

_PHP = re.compile(
    r"(?P<s>(?:[ \t\r\n\f\v]+|/\*(?:[^*]|\*(?!/))*\*/|(?://|\#(?!\[))(?:[^\n?]|\?(?!>))*)+)|(?P<e>\?>\n?)|(?P<v>\$[a-zA-Z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)"
    r"|(?P<h><<<[ \t]*(?P<y>[\"']?)(?P<t>[A-Za-z_]\w*)(?P=y)\r?\n(?:(?:.|\n)*?\n)??[ \t]*(?P=t)\b)"
    r"|(?P<w>[a-zA-Z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)|(?P<d>0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)"
    r"|(?P<q>[bB]?\"(?:[^\"\\]|\\(?:.|\n))*\"|[bB]?'(?:[^'\\]|\\(?:.|\n))*')|(?P<b>`(?:[^`\\]|\\(?:.|\n))*`)|(?P<c>\(\s*(?:int|integer|float|double|string|bool|boolean|array|object|unset|binary)\s*\))"
    r"|(?P<o>\#\[|\*\*=|\.\.\.|<=>|===|!==|<<=|>>=|\?\?=|\?->|->|::|=>|\+\+|--|==|!=|<>|<=|>=|&&|\|\||\?\?|\*\*|<<|>>|[-+*/.%&|^]=|[-+*/%=<>!.,;:?&|^~@$(){}\[\]\\])",
    re.I,
)
_PHP_SAME = {"include_once": "include", "require_once": "require", "die": "exit", "__halt_compiler": "HALT"}


def lex_php(text: str, g: Grammar) -> list[int]:
    kinds, out = g.kinds, []
    i, n, match = 0, len(text), _PHP.match

    def html(i: int) -> int:
        o = re.compile(r"<\?(?:php(?=\s|$)|=)", re.I).search(text, i)
        a = o.start() if o else n
        if a > i:
            out.append(kinds["HTML"])
        if not o:
            return n
        out.append(kinds["OPEN"])
        if o.group() == "<?=":
            out.append(kinds["echo"])
        return o.end()

    i = html(0)
    while i < n:
        m = match(text, i)
        if m is None:
            raise LexError(i)
        k = m.lastgroup
        i = m.end()
        if k == "s":
            continue
        v = m.group()
        if k == "w":
            w = _PHP_SAME.get(w := v.lower(), w)
            out.append(kinds[w] if w in kinds and w.isalpha() or w == "HALT" else kinds["NAME"])
            if w == "HALT":
                break
        elif k == "e":
            if i >= n:
                out.append(kinds["CLOSEEND"])
                break
            out.append(kinds["CLOSE"])
            i = html(i)
            if i >= n and out[-1] == kinds["HTML"]:
                out[-2:] = [kinds["CLOSEEND"]]
        elif k == "o":
            t = kinds.get(v)
            out.append(t if t is not None else kinds["ASSIGN" if v[-1] == "=" and v not in ("==", "!=", "===", "!==", "<=", ">=") else "OP"])
        else:
            out.append(kinds[{"v": "VAR", "h": "STR", "y": "STR", "t": "STR", "d": "NUM", "q": "STR", "b": "BACKTICK", "c": "CAST"}[k]])
    return out


# -- Python --

_PY = re.compile(
    r"(?P<s>[ \t\f]+|\#[^\n]*|\\\n)|(?P<n>\n)|(?P<q>(?:[rRbBuUfFtT]{0,2})(?:\"\"\"(?:[^\\]|\\(?:.|\n))*?\"\"\"|'''(?:[^\\]|\\(?:.|\n))*?'''|\"(?:[^\"\\\n]|\\(?:.|\n))*\"|'(?:[^'\\\n]|\\(?:.|\n))*'))"
    r"|(?P<d>0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)|(?P<w>[^\W\d]\w*)"
    r"|(?P<o>\*\*=|//=|<<=|>>=|\.\.\.|[-+*/%&|^@]=|==|!=|<=|>=|:=|->|\*\*|//|<<|>>|[-+*/%&|^~<>=@.,;:()\[\]{}])"
)
_PY_OPEN, _PY_CLOSE = set("([{"), set(")]}")


def lex_python(text: str, g: Grammar) -> list[int]:
    kinds, out = g.kinds, []
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    i, n, match = 0, len(text), _PY.match
    indents, depth, fresh = [0], 0, True
    newline, indent, dedent = kinds["NEWLINE"], kinds["INDENT"], kinds["DEDENT"]
    while i < n:
        if fresh and not depth:
            m = re.compile(r"[ \t\f]*").match(text, i)
            i = m.end()
            if i >= n:
                break
            if text[i] in "#\n":
                e = text.find("\n", i)
                i = n if e < 0 else e + 1
                continue
            width = 0
            for c in m.group():
                width = (width // 8 + 1) * 8 if c == "\t" else 0 if c == "\f" else width + 1
            if width > indents[-1]:
                indents.append(width)
                out.append(indent)
            while width < indents[-1]:
                indents.pop()
                out.append(dedent)
            if width != indents[-1]:
                raise LexError(i)
            fresh = False
        m = match(text, i)
        if m is None:
            raise LexError(i)
        k = m.lastgroup
        i = m.end()
        if k == "s":
            continue
        if k == "n":
            if not depth:
                out.append(newline)
                fresh = True
            continue
        v = m.group()
        if k == "w":
            out.append(kinds[v] if v in kinds and v not in ("NAME", "NUM", "STR", "OP", "AUG", "NEWLINE", "INDENT", "DEDENT") else kinds["NAME"])
        elif k == "d":
            if i < n and (text[i].isalnum() or text[i] == "_"):
                w = re.compile(r"\w+").match(text, i).group()
                if w not in ("and", "or", "if", "in", "is", "else", "for", "not"):
                    raise LexError(i)
            out.append(kinds["NUM"])
        elif k == "q":
            out.append(kinds["STR"])
        else:
            if v in _PY_OPEN:
                depth += 1
            elif v in _PY_CLOSE:
                depth = max(0, depth - 1)
            t = kinds.get(v)
            out.append(t if t is not None else kinds["AUG" if v[-1] == "=" and v not in ("==", "!=", "<=", ">=") else "OP"])
    if depth:
        raise LexError(n)
    if not fresh:
        out.append(newline)
    out += [dedent] * (len(indents) - 1)
    return out


_LEX = {"go": lex_go, "rust": lex_rust, "typescript": lex_script, "javascript": lex_script, "php": lex_php, "python": lex_python}


def is_valid(text: str, language: str) -> bool:
    """Whether some dialect of the language accepts a text; a byte order mark and Windows line ends are no matter."""
    t = text.lstrip("\ufeff")
    g = grammar(language)
    try:
        tokens = _LEX[language](t, g)
    except LexError:
        ok = False
    else:
        ok = g.recognise(tokens) < 0
    if not ok and language == "python":  # an exact check of what was rejected
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(t)
            return True
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
    return ok


def checked(files: DataFrame) -> DataFrame:
    """(project_id, path, language, valid): each file of a known language once; the latest content counts.

    A null content counts as empty. Files of other extensions, and null keys, give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, ok = [], []
            for path, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                langs.append(LANGUAGES[path.rpartition(".")[2].lower()])
                ok.append(is_valid(text, langs[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(langs, pa.string()), pa.array(ok, pa.bool_())], ["project_id", "path", "at", "language", "valid"])

    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    src = files.filter(F.col("project_id").isNotNull() & ext.isin(*LANGUAGES)).select("project_id", "path", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("updated_at", F.lit(0)).cast("long").alias("at"))
    seen = spread(src).mapInArrow(run, "project_id string, path string, at long, language string, valid boolean")
    return seen.groupBy("project_id", "path").agg(F.max(F.struct("at", "language", "valid")).alias("m")).select("project_id", "path", "m.language", "m.valid")


def invalid(files: DataFrame) -> DataFrame:
    """(project_id, path) of the files that every dialect rejects."""
    return checked(files).filter(~F.col("valid")).select("project_id", "path")


def rates(files: DataFrame) -> DataFrame:
    """(project_id, language, files, invalid, rate)."""
    bad = F.sum(F.when(F.col("valid"), 0).otherwise(1))
    return checked(files).groupBy("project_id", "language").agg(F.count(F.lit(1)).alias("files"), bad.alias("invalid"), (bad / F.count(F.lit(1))).alias("rate"))
