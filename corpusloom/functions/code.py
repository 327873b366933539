"""Columns about source files: languages, imports, calls, scores and lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of import statements.
JS_PATH = r"""(?:import|from|require)\s*\(?\s*['"]([^'"]+)['"]"""
JS_NAMED = r"import\s*\{([^}]+)\}"
GO_SINGLE = r"""import\s+(?:[a-zA-Z0-9_.]+\s+)?["']([^"']+)["']"""
GO_BLOCK = r"import\s+\(([\s\S]*?)\)"
GO_INNER = r"""["']([^"']+)["']"""
PHP_REQUIRE = r"""(?:require|require_once|include|include_once)\s*\(?\s*['"]([^'"]+)['"]"""
USE = r"use\s+([^;]+);"
CALL = r"([A-Za-z_$][A-Za-z0-9_$]*)\s*\("

# Indexable extensions and their size limits in bytes.
INDEXABLE = ("go", "rs", "js", "ts", "tsx", "php", "py", "md", "pdf")
MOST_BYTES, MOST_PDF_BYTES = 1_000_000, 10_000_000

# Words before a bracket that are no calls.
NO_CALLS = ("if", "for", "while", "switch", "catch", "return", "func", "function", "fn", "def", "match", "foreach", "elif", "and", "or", "not", "in", "print", "array", "isset", "empty", "list", "import", "from", "use", "class", "struct", "impl", "pub", "await", "async", "new", "else")

# Names by extension.
LANGUAGES = {"go": "Go", "js": "JavaScript", "jsx": "JavaScript", "ts": "TypeScript", "tsx": "TSX", "php": "PHP", "rs": "Rust", "py": "Python"}
LANGUAGE_IDS = {"go": "go", "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python"}
SERVERS = {"go": "gopls", "js": "typescript-language-server --stdio", "jsx": "typescript-language-server --stdio", "ts": "typescript-language-server --stdio", "tsx": "typescript-language-server --stdio", "rs": "rust-analyzer", "py": "pylsp"}
DOC_STYLES = {"go": "Godoc comments", "ts": "JSDoc comments", "tsx": "JSDoc comments", "js": "JSDoc comments", "jsx": "JSDoc comments", "py": "Python docstrings (PEP 257 format)", "rs": "Rust doc comments (/// style)"}
DOC_STYLE_ELSE = "professional documentation comment"


def lookup(key: Column, values: dict[str, str], otherwise: str | None = None) -> Column:
    """The value of a small dictionary, as one CASE."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(otherwise) if otherwise is not None else out


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def parent(path: Column) -> Column:
    """Directory of a path; empty at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_indexable(ext: Column, size: Column) -> Column:
    """A known extension within its size limit; null sizes are not indexable."""
    return F.coalesce(ext.isin(*INDEXABLE) & (size <= F.when(ext == "pdf", MOST_PDF_BYTES).otherwise(MOST_BYTES)), F.lit(False))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _names(lists: Column) -> Column:
    """Names of comma lists: each up to " as ", trimmed, the empty ones dropped."""
    return F.filter(F.flatten(F.transform(lists, lambda s: F.transform(F.split(s, ","), lambda p: F.trim(F.element_at(F.split(p, " as "), 1))))), lambda p: p != "")


def imports_js(text: Column) -> Column:
    return F.concat(_all(text, JS_PATH), _names(_all(text, JS_NAMED)))


def imports_go(text: Column) -> Column:
    return F.concat(_all(text, GO_SINGLE), F.flatten(F.transform(_all(text, GO_BLOCK), lambda b: F.regexp_extract_all(b, F.lit(GO_INNER), F.lit(1)))))


def imports_php(text: Column) -> Column:
    return F.concat(_all(text, PHP_REQUIRE), _names(_all(text, USE)))


def imports_rust(text: Column) -> Column:
    return F.transform(_all(text, USE), lambda u: F.trim(u))


def imports(text: Column, ext: Column) -> Column:
    """Imports of a file by its extension, each once in order; other languages have none."""
    none = F.array().cast("array<string>")
    return F.array_distinct(
        F.when(ext.isin("ts", "tsx", "js", "jsx"), imports_js(text)).when(ext == "go", imports_go(text)).when(ext == "php", imports_php(text)).when(ext == "rs", imports_rust(text)).otherwise(none)
    )


def call_names(text: Column) -> Column:
    """Names before an opening bracket, sorted, each once, statements' words apart."""
    return F.array_sort(F.array_distinct(F.filter(_all(text, CALL), lambda n: ~n.isin(*NO_CALLS))))


def importance(start: Column, end: Column, calls: Column) -> Column:
    """1.0; less 0.3 below 3 lines, plus 0.2 above 10; plus 0.1 for each call. Impossible lines count as none."""
    lines = F.when((start >= 1) & (end >= start), end - start + 1).otherwise(0)
    return F.round(F.lit(1.0) - F.when(lines < 3, 0.3).otherwise(0.0) + F.when(lines > 10, 0.2).otherwise(0.0) + F.coalesce(F.size(calls), F.lit(0)) * 0.1, 4)


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def risk(references: Column) -> Column:
    return F.when(references <= 3, "Low").when(references <= 10, "Medium").otherwise("High")


def severity(level: Column) -> Column:
    return F.when(level == 1, "Error").when(level == 2, "Warning").when(level == 3, "Info").otherwise("Hint")


def package_of(path: Column) -> Column:
    """First part of a path, or the first two below apps and packages; null at the top level."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) < 2, None).when((F.size(parts) > 2) & parts[0].isin("apps", "packages"), F.concat_ws("/", parts[0], parts[1])).otherwise(parts[0])


def patch_first(text: Column, search: Column, new: Column) -> Column:
    """The text with the first occurrence of ``search`` replaced; unchanged without one or if it is empty."""
    at = F.instr(text, search)
    return F.when((at > 0) & (F.length(search) > 0), F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(search), F.length(text)))).otherwise(text)


def path_allowed(path: Column, deepest: int = 20) -> Column:
    """Lexical guard: a relative path of at most ``deepest`` parts that never climbs above its base."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    climb = F.aggregate(parts, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda a, p: F.struct((a["d"] + F.when(p == "..", -1).otherwise(1)).alias("d"), F.least(a["low"], a["d"] + F.when(p == "..", -1).otherwise(1)).alias("low")))
    return F.coalesce((~F.startswith(path, F.lit("/"))) & (F.size(parts) <= deepest) & (climb["low"] >= 0), F.lit(False))
