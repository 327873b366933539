"""Window chunks, line numbers, containment and Python entities."""

from __future__ import annotations

import ast
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.code import newlines

WINDOW, OVERLAP = 3000, 500


def windows(docs: DataFrame, key: list[str], text: str, size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_index, start_line, end_line, chunk): windows of ``size`` characters, each sharing
    ``overlap`` with the next; none of null or empty texts. Lines count line feeds before the window's start
    and end, plus one."""
    step = size - overlap
    n = F.length(text)
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step)).cast("int")
    rows = docs.filter(n > 0).withColumn("chunk_index", F.explode(F.sequence(F.lit(0), last)))
    at = F.col("chunk_index") * step
    start = newlines(F.substring(text, F.lit(1), at)) + 1
    end = newlines(F.substring(text, F.lit(1), at + size)) + 1
    return rows.select(*key, "chunk_index", start.alias("start_line"), end.alias("end_line"), F.substring(text, at + 1, F.lit(size)).alias("chunk"))


def drop_contained(chunks: DataFrame, key: list[str]) -> DataFrame:
    """Chunks that no other of the same key contains within a strictly longer line range.

    A chunk is contained exactly if an earlier start, or an equal one with a later end, reaches its end:
    a running maximum over the sorted ranges finds that in one pass, without pairs.
    """
    by_start = chunks.groupBy(*key, "start_line").agg(F.max("end_line").alias("_far"))
    before = by_start.withColumn("_reach", F.max("_far").over(Window.partitionBy(*key).orderBy("start_line").rowsBetween(Window.unboundedPreceding, -1)))
    out = chunks.join(before, [*key, "start_line"])
    covered = (F.col("end_line") < F.col("_far")) | (F.coalesce(F.col("_reach"), F.lit(-1)) >= F.col("end_line"))
    return out.filter(~covered).drop("_far", "_reach")


def python_entities(files: DataFrame) -> DataFrame:
    """(project_id, path, kind, name, start_line, end_line, calls): functions and classes of Python files.
    Files that do not parse, and other files, give no rows."""

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for project, path, text in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    with warnings.catch_warnings():
                        warnings.simplefilter("ignore")
                        tree = ast.parse(text.lstrip("\ufeff"))
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
                for node in ast.walk(tree):
                    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                        calls = sorted({f.id if isinstance(f, ast.Name) else f.attr for c in ast.walk(node) if isinstance(c, ast.Call) for f in [c.func] if isinstance(f, (ast.Name, ast.Attribute))})
                        first = min([node.lineno, *[d.lineno for d in node.decorator_list]])
                        for col, v in zip(out, (project, path, "class_definition" if isinstance(node, ast.ClassDef) else "function_definition", node.name, first, node.end_lineno, calls)):
                            col.append(v)
            s, i = pa.string(), pa.int32()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (s, s, s, s, i, i, pa.list_(s)))], ["project_id", "path", "kind", "name", "start_line", "end_line", "calls"])

    src = files.filter("path like '%.py' and content is not null").select("project_id", "path", "content")
    return src.mapInArrow(run, "project_id string, path string, kind string, name string, start_line int, end_line int, calls array<string>")
