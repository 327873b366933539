"""Scanning a directory tree, reading files, and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.code import extension, is_indexable
from ..functions.text import utf8_lossy

#: Directories that are never scanned.
SKIPPED = ("node_modules", "dist", "build", ".next", "target", ".git")


def scan(spark: SparkSession, root: str, ignore: tuple[str, ...] = SKIPPED, pattern: str = "*") -> DataFrame:
    """(path, size, modified, file): files below a root, hidden ones and ignored directories apart.

    ``binaryFile`` reads no content unless a later step asks for it.
    """
    base = root.rstrip("/")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(base)
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + base + "/", "")
    out = df.select(rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.col("path").alias("file"))
    return out.filter(_kept(F.col("path"), ignore))


def _kept(path: Column, ignore: tuple[str, ...]) -> Column:
    keep = ~path.rlike(r"(^|/)\.")
    for d in ignore:
        keep = keep & ~F.concat(F.lit("/"), path).contains(f"/{d}/")
    return keep


def read(spark: SparkSession, root: str, ignore: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(path, content, content_hash, size): indexable files of a tree as text, broken UTF-8 replaced."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + root.rstrip("/") + "/", "")
    ok = df.filter(is_indexable(extension(F.col("path")), F.col("length")))
    return ok.filter(_kept(rel, ignore)).select(rel.alias("path"), utf8_lossy(F.col("content")).alias("content"), F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size"))


def npm_dependencies(text: Column) -> Column:
    keys = lambda p: F.coalesce(F.json_object_keys(F.get_json_object(text, p)), F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(keys("$.dependencies"), keys("$.devDependencies"))))


def go_dependencies(text: Column) -> Column:
    """First words of lines with two words or more, module and go apart."""
    words = F.transform(F.split(text, "\n"), lambda l: F.filter(F.split(F.trim(l), r"\s+"), lambda w: w != ""))
    hits = F.filter(words, lambda w: (F.size(w) >= 2) & ~F.get(w, F.lit(0)).isin("module", "go"))
    return F.array_sort(F.array_distinct(F.transform(hits, lambda w: F.get(w, F.lit(0)))))


def python_dependencies(text: Column) -> Column:
    """What stands before == on each line that is no comment."""
    names = F.transform(F.split(text, "\n"), lambda l: F.trim(F.substring_index(l, "==", 1)))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: (n != "") & ~F.startswith(n, F.lit("#")))))
