"""Whole-corpus analytics over chunks: dead symbols, sync, dependencies, rules, packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.code import package_of
from .ordered import running

#: Characters after which joined texts begin a new part.
PART = 1_000_000

# Modules of the runtime that no manifest declares.
NODE_BUILTINS = (
    "fs", "path", "http", "https", "crypto", "os", "url", "util", "stream", "events", "buffer", "child_process", "async_hooks", "net", "tls", "dns", "readline", "vm",
    "worker_threads", "zlib", "console", "constants", "module", "process", "punycode", "querystring", "string_decoder", "timers", "tty", "v8",
)


def is_test(path: Column) -> Column:
    return F.contains(path, F.lit("test")) | F.contains(path, F.lit("spec"))


def dead_symbols(chunks: DataFrame, library: bool = False) -> DataFrame:
    """(symbol, path): symbols called nowhere, neither by full name nor by last part; the greatest path of each.

    Paths with test or spec are left out; in a library only internal and private paths count.
    """
    keep = ~is_test(F.col("path"))
    if library:
        keep = keep & (F.contains("path", F.lit("internal")) | F.contains("path", F.lit("private")))
    src = chunks.filter(keep)
    symbols = src.select(F.explode("symbols").alias("symbol"), "path").groupBy("symbol").agg(F.max("path").alias("path"))
    calls = src.select(F.explode("calls").alias("call")).distinct()
    base = symbols.withColumn("base", F.element_at(F.split("symbol", r"\."), -1))
    return base.join(calls, F.col("symbol") == F.col("call"), "left_anti").join(calls, F.col("base") == F.col("call"), "left_anti").select("symbol", "path")


def missing_tests(chunks: DataFrame) -> DataFrame:
    """(symbol, path): symbols outside tests that no test names or calls; the greatest path of each."""
    test = chunks.filter(is_test(F.col("path")))
    named = test.select(F.explode(F.concat("symbols", "calls")).alias("symbol")).distinct()
    code = chunks.filter(~is_test(F.col("path"))).select(F.explode("symbols").alias("symbol"), "path").groupBy("symbol").agg(F.max("path").alias("path"))
    return code.join(named, "symbol", "left_anti")


def sync_diff(disk: DataFrame, indexed: DataFrame, key: list[str]) -> DataFrame:
    """(state, files, chunks): disk (key, mtime) against index (key, updated_at): modified, missing, deleted or same."""
    d = disk.groupBy(*key).agg(F.max("mtime").alias("mtime"))
    i = indexed.groupBy(*key).agg(F.max("updated_at").alias("at"), F.count(F.lit(1)).alias("n"), F.lit(True).alias("here"))
    both = d.withColumn("there", F.lit(True)).join(i, key, "full_outer")
    state = F.when(F.col("here").isNull(), "missing").when(F.col("there").isNull(), "deleted").when(F.coalesce(F.col("mtime") > F.col("at"), F.lit(False)), "modified").otherwise("same")
    return both.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))


def package_edges(chunks: DataFrame, prefix: str = "") -> DataFrame:
    """(src, dst): package of a path and what it imports, each once."""
    e = chunks.select(package_of(F.col("path")).alias("src"), F.explode("relationships").alias("dst")).filter("src is not null")
    return (e.filter(F.startswith("dst", F.lit(prefix))) if prefix else e).distinct()


def external_package(dep: Column, ecosystem: str, declared: tuple[str, ...] = ()) -> Column:
    """The package that an import needs in a manifest; null for local ones, builtins and bare names."""
    if ecosystem == "npm":
        parts = F.split(dep, "/")
        name = F.when(F.startswith(dep, F.lit("@")) & (F.size(parts) > 1), F.concat_ws("/", parts[0], parts[1])).otherwise(parts[0])
        bare = dep.rlike(r"^[a-z][^/.]*$") & ~dep.isin("react", "next", "lucide-react", *declared)
        return F.when(dep.rlike(r"^[./]") | dep.rlike(r"^\p{Lu}") | dep.isin(*NODE_BUILTINS) | bare, None).otherwise(name)
    if ecosystem == "go":
        return F.when(F.contains(dep, F.lit(".")), dep)
    return F.when(~F.startswith(dep, F.lit(".")), dep)


def undeclared(imports: DataFrame, manifest: list[str], ecosystem: str) -> DataFrame:
    """(package, files): external packages among imports (path, dep) that the manifest lacks, with their sorted files."""
    need = imports.select("path", external_package(F.col("dep"), ecosystem, tuple(manifest)).alias("package")).filter("package is not null")
    return need.filter(~F.col("package").isin(*manifest) if manifest else F.lit(True)).groupBy("package").agg(F.array_sort(F.collect_set("path")).alias("files"))


def resolve_aliases(imports: DataFrame, aliases: list[tuple[str, str]]) -> DataFrame:
    """(dep, resolved): imports whose first matching alias prefix is replaced by its target; the list is part of the query."""
    out = None
    for a, target in aliases:
        hit = F.startswith("dep", F.lit(a))
        new = F.concat(F.lit(target), F.substring("dep", F.lit(len(a) + 1), F.length("dep")))
        out = F.when(hit, new) if out is None else out.when(hit, new)
    return imports.select("dep", out.alias("resolved")).filter("resolved is not null")


def rule_violations(chunks: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, dep, rule_id): files whose import a rule (rule_id, text) forbids by "no <dep>" or "forbidden: <dep>".

    What follows those words in a rule is cut out once, and met by imports on its first two characters,
    so that rules and imports are never all compared.
    """
    deps = chunks.select("path", F.explode("relationships").alias("dep")).filter("dep <> ''").distinct().withColumn("low", F.lower("dep"))
    tails = rules.select("rule_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?s)(?=(?:no |forbidden: )(.{1,300}))"), F.lit(1))).alias("tail")).distinct()
    tails = tails.withColumn("head", F.explode(F.array_distinct(F.array(F.substring("tail", 1, 1), F.substring("tail", 1, 2)))))
    hit = deps.withColumn("head", F.substring("low", 1, 2)).join(tails, "head").filter(F.startswith("tail", F.col("low")))
    return hit.select("path", "dep", "rule_id").distinct()


def package_summary(chunks: DataFrame) -> DataFrame:
    """(project_id, package, n_files, n_symbols, symbols_hash): distinct files and symbols of every package."""
    src = chunks.select("project_id", package_of(F.col("path")).alias("package"), "path", "symbols").filter("package is not null")
    files = src.groupBy("project_id", "package").agg(F.countDistinct("path").alias("n_files"))
    names = src.select("project_id", "package", F.explode("symbols").alias("s")).distinct()
    return files.join(names.groupBy("project_id", "package").agg(F.count(F.lit(1)).alias("n_symbols"), F.min("s").alias("first_symbol"), F.max("s").alias("last_symbol")), ["project_id", "package"], "left").select(
        "project_id", "package", "n_files", F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"), "first_symbol", "last_symbol"
    )


def joined_text(rows: DataFrame, key: list[str], order: list[str], text: Column, separator: str, most: int = PART) -> DataFrame:
    """(key, part, text, texts): texts of a key in order with a separator between, and how many they are.

    A part begins after every ``most`` characters, so that no key, however many texts it has, has to fit one row;
    joined by the separator the parts of a key are all of its text. A text is never cut. Null texts are left out.
    """
    each = running(rows.select(*key, *order, text.alias("_t")).filter("_t is not null"), key, F.length("_t") + len(separator), *[F.col(c) for c in order])
    part = F.floor((F.col("cum") - F.length("_t") - len(separator)) / most).cast("int")
    lists = each.groupBy(*key, part.alias("part")).agg(F.array_sort(F.collect_list(F.struct(*order, "rn", F.col("_t")))).alias("l"))
    return lists.select(*key, "part", F.array_join(F.transform("l", lambda e: e["_t"]), separator).alias("text"), F.size("l").alias("texts"))
