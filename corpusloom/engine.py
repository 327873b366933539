"""The service surface as one object: indexing a directory, search, analysis, edits; tools and actions by name.

Answers are DataFrames; the dispatch is a dictionary. Transports are left to the caller.
"""

from __future__ import annotations

import os
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import code, text
from .operators import analysis, chunking, entities, fusion, graph, lexical, vectors
from .operators.store import Store, incremental_skip
from .sources import files

KEY = ["project_id", "path"]
CHUNKS = "id string, project_id string, path string, node_type string, content string, start_line int, end_line int, symbols array<string>, calls array<string>, relationships array<string>, function_score double, content_hash string, updated_at long, category string, vector array<float>"


class PathError(ValueError):
    pass


def guard(base: str, target: str, create: bool = False, deepest: int = 20) -> str:
    """The real path of ``target`` below ``base``; links are followed, and what leaves the base is refused.

    A file to create need not exist; its nearest existing ancestor must lie within the base.
    """
    root = os.path.realpath(base)
    path = target if os.path.isabs(target) else os.path.join(root, target)
    if len([p for p in os.path.relpath(os.path.normpath(path), root).split(os.sep) if p]) > deepest:
        raise PathError("too deep")
    if not create and not os.path.exists(path):
        raise PathError("no such path")
    real = os.path.realpath(path)
    if real != root and not real.startswith(root + os.sep):
        raise PathError("outside of the base")
    return real


class RateLimiter:
    """Token buckets by key: ``rate`` a second up to ``burst``; idle buckets are dropped by ``cleanup``."""

    def __init__(self, rate: float = 30.0, burst: float = 60.0, clock=time.monotonic):
        self.rate, self.burst, self.clock = rate, burst, clock
        self._buckets: dict[str, tuple[float, float]] = {}

    def allow(self, key: str) -> bool:
        now = self.clock()
        tokens, last = self._buckets.get(key, (self.burst, now))
        tokens = min(self.burst, tokens + (now - last) * self.rate)
        ok = tokens >= 1
        self._buckets[key] = (tokens - ok, now)
        return ok

    def cleanup(self, idle: float) -> int:
        old = [k for k, (_, last) in self._buckets.items() if self.clock() - last > idle]
        for k in old:
            del self._buckets[k]
        return len(old)


class Engine:
    """A store of indexed projects and the tools over it.

    ``embed`` maps a text column to a vector column; the default is the deterministic stand-in.
    """

    def __init__(self, spark: SparkSession, store: str, project: str = "", embed=None, dim: int = 64):
        self.spark, self.store, self.project = spark, Store(spark, store), project
        self.embed = embed or vectors.hashed_embedding(dim)
        self.status = {"status": "idle", "indexed": 0, "skipped": 0}
        self.limiter = RateLimiter()

    # -- indexing --

    def chunks(self) -> DataFrame:
        df = self.store.read("chunks")
        return self.spark.createDataFrame([], CHUNKS) if df is None else df

    def index(self, root: str, project: str | None = None, now: int | None = None) -> dict:
        """Index a directory: files whose hash is stored are skipped, stale chunks replaced, vanished files dropped."""
        project = project or self.project
        self.project, self.status["status"] = project, "indexing"
        src = files.read(self.spark, root).withColumn("project_id", F.lit(project))
        old = self.chunks()
        fresh = incremental_skip(src, old, KEY, "content_hash")
        rows = self._chunk(fresh, int(time.time()) if now is None else now)
        gone = old.filter(F.col("project_id") == project).select(*KEY).distinct().join(src.select(*KEY), KEY, "left_anti")
        kept = old.join(fresh.select(*KEY).unionByName(gone), KEY, "left_anti")
        n = fresh.count()
        self.store.publish("chunks", kept.unionByName(rows))
        self.status = {"status": "ready", "indexed": n, "skipped": src.count() - n}
        return self.status

    def _chunk(self, src: DataFrame, now: int) -> DataFrame:
        """Entities with their lines as content; files without any in windows."""
        f = src.select(*KEY, "content", "content_hash")
        py = chunking.python_entities(f).select(*KEY, "kind", "name", "start_line", "end_line")
        found = entities.entities(f).unionByName(py)
        found = chunking.drop_contained(found.withColumnRenamed("kind", "node_type"), [*KEY, "node_type"])
        lines = F.split(F.regexp_replace("content", "\r\n", "\n"), "\n")
        part = F.array_join(F.slice(lines, F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
        named = found.join(f, KEY).withColumn("body", part).select(*KEY, "node_type", F.array("name").alias("symbols"), "start_line", "end_line", "body", "content", "content_hash")
        rest = chunking.windows(f.join(found.select(*KEY).distinct(), KEY, "left_anti").withColumn("whole", F.col("content")), [*KEY, "content_hash", "whole"], "content")
        plain = rest.select(*KEY, F.lit("chunk").alias("node_type"), F.array().cast("array<string>").alias("symbols"), "start_line", "end_line", F.col("chunk").alias("body"), F.col("whole").alias("content"), "content_hash")
        both = named.unionByName(plain)
        ext = code.extension(F.col("path"))
        calls = F.when(F.col("node_type") == "chunk", F.array().cast("array<string>")).otherwise(F.array_except(code.call_names(F.col("body")), F.col("symbols")))
        both = both.withColumn("calls", calls).withColumn("relationships", code.imports(F.col("content"), ext))
        score = F.when(F.col("node_type") == "chunk", 0.0).otherwise(code.importance(F.col("start_line"), F.col("end_line"), F.col("calls")))
        ident = F.concat_ws("-", "project_id", "path", F.concat_ws(":", "start_line", "node_type", F.coalesce(F.get("symbols", F.lit(0)), F.lit(""))))
        category = F.when(ext.isin("md", "pdf"), "document").otherwise("code")
        return both.select(
            ident.alias("id"), *KEY, "node_type", F.col("body").alias("content"), F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), "symbols", "calls", "relationships",
            score.alias("function_score"), "content_hash", F.lit(now).cast("long").alias("updated_at"), category.alias("category"), self.embed(F.col("body")).alias("vector"),
        )

    # -- search --

    def _scope(self, projects: list[str] | None) -> DataFrame:
        c = self.chunks()
        return c.filter(F.col("project_id").isin(*projects)) if projects else c

    def _vector(self, query: str) -> list[float]:
        return list(self.spark.createDataFrame([(query,)], "q string").select(self.embed(F.col("q"))).first()[0])

    def search(self, query: str, limit: int = 10, path: str = "", projects: list[str] | None = None, docs_only: bool = False) -> DataFrame:
        """(rank, id, path, start_line, end_line, content): both arms fused, then the path filter, then the reranker."""
        limit = max(1, min(limit, 100))
        c, wide = self._scope(projects), limit * fusion.OVERSAMPLE
        words = [w for w in query.lower().split() if w]
        near = fusion.ranked(vectors.nearest_to(c.select("id", F.col("vector").alias("v")), self._vector(query), wide * fusion.OVERSAMPLE), F.col("distance"), F.col("id"))
        docs = c.select("id", text.lexical_text(F.col("content"), F.col("path"), F.col("symbols"), F.col("calls")).alias("text"))
        found = fusion.ranked(lexical.bm25(docs, words, wide * fusion.OVERSAMPLE), F.desc("score"), F.col("id"))
        hits = fusion.rrf(near, found, wide).join(c, "id")
        hits = hits.filter(F.contains("path", F.lit(path))) if path else hits
        hits = hits.filter("category = 'document'") if docs_only else hits
        best = hits.withColumn("overlap", fusion.overlap(words, F.col("content")) if words else F.lit(0.0)).orderBy(F.desc("overlap"), F.desc("score"), "id").limit(limit)
        return fusion.ranked(best, F.desc("overlap"), F.desc("score"), F.col("id")).select("rank", "id", "path", "start_line", "end_line", "content")

    def turbo(self, query: str, limit: int = 10, path: str = "") -> DataFrame:
        """(id, path, score): over the quantised vectors; the path filter after the limit."""
        q = F.array(*[F.lit(float(x)) for x in self._vector(query)])
        top = self.chunks().select("id", "path", F.round(vectors.dot(vectors.quantize(F.col("vector")), vectors.quantize(q)) / 16129.0, 4).alias("score")).orderBy(F.desc("score"), "id").limit(limit)
        return top.filter(F.contains("path", F.lit(path))) if path else top

    def grep(self, query: str, regex: bool = False, limit: int = 100) -> DataFrame:
        docs = self.chunks().filter("node_type = 'chunk' or array_size(symbols) > 0").select(F.col("path").alias("id"), F.col("content").alias("text"))
        return lexical.grep(docs, query, regex, limit).withColumnRenamed("id", "path")

    def names(self, query: str, limit: int = 10) -> DataFrame:
        c = self.chunks().select(F.explode("symbols").alias("name"), "node_type", "path")
        return c.filter(F.contains(F.lower("name"), F.lit(query.lower()))).distinct().orderBy("name", "path", "node_type").limit(limit)

    def implementations(self, records: DataFrame, interface: str) -> DataFrame:
        pairs = graph.implements(records)
        wanted = records.filter(F.col("name") == interface).select(F.col("id").alias("interface_id")).distinct()
        return pairs.join(wanted, "interface_id", "left_semi").select(F.col("type_id").alias("id"))

    def related(self, path: str) -> DataFrame:
        """(section, id): chunks of a file, of what it imports, and of callers of its symbols."""
        c = self.chunks()
        own = c.filter(F.col("path") == path)
        deps = own.select(F.explode("relationships").alias("dep")).select(F.regexp_replace("dep", r"^[./@]+", "").alias("dep")).filter("dep <> ''").distinct()
        other = c.filter(F.col("path") != path)
        near = F.lit(False)
        for (dep,) in deps.collect():  # the imports of one file
            near = near | F.contains("path", F.lit(dep))
        calls = other.select("id", F.explode("calls").alias("s")).join(own.select(F.explode("symbols").alias("s")).distinct(), "s", "left_semi")
        tag = lambda df, s: df.select(F.lit(s).alias("section"), "id")
        return tag(own, "file").unionByName(tag(other.filter(near), "dependency")).unionByName(tag(calls, "symbol")).distinct()

    def index_status(self, root: str) -> DataFrame:
        disk = files.scan(self.spark, root).filter(code.is_indexable(code.extension(F.col("path")), F.col("size")))
        disk = disk.select(F.lit(self.project).alias("project_id"), "path", F.unix_timestamp("modified").alias("mtime"))
        return analysis.sync_diff(disk, self.chunks().filter(F.col("project_id") == self.project), KEY)

    # -- contexts --

    def store_context(self, text_: str, project: str | None = None) -> None:
        row = [(project or self.project, text_, int(time.time() * 1e6))]
        self.store.append("contexts", self.spark.createDataFrame(row, "project_id string, text string, at long"))

    def contexts(self, project: str | None = None) -> DataFrame:
        df = self.store.read("contexts")
        df = self.spark.createDataFrame([], "project_id string, text string, at long") if df is None else df
        return df.filter(F.col("project_id") == (project or self.project)).orderBy("at", "text")

    def delete_context(self, path: str) -> None:
        """Chunks of one path, or with ALL everything of the project, contexts included."""
        mine = F.col("project_id") == self.project
        c = self.chunks()
        if path == "ALL":
            self.store.publish("chunks", c.filter(~mine))
            ctx = self.store.read("contexts")
            if ctx is not None:
                self.store.publish("contexts", ctx.filter(~mine))
        else:
            self.store.publish("chunks", c.filter(~(mine & (F.col("path") == path))))

    # -- analysis --

    def skeleton(self, path: str = ".", depth: int = 3, most: int = 1000, include: str = "", exclude: str = "") -> DataFrame:
        p = self.chunks().select("path").distinct()
        p = p if path in (".", "") else p.filter(F.startswith("path", F.lit(path.rstrip("/") + "/")))
        p = p.filter(F.contains("path", F.lit(include))) if include else p
        p = p.filter(~F.contains("path", F.lit(exclude))) if exclude else p
        parts = F.split("path", "/")
        each = p.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("name")).distinct()
        return each.select((F.size(F.split("name", "/")) - 1).alias("depth"), "name").orderBy("name").limit(most)

    def duplicates(self, path: str, least: float = 0.95) -> DataFrame:
        """(path, similarity): other files with a chunk whose vector is close to one of the file's."""
        c = self.chunks().select("id", "path", F.col("vector").alias("v"))
        near = vectors.knn(c, c.filter(F.col("path") == path), 10, "cosine").filter(F.col("score") >= least)
        return near.join(c.select("id", "path"), "id").filter(F.col("path") != path).groupBy("path").agg(F.max("score").alias("similarity"))

    def dependencies(self, manifest: str, kind: str, path: str = "") -> DataFrame:
        parse = {"npm": files.npm_dependencies, "go": files.go_dependencies, "python": files.python_dependencies}[kind]
        declared = self.spark.createDataFrame([(manifest,)], "t string").select(parse(F.col("t"))).first()[0]
        imports = self.chunks().filter(F.startswith("path", F.lit(path))).select("path", F.explode("relationships").alias("dep"))
        return analysis.undeclared(imports, list(declared), kind)

    def docstring_prompt(self, path: str, entity: str) -> str | None:
        row = self.chunks().filter((F.col("path") == path) & F.array_contains("symbols", entity)).orderBy("start_line", "id").select("content").first()
        style = code.DOC_STYLES.get(path.rpartition(".")[2], code.DOC_STYLE_ELSE)
        return row and f"Write {style} for `{entity}` in {path}:\n\n{row[0]}"

    # -- edits: the text that would result; nothing is written --

    @staticmethod
    def patched(content: str, search: str, replace: str = "") -> str | None:
        return content.replace(search, replace, 1) if search and search in content else None

    @staticmethod
    def snippet(content: str, line: int) -> str:
        rows = content.split("\n")
        return "\n".join(rows[max(0, line - 2) : max(0, line + 3)])

    @staticmethod
    def risk(references: Column) -> Column:
        return code.risk(references)

    # -- dispatch --

    def call(self, tool: str, action: str = "", **args):
        """A tool's action by name; unknown ones and callers above their rate are refused."""
        if not self.limiter.allow(args.pop("session", "local")):
            raise RuntimeError("too many calls")
        tools = {
            "search_workspace": {"": self.search, "vector": self.search, "turbo": self.turbo, "regex": self.grep, "graph": self.names, "related_context": self.related, "index_status": self.index_status},
            "workspace_manager": {"set_project_root": self._project, "trigger_index": self.index, "get_indexing_diagnostics": lambda: self.status, "store_context": self.store_context, "delete_context": self.delete_context},
            "analyze_code": {
                "ast_skeleton": self.skeleton, "dead_code": lambda is_library=False: analysis.dead_symbols(self.chunks(), is_library), "duplicate_code": self.duplicates, "dependencies": self.dependencies,
                "distill_package": lambda: analysis.package_summary(self.chunks()), "architecture": lambda monorepo_prefix="": analysis.package_edges(self.chunks(), monorepo_prefix),
                "api_list": lambda keywords: lexical.keyword_topk(self.chunks().select("id", F.col("content").alias("text")), keywords), "docstring": self.docstring_prompt,
            },
            "modify_workspace": {"apply_patch": self.patched, "verify_patch": lambda content, search: self.patched(content, search) is not None, "auto_fix": self.snippet},
        }
        if tool not in tools or action not in tools[tool]:
            raise KeyError(f"{tool}/{action}")
        return tools[tool][action](**args)

    def _project(self, path: str) -> str:
        self.project = path
        return path
