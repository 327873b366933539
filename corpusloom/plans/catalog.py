"""Every query by name, over whole tables, beside SQL with the same result where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code, text
from ..operators import analysis, chunking, entities, fusion, graph, lexical, store, vectors
from ..session import table
from ..sources import files as source
from ..streaming import events as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Fixed query texts of the search queries.
QUESTION = "vector table retry queue"
WORDS = QUESTION.split()


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _vecs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _first_vector(s: SparkSession, d: str) -> list[float]:
    row = _vecs(s, d).filter("id = 0").select("v").first()
    return list(row[0]) if row else [0.0] * 64


# -- sources and store ------------------------------------------------------------------------------


@query()
def scan_files(s, d):
    return source.scan(s, d, pattern="*.parquet").select("path", "size")


@query("""SELECT project_id, path, octet_length(encode(content))::BIGINT AS size FROM code_files
WHERE regexp_extract(path, '\\.([^./]+)$', 1) IN ('go','rs','js','ts','tsx','php','py','md','pdf')
AND octet_length(encode(content)) <= CASE WHEN path LIKE '%.pdf' THEN 10000000 ELSE 1000000 END""")
def indexable_filter(s, d):
    size = F.octet_length("content").cast("long")
    return table(s, d, "code_files").filter(code.is_indexable(code.extension(F.col("path")), size)).select("project_id", "path", size.alias("size"))


@query("SELECT DISTINCT project_id, path, sha256(content) AS content_hash FROM code_files")
def content_hash(s, d):
    return table(s, d, "code_files").select("project_id", "path", F.sha2("content", 256).alias("content_hash")).distinct()


@query("""SELECT DISTINCT project_id, path, sha256(content) AS content_hash FROM code_files f WHERE NOT EXISTS
(SELECT 1 FROM code_chunks c WHERE c.project_id = f.project_id AND c.path = f.path AND c.content_hash = sha256(f.content))""")
def incremental_skip(s, d):
    return store.incremental_skip(content_hash(s, d), table(s, d, "code_chunks"), ["project_id", "path"], "content_hash")


@query()
def utf8_lossy(s, d):
    return table(s, d, "records").select("id", text.utf8_lossy(F.col("quantized_code")).alias("text"))


@query("SELECT id, project_id, path, node_type, start_line, end_line, updated_at FROM code_chunks")
def full_scan(s, d):
    return table(s, d, "code_chunks").select("id", "project_id", "path", "node_type", "start_line", "end_line", "updated_at")


@query("SELECT id, project_id, path, md5(content) AS digest, updated_at FROM code_chunks WHERE id = (SELECT min(id) FROM code_chunks)")
def lookup_id(s, d):
    t = table(s, d, "code_chunks")
    return t.join(F.broadcast(t.agg(F.min("id").alias("id"))), "id").select("id", "project_id", "path", F.md5("content").alias("digest"), "updated_at")


@query("SELECT id, project_id, path, updated_at FROM code_chunks WHERE id IN (SELECT id FROM graph_records)")
def lookup_ids(s, d):
    return table(s, d, "code_chunks").join(table(s, d, "graph_records").select("id"), "id", "left_semi").select("id", "project_id", "path", "updated_at")


@query("SELECT id, project_id, path FROM code_chunks WHERE path = (SELECT min(path) FROM code_chunks)")
def lookup_path(s, d):
    t = table(s, d, "code_chunks")
    return t.join(F.broadcast(t.agg(F.min("path").alias("path"))), "path").select("id", "project_id", "path")


_CURRENT = "SELECT id, max(coalesce(updated_at, -1)) AS updated_at, min(path) AS path FROM code_chunks GROUP BY id"


@query(f"SELECT id, path, updated_at FROM ({_CURRENT})")
def current_chunks(s, d):
    return table(s, d, "code_chunks").groupBy("id").agg(F.max(F.coalesce("updated_at", F.lit(-1))).alias("updated_at"), F.min("path").alias("path")).select("id", "path", "updated_at")


@query(f"""SELECT id, path, updated_at FROM ({_CURRENT}) UNION ALL
SELECT DISTINCT id, path, -2::BIGINT FROM graph_records WHERE id NOT IN (SELECT id FROM code_chunks)""")
def upsert_batch(s, d):
    base = table(s, d, "graph_records").select("id", "path", F.lit(-2).cast("long").alias("updated_at")).distinct()
    return store.upsert(base, current_chunks(s, d), ["id"])


@query("""SELECT id, project_id, path FROM code_chunks c WHERE NOT EXISTS
(SELECT 1 FROM fs_events e WHERE e.kind = 'remove' AND e.project_id = c.project_id AND e.path = c.path)""")
def delete_path(s, d):
    gone = table(s, d, "fs_events").filter("kind = 'remove'")
    return store.delete(table(s, d, "code_chunks").select("id", "project_id", "path"), gone, ["project_id", "path"])


@query("""SELECT c.id, c.path, CASE WHEN g.id IS NOT NULL THEN g.new ELSE c.category END AS category FROM code_chunks c
LEFT JOIN (SELECT id, max(node_type) AS new FROM graph_records WHERE name IS NULL GROUP BY id) g ON g.id = c.id""")
def patch_metadata(s, d):
    new = table(s, d, "graph_records").filter("name is null").select("id", F.col("node_type").alias("category"))
    return store.patch(table(s, d, "code_chunks").select("id", "path", "category"), new, ["id"], "category").select("id", "path", "category")


_META = "json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.{}')"


@query(f"SELECT DISTINCT id, {_META.format('project_id')} AS project_id, content AS text FROM records WHERE {_META.format('type')} = 'manual_context'")
def project_context(s, d):
    r = table(s, d, "records").filter(text.field(F.col("metadata"), "type") == "manual_context")
    return r.select("id", F.get_json_object("metadata", "$.project_id").alias("project_id"), F.col("content").alias("text")).distinct()


# literal manifests, the same for both engines
_NPM = '{"name": "app", "dependencies": {"react": "18.0.0", "@scope/ui": "1.2.0"}, "devDependencies": {"jest": "29.0.0"}}'
_GO = "module example.org/app\n\ngo 1.22\n\nrequire (\n\texample.org/lib v1.2.3\n\texample.org/log v0.4.0\n)\n"
_PY = "requests==2.31.0\nnumpy==1.26.4\n# a comment\nflask\n"


@query("SELECT unnest(['@scope/ui', 'jest', 'react']) AS package")
def manifest_npm(s, d):
    return s.createDataFrame([(_NPM,)], "t string").select(F.explode(source.npm_dependencies(F.col("t"))).alias("package"))


@query("SELECT unnest(['example.org/lib', 'example.org/log', 'require']) AS package")
def manifest_go(s, d):
    return s.createDataFrame([(_GO,)], "t string").select(F.explode(source.go_dependencies(F.col("t"))).alias("package"))


@query("SELECT unnest(['flask', 'numpy', 'requests']) AS package")
def manifest_py(s, d):
    return s.createDataFrame([(_PY,)], "t string").select(F.explode(source.python_dependencies(F.col("t"))).alias("package"))


_ALIASES = [("@shared/", "packages/shared/"), ("../", "lib/"), ("./", "src/")]


@query("""SELECT DISTINCT dep, CASE WHEN starts_with(dep, '@shared/') THEN 'packages/shared/' || dep[9:] WHEN starts_with(dep, '../') THEN 'lib/' || dep[4:] ELSE 'src/' || dep[3:] END AS resolved
FROM (SELECT unnest(relationships) AS dep FROM code_chunks) WHERE starts_with(dep, '@shared/') OR starts_with(dep, '../') OR starts_with(dep, './')""")
def alias_resolve(s, d):
    deps = table(s, d, "code_chunks").select(F.explode("relationships").alias("dep")).distinct()
    return analysis.resolve_aliases(deps, _ALIASES)


@query("""SELECT dir, depth::INT AS depth, count(*) AS files FROM (SELECT array_to_string(p[1:k], '/') AS dir, k AS depth
FROM (SELECT string_split(path, '/') AS p, unnest(range(1, least(len(string_split(path, '/')), 4))) AS k FROM (SELECT DISTINCT project_id, path FROM code_files))) GROUP BY ALL""")
def dir_tree(s, d):
    p = table(s, d, "code_files").select("project_id", "path").distinct().select(F.split("path", "/").alias("p"))
    each = p.filter(F.size("p") > 1).select("p", F.explode(F.sequence(F.lit(1), F.least(F.size("p") - 1, F.lit(3)))).alias("depth"))
    return each.groupBy(F.array_join(F.slice("p", F.lit(1), F.col("depth")), "/").alias("dir"), "depth").agg(F.count(F.lit(1)).alias("files"))


@query("""SELECT DISTINCT project_id, path FROM code_files WHERE contains(path, 'src/') AND NOT contains(path, 'test') AND len(string_split(path, '/')) <= 3""")
def skeleton_filtered(s, d):
    f = table(s, d, "code_files")
    return f.filter(F.contains("path", F.lit("src/")) & ~F.contains("path", F.lit("test")) & (F.size(F.split("path", "/")) <= 3)).select("project_id", "path").distinct()


# -- chunks and extraction ---------------------------------------------------------------------------

_WINDOW = """SELECT doc_id, k::INT AS chunk_index, text FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 3000 THEN 1 ELSE 1 + ceil((length(text) - 3000) / 2500.0)::INT END)) AS k FROM documents WHERE length(text) > 0)"""


@query(f"SELECT doc_id, chunk_index, md5(substring(text, chunk_index * 2500 + 1, 3000)) AS digest, length(substring(text, chunk_index * 2500 + 1, 3000))::INT AS size FROM ({_WINDOW})")
def chunk_window(s, d):
    return chunking.windows(table(s, d, "documents"), ["doc_id"], "text").select("doc_id", "chunk_index", F.md5("chunk").alias("digest"), F.length("chunk").alias("size"))


@query(f"""SELECT doc_id, chunk_index, (1 + length(a) - length(replace(a, chr(10), '')))::INT AS start_line, (1 + length(b) - length(replace(b, chr(10), '')))::INT AS end_line
FROM (SELECT doc_id, chunk_index, substring(text, 1, chunk_index * 2500) AS a, substring(text, 1, chunk_index * 2500 + 3000) AS b FROM ({_WINDOW}))""")
def chunk_lines(s, d):
    return chunking.windows(table(s, d, "documents"), ["doc_id"], "text").select("doc_id", "chunk_index", "start_line", "end_line")


@query()
def chunk_ast_py(s, d):
    return chunking.python_entities(table(s, d, "code_files")).withColumn("calls", F.array_join("calls", "|")).distinct()


@query()
def chunk_entities(s, d):
    return entities.entities(table(s, d, "code_files")).distinct()


@query("""SELECT DISTINCT project_id, path, CASE regexp_extract(path, '\\.([^./]+)$', 1) WHEN 'go' THEN 'Go' WHEN 'js' THEN 'JavaScript' WHEN 'jsx' THEN 'JavaScript' WHEN 'ts' THEN 'TypeScript'
WHEN 'tsx' THEN 'TSX' WHEN 'php' THEN 'PHP' WHEN 'rs' THEN 'Rust' WHEN 'py' THEN 'Python' END AS language FROM code_files""")
def lang_of_ext(s, d):
    return table(s, d, "code_files").select("project_id", "path", code.lookup(code.extension(F.col("path")), code.LANGUAGES).alias("language")).distinct()


_RANGES = "(SELECT DISTINCT project_id, path, node_type, start_line, end_line FROM code_chunks WHERE start_line >= 1 AND end_line >= start_line)"


@query(f"""WITH c AS {_RANGES} SELECT * FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.project_id = a.project_id AND b.path = a.path AND b.node_type = a.node_type
AND b.start_line <= a.start_line AND b.end_line >= a.end_line AND b.end_line - b.start_line > a.end_line - a.start_line)""")
def contain_antijoin(s, d):
    c = table(s, d, "code_chunks").filter("start_line >= 1 and end_line >= start_line").select("project_id", "path", "node_type", "start_line", "end_line").distinct()
    return chunking.drop_contained(c, ["project_id", "path", "node_type"]).select("project_id", "path", "node_type", "start_line", "end_line")


_NO = ", ".join(f"'{w}'" for w in code.NO_CALLS)


@query(f"""SELECT DISTINCT id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(content, '([A-Za-z_$][A-Za-z0-9_$]*)\\s*\\(', 1), lambda n: n NOT IN ({_NO})))), '|') AS calls FROM code_chunks""")
def call_names(s, d):
    return table(s, d, "code_chunks").select("id", F.array_join(code.call_names(F.col("content")), "|").alias("calls")).distinct()


@query("""SELECT id, path, round(1.0 - CASE WHEN n < 3 THEN 0.3 ELSE 0 END + CASE WHEN n > 10 THEN 0.2 ELSE 0 END + coalesce(len(calls), 0) * 0.1, 4)::DOUBLE AS score
FROM (SELECT id, path, calls, CASE WHEN start_line >= 1 AND end_line >= start_line THEN end_line - start_line + 1 ELSE 0 END AS n FROM code_chunks)""")
def function_score(s, d):
    return table(s, d, "code_chunks").select("id", "path", code.importance(F.col("start_line"), F.col("end_line"), F.col("calls")).alias("score"))


_JS = "list_concat(regexp_extract_all(content, '(?:import|from|require)\\s*\\(?\\s*[''\"]([^''\"]+)[''\"]', 1), list_filter(flatten(list_transform(regexp_extract_all(content, 'import\\s*\\{([^}]+)\\}', 1), lambda x: list_transform(string_split(x, ','), lambda p: trim(string_split(p, ' as ')[1], ' ')))), lambda p: p <> ''))"
_GO_SQL = "list_concat(regexp_extract_all(content, 'import\\s+(?:[a-zA-Z0-9_.]+\\s+)?[\"'']([^\"'']+)[\"'']', 1), flatten(list_transform(regexp_extract_all(content, 'import\\s+\\(([\\s\\S]*?)\\)', 1), lambda b: regexp_extract_all(b, '[\"'']([^\"'']+)[\"'']', 1))))"
_USES = "list_filter(flatten(list_transform(regexp_extract_all(content, 'use\\s+([^;]+);', 1), lambda x: list_transform(string_split(x, ','), lambda p: trim(string_split(p, ' as ')[1], ' ')))), lambda p: p <> '')"
_PHP_SQL = f"list_concat(regexp_extract_all(content, '(?:require|require_once|include|include_once)\\s*\\(?\\s*[''\"]([^''\"]+)[''\"]', 1), {_USES})"
_RS = "list_transform(regexp_extract_all(content, 'use\\s+([^;]+);', 1), lambda u: trim(u, ' '))"


def _import_sql(exts: str, lists: str) -> str:
    return f"SELECT DISTINCT project_id, path, array_to_string(list_sort(list_distinct({lists})), '|') AS imports FROM code_files WHERE regexp_extract(path, '\\.([^./]+)$', 1) IN ({exts})"


def _imports(s, d, exts, f):
    t = table(s, d, "code_files").filter(code.extension(F.col("path")).isin(*exts))
    return t.select("project_id", "path", F.array_join(F.array_sort(F.array_distinct(f(F.col("content")))), "|").alias("imports")).distinct()


@query(_import_sql("'js', 'ts'", _JS))
def imports_js(s, d):
    return _imports(s, d, ("js", "ts"), code.imports_js)


@query(_import_sql("'go'", _GO_SQL))
def imports_go(s, d):
    return _imports(s, d, ("go",), code.imports_go)


@query(_import_sql("'php'", _PHP_SQL))
def imports_php(s, d):
    return _imports(s, d, ("php",), code.imports_php)


@query(_import_sql("'rs'", _RS))
def imports_rust(s, d):
    return _imports(s, d, ("rs",), code.imports_rust)


@query(f"""SELECT DISTINCT project_id, path, len(list_distinct(CASE WHEN e IN ('js', 'ts') THEN {_JS} WHEN e = 'go' THEN {_GO_SQL} WHEN e = 'php' THEN {_PHP_SQL} WHEN e = 'rs' THEN {_RS} ELSE [] END))::INT AS n
FROM (SELECT *, regexp_extract(path, '\\.([^./]+)$', 1) AS e FROM code_files)""")
def imports_dispatch(s, d):
    return table(s, d, "code_files").select("project_id", "path", F.size(code.imports(F.col("content"), code.extension(F.col("path")))).alias("n")).distinct()


@query("""SELECT DISTINCT id, md5('File: ' || path || '. Entity: ' || coalesce(symbols[1], 'Global') || '. Type: ' || node_type || '. Calls: ' || CASE WHEN len(coalesce(calls, [])) = 0 THEN 'None' ELSE array_to_string(calls, ', ') END || '. Code:' || chr(10) || content) AS digest FROM code_chunks""")
def contextual_string(s, d):
    calls = F.when(F.coalesce(F.size("calls"), F.lit(0)) <= 0, "None").otherwise(F.array_join("calls", ", "))
    t = F.concat(F.lit("File: "), "path", F.lit(". Entity: "), F.coalesce(F.get("symbols", F.lit(0)), F.lit("Global")), F.lit(". Type: "), "node_type", F.lit(". Calls: "), calls, F.lit(". Code:\n"), "content")
    return table(s, d, "code_chunks").select("id", F.md5(t).alias("digest")).distinct()


@query("""SELECT DISTINCT id, to_json(struct_pack(path := path, project_id := project_id, type := node_type, updated_at := updated_at, start_line := start_line, end_line := end_line, symbols := symbols)) AS metadata FROM code_chunks""")
def record_metadata(s, d):
    m = F.struct("path", "project_id", F.col("node_type").alias("type"), "updated_at", "start_line", "end_line", "symbols")
    return table(s, d, "code_chunks").select("id", F.to_json(m, {"ignoreNullFields": "false"}).alias("metadata")).distinct()


@query("SELECT DISTINCT id, md5(concat_ws(' ', content, path, array_to_string(symbols, ' '), array_to_string(calls, ' '))) AS digest FROM code_chunks")
def lexical_text(s, d):
    return table(s, d, "code_chunks").select("id", F.md5(text.lexical_text(F.col("content"), F.col("path"), F.col("symbols"), F.col("calls"))).alias("digest")).distinct()


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k FROM events")
def json_access(s, d):
    return table(s, d, "events").select("event_id", text.field(F.col("props"), "k").alias("k"))


@query("SELECT DISTINCT id, array_to_string(list_filter(list_transform(string_split(array_to_string(calls, ' , ,'), ','), lambda p: trim(p, ' ')), lambda p: p <> ''), '|') AS parts FROM code_chunks")
def split_list(s, d):
    return table(s, d, "code_chunks").select("id", F.array_join(text.split_list(F.array_join("calls", " , ,")), "|").alias("parts")).distinct()


@query("""SELECT DISTINCT path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent, string_split(path, '/')[-1] AS name, regexp_extract(path, '\\.([^./]+)$', 1) AS ext FROM code_files""")
def path_parts(s, d):
    p = F.col("path")
    return table(s, d, "code_files").select("path", code.parent(p).alias("parent"), code.basename(p).alias("name"), code.extension(p).alias("ext")).distinct()


@query("""SELECT call, n AS refs, CASE WHEN n <= 3 THEN 'Low' WHEN n <= 10 THEN 'Medium' ELSE 'High' END AS risk FROM (SELECT unnest(calls) AS call, count(*) AS n FROM code_chunks GROUP BY 1)""")
def risk_bucket(s, d):
    return table(s, d, "code_chunks").select(F.explode("calls").alias("call")).groupBy("call").agg(F.count(F.lit(1)).alias("refs")).withColumn("risk", code.risk(F.col("refs")))


@query("""SELECT user_id, severity, count(*) AS n FROM (SELECT user_id, CASE event_id % 4 + 1 WHEN 1 THEN 'Error' WHEN 2 THEN 'Warning' WHEN 3 THEN 'Info' ELSE 'Hint' END AS severity FROM events) GROUP BY ALL""")
def diag_severity(s, d):
    return table(s, d, "events").select("user_id", code.severity(F.col("event_id") % 4 + 1).alias("severity")).groupBy("user_id", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT DISTINCT path, CASE e WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'py' THEN 'python' ELSE 'plaintext' END AS language_id,
CASE e WHEN 'go' THEN 'gopls' WHEN 'rs' THEN 'rust-analyzer' WHEN 'ts' THEN 'typescript-language-server --stdio' WHEN 'js' THEN 'typescript-language-server --stdio' WHEN 'py' THEN 'pylsp' END AS server
FROM (SELECT path, regexp_extract(path, '\\.([^./]+)$', 1) AS e FROM code_files)""")
def lang_id(s, d):
    e = code.extension(F.col("path"))
    return table(s, d, "code_files").select("path", code.lookup(e, code.LANGUAGE_IDS, "plaintext").alias("language_id"), code.lookup(e, code.SERVERS).alias("server")).distinct()


@query("""SELECT DISTINCT c.id, c.start_line, md5(array_to_string(list_slice(string_split(f.content, chr(10)), greatest(c.start_line - 2, 1), c.start_line + 2), chr(10))) AS digest
FROM (SELECT DISTINCT id, project_id, path, start_line FROM code_chunks WHERE start_line >= 1) c JOIN (SELECT project_id, path, min(content) AS content FROM code_files GROUP BY ALL) f USING (project_id, path)
WHERE c.start_line <= len(string_split(f.content, chr(10)))""")
def snippet_window(s, d):
    c = table(s, d, "code_chunks").filter("start_line >= 1").select("id", "project_id", "path", "start_line").distinct()
    f = table(s, d, "code_files").groupBy("project_id", "path").agg(F.min("content").alias("content")).withColumn("lines", F.split("content", "\n"))
    first = F.greatest(F.col("start_line") - 2, F.lit(1))
    lines = F.slice("lines", first, F.col("start_line") + 3 - first)
    return c.join(f, ["project_id", "path"]).filter(F.col("start_line") <= F.size("lines")).select("id", "start_line", F.md5(F.array_join(lines, "\n")).alias("digest")).distinct()


@query("""SELECT DISTINCT path, CASE regexp_extract(path, '\\.([^./]+)$', 1) WHEN 'go' THEN 'Godoc comments' WHEN 'ts' THEN 'JSDoc comments' WHEN 'js' THEN 'JSDoc comments' WHEN 'py' THEN 'Python docstrings (PEP 257 format)'
WHEN 'rs' THEN 'Rust doc comments (/// style)' ELSE 'professional documentation comment' END AS style FROM code_files""")
def doc_style(s, d):
    return table(s, d, "code_files").select("path", code.lookup(code.extension(F.col("path")), code.DOC_STYLES, code.DOC_STYLE_ELSE).alias("style")).distinct()


# -- vectors -------------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(CASE WHEN starts_with(text, 'search_document: ') THEN text ELSE 'search_document: ' || text END) AS digest FROM documents")
def embed_prefix(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(text.with_prefix(F.col("text"), "search_document: ")).alias("digest"))


_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))"


@query(f"SELECT vec_id, round(embedding[1]::DOUBLE / {_NORM}, 6) AS first, round(embedding[64]::DOUBLE / {_NORM}, 6) AS last FROM embeddings")
def l2_normalize(s, d):
    u = vectors.l2_normalize(F.col("v"))
    return _vecs(s, d).select(F.col("id").alias("vec_id"), F.round(u[0], 6).alias("first"), F.round(u[63], 6).alias("last"))


@query()
def embed_batch(s, d):
    return table(s, d, "documents").select("doc_id", vectors.hashed_embedding()(F.col("text")).alias("vector"))


_HALF = "list_transform(embedding[1:32], lambda x: x::DOUBLE)"


@query(f"SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform({_HALF}, lambda x: x * x))), 6) AS first, 32 AS dim FROM embeddings")
def matryoshka(s, d):
    return _vecs(s, d).select(F.col("id").alias("vec_id"), F.round(vectors.l2_normalize(F.slice("v", 1, 32))[0], 6).alias("first"), F.lit(32).alias("dim"))


# The models a deployment may name, with their vector widths (1: a reranker).
MODELS = [
    ("Xenova/bge-m3", 1024), ("BAAI/bge-small-en-v1.5", 384), ("Xenova/bge-small-en-v1.5", 384), ("BAAI/bge-base-en-v1.5", 768), ("cross-encoder/ms-marco-MiniLM-L-6-v2", 1),
    ("Xenova/bge-reranker-base", 1), ("Xenova/bge-reranker-v2-m3", 1), ("Xenova/bge-reranker-v2-gemma", 1), ("Xenova/jina-reranker-v2-base-multilingual", 1),
    ("Xenova/jina-embeddings-v2-base-code", 768), ("IBM/granite-embedding-english-r2", 768),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {k}, '{'reranker' if k == 1 else 'embedder'}')" for n, k in MODELS) + ") t(name, dimension, kind)")
def model_registry(s, d):
    return s.createDataFrame([(n, k, "reranker" if k == 1 else "embedder") for n, k in MODELS], "name string, dimension int, kind string")


def _knn_sql(score: str, order: str, where: str = "", k: int = 10) -> str:
    return f"""SELECT query_id, id, round(s, 6) AS score, rank::INT AS rank FROM (SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY {order}, id) AS rank FROM
(SELECT q.vec_id AS query_id, e.vec_id AS id, {score} AS s FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id {where})) WHERE rank <= {k}"""


_L2 = "list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(_knn_sql(_L2, "round(s, 9)"))
def knn_l2(s, d):
    v = _vecs(s, d)
    return vectors.knn(v, v.filter("id % 100 = 0"), 10)


@query(_knn_sql(_COS, "round(s, 9) DESC"))
def knn_cosine(s, d):
    v = _vecs(s, d)
    return vectors.knn(v, v.filter("id % 100 = 0"), 10, "cosine")


@query(_knn_sql(_L2, "round(s, 9)", "AND e.label IN (0, 1, 2)"))
def knn_prefilter(s, d):
    v = _vecs(s, d)
    return vectors.knn(v.filter(F.col("label").isin(0, 1, 2)), v.filter("id % 100 = 0"), 10)


@query()
def knn_ivf(s, d):
    v = _vecs(s, d)
    return vectors.ivf_knn(v, v.filter("id % 100 = 0"), 10)




_Q8 = "list_transform({0}, lambda x: round(x::DOUBLE / sqrt(list_sum(list_transform({0}, lambda y: y::DOUBLE * y::DOUBLE))) * 127)::INT)"


@query(f"SELECT vec_id, array_to_string({_Q8.format('embedding')}, ' ') AS code FROM embeddings")
def quantize_int8(s, d):
    return _vecs(s, d).select(F.col("id").alias("vec_id"), F.array_join(vectors.quantize(F.col("v")).cast("array<string>"), " ").alias("code"))


_SIM = f"round(list_dot_product({_Q8.format('embedding')}::DOUBLE[], (SELECT {_Q8.format('embedding')}::DOUBLE[] FROM embeddings WHERE vec_id = 0)) / 16129.0, 6)"


def _similar(s, d):
    q = F.array(*[F.lit(float(x)) for x in _first_vector(s, d)])
    return _vecs(s, d).select(F.col("id").alias("vec_id"), F.round(vectors.dot(vectors.quantize(F.col("v")), vectors.quantize(q)) / 16129.0, 6).alias("similarity"))


@query(f"SELECT vec_id, {_SIM} AS similarity FROM embeddings")
def code_similarity(s, d):
    return _similar(s, d)


@query(f"SELECT vec_id, similarity FROM (SELECT vec_id, {_SIM} AS similarity FROM embeddings) ORDER BY similarity DESC, vec_id LIMIT 10")
def turbo_topk(s, d):
    return _similar(s, d).orderBy(F.desc("similarity"), "vec_id").limit(10)


@query(f"SELECT vec_id, similarity FROM (SELECT vec_id, label, {_SIM} AS similarity FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 30) WHERE label IN (0, 1, 2)")
def search_turbo_path(s, d):
    top = _similar(s, d).orderBy(F.desc("similarity"), "vec_id").limit(30)
    return top.join(_vecs(s, d).filter(F.col("label").isin(0, 1, 2)).select(F.col("id").alias("vec_id")), "vec_id")


@query("SELECT doc_id, substring(trim(regexp_extract(text, '^\\s*([^.!?\\n]+[.!?]?)', 1), ' '), 1, 200) AS summary FROM documents WHERE text IS NOT NULL")
def summary_extract(s, d):
    return table(s, d, "documents").filter("text is not null").select("doc_id", text.summary(F.col("text")).alias("summary"))


_SUMMARY = f"SELECT sha256(content) AS h, min(nullif({_META.format('summary')}, '')) AS summary FROM records WHERE content IS NOT NULL GROUP BY 1"


@query(f"SELECT DISTINCT r.id, c.summary FROM records r JOIN ({_SUMMARY}) c ON c.h = sha256(r.content) WHERE c.summary IS NOT NULL")
def summary_exact_cache(s, d):
    r = table(s, d, "records").filter("content is not null").select("id", F.sha2("content", 256).alias("h"), F.get_json_object("metadata", "$.summary").alias("s"))
    cache = r.groupBy("h").agg(F.min(F.when(F.col("s") != "", F.col("s"))).alias("summary")).filter("summary is not null")
    return r.select("id", "h").distinct().join(cache, "h").select("id", "summary")


# -- lexical --------------------------------------------------------------------------------------------

_TOK = "list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+'), lambda t: octet_length(encode(t)) < 40)"
_POST = f"SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY ALL"


@query(_POST)
def postings_build(s, d):
    return lexical.postings(_docs(s, d))


@query(f"SELECT id, count(*) AS terms, sum(tf)::BIGINT AS places FROM ({_POST}) WHERE id NOT IN (SELECT doc_id FROM documents WHERE lang IS NULL) GROUP BY id")
def postings_delete(s, d):
    gone = table(s, d, "documents").filter("lang is null").select(F.col("doc_id").alias("id"))
    return store.delete(lexical.postings(_docs(s, d)), gone, ["id"]).groupBy("id").agg(F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("places"))


@query(f"SELECT doc_id, len({_TOK})::INT AS n, array_to_string({_TOK}[1:3], ' ') AS head FROM documents")
def tokenize(s, d):
    t = text.tokens(F.col("text"))
    return _docs(s, d).select(F.col("id").alias("doc_id"), F.size(t).alias("n"), F.array_join(F.slice(t, 1, 3), " ").alias("head"))


@query(f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM ({_POST}) GROUP BY term")
def term_stats(s, d):
    return lexical.term_stats(_docs(s, d))


@query(f"SELECT doc_id AS id, len({_TOK})::INT AS len FROM documents")
def doc_lengths(s, d):
    return lexical.doc_lengths(_docs(s, d))


def _bm25(source: str, words: list[str], tok: str = _TOK) -> str:
    each = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(words))
    dfs = ", ".join(f"sum((f{i} > 0)::INT) AS d{i}" for i in range(len(words)))
    score = " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / avg))" for i in range(len(words)))
    some = " OR ".join(f"f{i} > 0" for i in range(len(words)))
    return f"SELECT id, round({score}, 6) AS score FROM (SELECT id, len(t) AS len, {each} FROM (SELECT id, {tok} AS t FROM {source})) r, (SELECT count(*) AS n, avg(len) AS avg, {dfs} FROM (SELECT len(t) AS len, {each} FROM (SELECT {tok} AS t FROM {source}))) s WHERE {some}"


_DOCS = "(SELECT doc_id AS id, text FROM documents)"
_BM = _bm25(_DOCS, WORDS)


@query(f"SELECT * FROM ({_BM}) ORDER BY score DESC, id LIMIT 10")
def bm25_topk(s, d):
    return lexical.bm25(_docs(s, d), WORDS, 10)


@query(f"SELECT b.id, b.score FROM ({_bm25(_DOCS, ['retry', 'queue'])}) b JOIN documents x ON x.doc_id = b.id WHERE contains(' ' || array_to_string({_TOK}, ' ') || ' ', ' retry queue ') ORDER BY score DESC, id LIMIT 10")
def bm25_phrase(s, d):
    docs = _docs(s, d)
    hit = docs.filter(lexical.phrase(F.col("text"), ["retry", "queue"])).select("id")
    return lexical.bm25(docs, ["retry", "queue"]).join(hit, "id", "left_semi").orderBy(F.desc("score"), "id").limit(10)


@query(f"SELECT b.id, b.score FROM (SELECT * FROM ({_BM}) ORDER BY score DESC, id LIMIT 30) b JOIN documents x ON x.doc_id = b.id WHERE x.doc_kind IN ('adr', 'changelog') ORDER BY score DESC, id LIMIT 10")
def lexical_postfilter(s, d):
    top = lexical.bm25(_docs(s, d), WORDS, 10 * fusion.OVERSAMPLE)
    kinds = table(s, d, "documents").filter(F.col("doc_kind").isin("adr", "changelog")).select(F.col("doc_id").alias("id"))
    return top.join(kinds, "id", "left_semi").orderBy(F.desc("score"), "id").limit(10)


_LINES = "(SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1))::INT AS line_no FROM documents)"


@query(f"SELECT id, line_no, trim(regexp_replace(line, '\\r$', ''), ' ') AS line FROM {_LINES} WHERE contains(lower(line), 'rate limiter') ORDER BY id, line_no LIMIT 100")
def grep_lines(s, d):
    return lexical.grep(_docs(s, d), "rate limiter")


@query(f"SELECT id, line_no, trim(regexp_replace(line, '\\r$', ''), ' ') AS line FROM {_LINES} WHERE regexp_matches(line, '(INFO|WARN|ERROR) [0-9:]+') ORDER BY id, line_no LIMIT 100")
def grep_regex(s, d):
    return lexical.grep(_docs(s, d), "(INFO|WARN|ERROR) [0-9:]+", regex=True)


# Words of route registration.
KEYWORDS = ["HandleFunc", "mux.Handle", "app.GET", "app.POST", "router.Register", "Route(", "@app.route", "log.Printf", "tracing::debug"]
_KW = ", ".join(f"'{w}'" for w in KEYWORDS)


@query(f"""SELECT keyword, id, tf::INT AS tf, rank::INT AS rank FROM (SELECT keyword, id, tf, row_number() OVER (PARTITION BY keyword ORDER BY tf DESC, id) AS rank FROM
(SELECT id, keyword, (length(text) - length(replace(text, keyword, ''))) / length(keyword) AS tf FROM (SELECT id, min(content) AS text FROM code_chunks GROUP BY id), (SELECT unnest([{_KW}]) AS keyword)) WHERE tf > 0) WHERE rank <= 20""")
def multi_keyword_topk(s, d):
    return lexical.keyword_topk(table(s, d, "code_chunks").groupBy("id").agg(F.min("content").alias("text")), KEYWORDS, 20)


# -- fusion over records: text, vector and metadata in one row ----------------------------------------------

_USABLE = "len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(vector, lambda x: x <> 0)) > 0"
_REC = f"(SELECT id, min(content) AS text, min({_META.format('path')}) AS path, min({_META.format('project_id')}) AS project_id, min({_META.format('type')}) AS type FROM records GROUP BY id)"
_RV = f"(SELECT id, min(vector)::DOUBLE[] AS v FROM records WHERE {_USABLE} GROUP BY id)"
_RECBM = _bm25(_REC, WORDS)


def _hybrid_sql(k: int) -> str:
    return f"""SELECT id, round(coalesce(1.0 / (60 + ra), 0) + coalesce(1.0 / (60 + rb), 0), 8)::DOUBLE AS score FROM
(SELECT id, row_number() OVER (ORDER BY dist, id) AS ra FROM (SELECT id, round(list_distance(v, (SELECT v FROM {_RV} ORDER BY id LIMIT 1)), 6) AS dist FROM {_RV} ORDER BY dist, id LIMIT {3 * k})) a
FULL JOIN (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rb FROM (SELECT * FROM ({_RECBM}) ORDER BY score DESC, id LIMIT {3 * k})) b USING (id) ORDER BY score DESC, id LIMIT {k}"""


def _records(s, d):
    r = table(s, d, "records")
    f = lambda n: F.min(F.get_json_object("metadata", f"$.{n}")).alias(n)
    return r.groupBy("id").agg(F.min("content").alias("text"), f("path"), f("project_id"), f("type"))


def _record_vectors(s, d):
    r = table(s, d, "records")
    ok = (F.size("vector") == 64) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    return r.filter(ok).groupBy("id").agg(F.min("vector").alias("v"))


def _hybrid(s, d, k):
    v = _record_vectors(s, d)
    first = v.orderBy("id").first()
    near = fusion.ranked(vectors.nearest_to(v, list(first[1]) if first else [0.0] * 64, k * fusion.OVERSAMPLE), F.col("distance"), F.col("id"))
    found = fusion.ranked(lexical.bm25(_records(s, d).select("id", "text"), WORDS, k * fusion.OVERSAMPLE), F.desc("score"), F.col("id"))
    return fusion.rrf(near, found, k)


@query(f"""WITH v AS {_RV}, c AS (SELECT v, min(id) AS id FROM v GROUP BY v)
SELECT 'near' AS kind, id_a, id_b, round(s, 6) AS score FROM (SELECT a.id AS id_a, b.id AS id_b, list_cosine_similarity(a.v, b.v) AS s FROM c a JOIN c b ON a.id < b.id) WHERE s >= 0.9
UNION ALL SELECT 'copy', c.id, v.id, 1.0 FROM v JOIN c USING (v) WHERE v.id <> c.id""")
def near_dup_pairs(s, d):
    """All records against all, every partner at 0.9 or more: pairs of different vectors, and copies under the least id."""
    return vectors.similar(_record_vectors(s, d), 0.9)


@query(f"""WITH v AS {_RV} SELECT query_id, id, round(s, 6) AS score, 1 AS rank FROM (SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank FROM
(SELECT q.id AS query_id, e.id AS id, list_cosine_similarity(e.v, q.v) AS s FROM v e JOIN v q ON q.id <> e.id)) WHERE rank = 1 AND s > 0.98""")
def summary_semantic_cache(s, d):
    """The nearest other record of every record, if it is similar enough to share its summary."""
    return vectors.nearest_above(_record_vectors(s, d), 0.98)


@query(_hybrid_sql(10))
def hybrid_rrf(s, d):
    return _hybrid(s, d, 10)


_OVER = "round(len(list_intersect(['" + "', '".join(WORDS) + f"'], {_TOK})) / {float(len(WORDS))}, 6)"


@query(f"SELECT h.id, {_OVER} AS overlap FROM ({_hybrid_sql(30)}) h JOIN {_REC} r USING (id) WHERE contains(coalesce(path, ''), 'src') ORDER BY overlap DESC, h.score DESC, h.id LIMIT 10")
def search_vector(s, d):
    hits = _hybrid(s, d, 30).join(_records(s, d), "id").filter(F.contains(F.coalesce("path", F.lit("")), F.lit("src")))
    return hits.select("id", "score", fusion.overlap(WORDS, F.col("text")).alias("overlap")).orderBy(F.desc("overlap"), F.desc("score"), "id").limit(10).select("id", "overlap")


@query(f"SELECT b.id, {_OVER} AS overlap FROM (SELECT * FROM ({_BM}) ORDER BY score DESC, id LIMIT 30) b JOIN documents x ON x.doc_id = b.id ORDER BY overlap DESC, score DESC, b.id LIMIT 10")
def rerank_overlap(s, d):
    top = lexical.bm25(_docs(s, d), WORDS, 30).join(_docs(s, d), "id")
    return top.select("id", "score", fusion.overlap(WORDS, F.col("text")).alias("overlap")).orderBy(F.desc("overlap"), F.desc("score"), "id").limit(10).select("id", "overlap")


@query(f"SELECT h.id, h.score FROM ({_hybrid_sql(30)}) h JOIN {_REC} r USING (id) WHERE type = 'manual_context' ORDER BY score DESC, id LIMIT 5")
def search_docs_only(s, d):
    docs = _records(s, d).filter("type = 'manual_context'").select("id")
    return _hybrid(s, d, 30).join(docs, "id", "left_semi").orderBy(F.desc("score"), "id").limit(5)


@query(f"""SELECT doc_id, source, cum::BIGINT AS cum FROM (SELECT doc_id, source, sum(n) OVER w AS cum, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn
FROM (SELECT doc_id, source, len({_TOK}) AS n FROM documents) WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) WHERE cum <= 10000 OR rn = 1""")
def token_budget(s, d):
    t = table(s, d, "documents").select("doc_id", "source", F.size(text.tokens(F.col("text"))).alias("n"))
    return fusion.within_budget(t, F.col("n"), 10_000, ["source"], F.col("doc_id")).select("doc_id", "source", "cum")


@query(f"SELECT id, project_id FROM {_REC} WHERE project_id IN (SELECT project_id FROM code_files WHERE path LIKE '%.go')")
def cross_project(s, d):
    p = table(s, d, "code_files").filter("path like '%.go'").select("project_id")
    return _records(s, d).select("id", "project_id").join(p, "project_id", "left_semi").select("id", "project_id")


# -- analytics ------------------------------------------------------------------------------------------------


def _dead_sql(where: str) -> str:
    return f"""WITH c AS (SELECT * FROM code_chunks WHERE NOT contains(path, 'test') AND NOT contains(path, 'spec') {where}), u AS (SELECT DISTINCT unnest(calls) AS call FROM c)
SELECT symbol, max(path) AS path FROM (SELECT unnest(symbols) AS symbol, path FROM c) WHERE symbol NOT IN (SELECT call FROM u WHERE call IS NOT NULL) AND string_split(symbol, '.')[-1] NOT IN (SELECT call FROM u WHERE call IS NOT NULL) GROUP BY symbol"""


@query(_dead_sql(""))
def dead_symbols(s, d):
    return analysis.dead_symbols(table(s, d, "code_chunks"))


@query(_dead_sql("AND (contains(path, 'internal') OR contains(path, 'private'))"))
def dead_symbols_library(s, d):
    return analysis.dead_symbols(table(s, d, "code_chunks"), library=True)


@query("""WITH t AS (SELECT * FROM code_chunks WHERE contains(path, 'test') OR contains(path, 'spec')), n AS (SELECT unnest(list_concat(symbols, calls)) AS s FROM t)
SELECT symbol, max(path) AS path FROM (SELECT unnest(symbols) AS symbol, path FROM code_chunks WHERE NOT contains(path, 'test') AND NOT contains(path, 'spec')) WHERE symbol NOT IN (SELECT s FROM n WHERE s IS NOT NULL) GROUP BY symbol""")
def missing_tests(s, d):
    return analysis.missing_tests(table(s, d, "code_chunks"))


@query("""SELECT state, count(*) AS files, coalesce(sum(n), 0)::BIGINT AS chunks FROM (SELECT CASE WHEN i.n IS NULL THEN 'missing' WHEN f.f IS NULL THEN 'deleted' WHEN f.mtime > i.at THEN 'modified' ELSE 'same' END AS state, i.n
FROM (SELECT project_id, path, max(updated_at) AS mtime, 1 AS f FROM code_files GROUP BY ALL) f FULL JOIN (SELECT project_id, path, max(updated_at) AS at, count(*) AS n FROM code_chunks GROUP BY ALL) i USING (project_id, path)) GROUP BY state""")
def sync_diff(s, d):
    return analysis.sync_diff(table(s, d, "code_files").withColumnRenamed("updated_at", "mtime"), table(s, d, "code_chunks"), ["project_id", "path"])


@query(f"""SELECT package, array_to_string(list_sort(list(DISTINCT path)), '|') AS files FROM (SELECT path, unnest({_GO_SQL}) AS package FROM code_files WHERE path LIKE '%.go') WHERE contains(package, '.')
AND package NOT IN ('state.example/slot') GROUP BY package""")
def undeclared_deps(s, d):
    imports = table(s, d, "code_files").filter("path like '%.go'").select("path", F.explode(code.imports_go(F.col("content"))).alias("dep"))
    return analysis.undeclared(imports, ["state.example/slot"], "go").select("package", F.array_join("files", "|").alias("files"))


_EDGE = """SELECT DISTINCT CASE WHEN len(p) > 2 AND p[1] IN ('apps', 'packages') THEN p[1] || '/' || p[2] ELSE p[1] END AS src, dst FROM (SELECT string_split(path, '/') AS p, unnest(relationships) AS dst FROM code_chunks) WHERE len(p) >= 2"""


@query(_EDGE)
def package_edges(s, d):
    return analysis.package_edges(table(s, d, "code_chunks"))


@query(f"SELECT '    \"' || src || '\" --> \"' || dst || '\"' AS line FROM ({_EDGE})")
def package_mermaid(s, d):
    return package_edges(s, d).select(F.concat(F.lit('    "'), "src", F.lit('" --> "'), "dst", F.lit('"')).alias("line"))


@query("""SELECT doc_id, h AS content_hash, n AS copies FROM (SELECT doc_id, h, count(*) OVER (PARTITION BY h) AS n FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE text <> '')) WHERE n > 1""")
def duplicates_of(s, d):
    f = table(s, d, "documents").filter("text <> ''").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    n = f.groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return f.join(n, "content_hash").select("doc_id", "content_hash", "copies")


@query("""WITH f AS (SELECT DISTINCT id, path, symbols, relationships FROM code_chunks WHERE path = (SELECT min(path) FROM code_chunks WHERE path LIKE '%.ts')), r AS (SELECT DISTINCT unnest(relationships) AS dep FROM f),
y AS (SELECT DISTINCT unnest(symbols) AS symbol FROM f)
SELECT 'file' AS section, id FROM f UNION SELECT 'dependency', c.id FROM code_chunks c JOIN r ON contains(c.path, regexp_replace(r.dep, '^[./@]+', '')) AND regexp_replace(r.dep, '^[./@]+', '') <> '' WHERE c.path NOT IN (SELECT path FROM f)
UNION SELECT 'symbol', c.id FROM (SELECT id, path, unnest(calls) AS call FROM code_chunks) c JOIN y ON y.symbol = c.call WHERE c.path NOT IN (SELECT path FROM f)""")
def related_context(s, d):
    c = table(s, d, "code_chunks").select("id", "path", "symbols", "calls", "relationships")
    path = (c.filter("path like '%.ts'").agg(F.min("path")).first() or [None])[0]
    f = c.filter(F.col("path") == F.lit(path))
    other = c.filter(F.col("path") != F.lit(path))
    deps = f.select(F.explode("relationships").alias("dep")).select(F.regexp_replace("dep", r"^[./@]+", "").alias("dep")).filter("dep <> ''").distinct()
    # the imports and symbols of one file: a bounded list, set out as predicates
    names = [r[0] for r in deps.collect()]
    near = F.lit(False)
    for n in names:
        near = near | F.contains("path", F.lit(n))
    calls = other.select("id", F.explode("calls").alias("symbol")).join(F.broadcast(f.select(F.explode("symbols").alias("symbol")).distinct()), "symbol", "left_semi")
    return f.select(F.lit("file").alias("section"), "id").unionByName(other.filter(near).select(F.lit("dependency").alias("section"), "id")).unionByName(calls.select(F.lit("symbol").alias("section"), "id")).distinct()


@query(f"SELECT h.id, coalesce(nullif(type, ''), 'code') AS category, path FROM ({_hybrid_sql(10)}) h JOIN {_REC} r USING (id)")
def impl_gap(s, d):
    return _hybrid(s, d, 10).join(_records(s, d), "id").select("id", F.coalesce(F.nullif("type", F.lit("")), F.lit("code")).alias("category"), "path")


@query(f"""SELECT substring(trim(regexp_extract(t, '^\\s*([^.!?\\n]+[.!?]?)', 1), ' '), 1, 200) AS summary, n FROM (SELECT string_agg(text, chr(10) || '---' || chr(10) ORDER BY score DESC, id) AS t, count(*)::INT AS n
FROM ({_hybrid_sql(5)}) h JOIN {_REC} r USING (id) WHERE text IS NOT NULL) WHERE n > 0""")
def summarized_context(s, d):
    """The texts of the five best hits, joined and summarised."""
    hits = _hybrid(s, d, 5).join(_records(s, d), "id").filter("text is not null")
    # five rows at most
    joined = hits.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "id", "text"))).alias("l"), F.count(F.lit(1)).cast("int").alias("n")).filter("n > 0")
    return joined.select(text.summary(F.array_join(F.transform("l", lambda e: e["text"]), "\n---\n")).alias("summary"), "n")


@query("""SELECT symbol, id, path FROM (SELECT symbol, id, path, row_number() OVER (PARTITION BY symbol ORDER BY path, id) AS rn FROM (SELECT DISTINCT unnest(symbols) AS symbol, id, path FROM code_chunks)) WHERE rn = 1""")
def entity_lookup(s, d):
    e = table(s, d, "code_chunks").select(F.explode("symbols").alias("symbol"), "path", "id")
    return e.groupBy("symbol").agg(F.min(F.struct("path", "id")).alias("m")).select("symbol", "m.id", "m.path")


@query("""WITH c AS (SELECT project_id, path, symbols, string_split(path, '/') AS p FROM code_chunks), k AS (SELECT project_id, path, symbols, CASE WHEN len(p) > 2 AND p[1] IN ('apps', 'packages') THEN p[1] || '/' || p[2] ELSE p[1] END AS package FROM c WHERE len(p) >= 2)
SELECT f.project_id, f.package, n_files, coalesce(n_symbols, 0) AS n_symbols, first_symbol, last_symbol FROM (SELECT project_id, package, count(DISTINCT path) AS n_files FROM k GROUP BY ALL) f
LEFT JOIN (SELECT project_id, package, count(DISTINCT s) AS n_symbols, min(s) AS first_symbol, max(s) AS last_symbol FROM (SELECT project_id, package, unnest(symbols) AS s FROM k) WHERE s IS NOT NULL GROUP BY ALL) n USING (project_id, package)""")
def package_summary(s, d):
    return analysis.package_summary(table(s, d, "code_chunks"))


def _joined_sql(key: str, order: str, separator: str, rows: str) -> str:
    return f"""SELECT {key}, part, md5(string_agg(t, {separator} ORDER BY {order})) AS digest, count(*)::INT AS texts FROM
(SELECT *, ((sum(length(t) + length({separator})) OVER (PARTITION BY {key} ORDER BY {order} ROWS UNBOUNDED PRECEDING) - length(t) - length({separator})) // {analysis.PART})::INT AS part FROM ({rows})) GROUP BY {key}, part"""


@query(_joined_sql("project_id, path", "id, content", "chr(10)", "SELECT DISTINCT project_id, path, id, content, 'File: ' || path || chr(10) || 'Content: ' || content || chr(10) || '---' AS t FROM code_chunks WHERE content IS NOT NULL"))
def knowledge_concat(s, d):
    c = table(s, d, "code_chunks").select("project_id", "path", "id", "content").distinct()
    t = F.concat(F.lit("File: "), "path", F.lit("\nContent: "), "content", F.lit("\n---"))
    return analysis.joined_text(c, ["project_id", "path"], ["id", "content"], t, "\n").select("project_id", "path", "part", F.md5("text").alias("digest"), "texts")


@query(_joined_sql("project_id", "id, t", "chr(10) || '---' || chr(10)", f"SELECT DISTINCT id, {_META.format('project_id')} AS project_id, content AS t FROM records WHERE {_META.format('type')} = 'manual_context' AND content IS NOT NULL"))
def context_join(s, d):
    joined = analysis.joined_text(project_context(s, d), ["project_id"], ["id", "text"], F.col("text"), "\n---\n")
    return joined.select("project_id", "part", F.md5("text").alias("digest"), "texts")


# one literal rule beside those of the table, so that some file breaks one
_RULE = ("rule-0", "Loops use no slice and no filter. Forbidden: split")


@query(f"""SELECT DISTINCT c.path, c.dep, r.id AS rule_id FROM (SELECT DISTINCT path, unnest(calls) AS dep FROM code_chunks) c JOIN (SELECT id, text FROM {_REC} WHERE type = 'distilled_summary' UNION ALL SELECT '{_RULE[0]}', '{_RULE[1]}') r ON c.dep <> ''
AND (contains(lower(r.text), 'no ' || lower(c.dep)) OR contains(lower(r.text), 'forbidden: ' || lower(c.dep)))""")
def rule_violations(s, d):
    c = table(s, d, "code_chunks").select("path", F.col("calls").alias("relationships"))
    rules = _records(s, d).filter("type = 'distilled_summary'").select(F.col("id").alias("rule_id"), "text").unionByName(s.createDataFrame([_RULE], "rule_id string, text string"))
    return analysis.rule_violations(c, rules)


@query("""SELECT DISTINCT dep, parent FROM (SELECT unnest(relationships) AS dep, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent FROM code_chunks)""")
def dependent_packages(s, d):
    return table(s, d, "code_chunks").select(F.explode("relationships").alias("dep"), code.parent(F.col("path")).alias("parent")).distinct()


# -- graph ------------------------------------------------------------------------------------------------------

_NAMED = "name IS NOT NULL AND trim(name, ' ') <> ''"
_MEMBERS = f"(SELECT DISTINCT id, split_part(k, ':', 1) AS kind, regexp_replace(k, '^[^:]*:', '') AS member FROM (SELECT id, unnest(json_keys(structural_metadata)) AS k FROM graph_records WHERE {_NAMED} AND json_valid(structural_metadata)) WHERE contains(k, ':'))"
# literal entities beside the table's, with an interface that one of two types satisfies
_LITERAL = [("lit-1", "Store", "interface_type", '{"method:get": "()", "method:put": "(v)"}'), ("lit-2", "MemStore", "struct_type", '{"method:get": "()", "method:put": "(v)", "method:close": "()"}'), ("lit-3", "HalfStore", "class_declaration", '{"method:get": "()"}')]
_ALL_NODES = "(SELECT id, name, node_type, structural_metadata FROM graph_records UNION ALL SELECT * FROM (VALUES " + ", ".join(str(r) for r in _LITERAL) + "))"
_ALL_MEMBERS = _MEMBERS.replace("graph_records", _ALL_NODES)


def _all_nodes(s, d):
    g = table(s, d, "graph_records").select("id", "name", "node_type", "structural_metadata")
    return g.unionByName(s.createDataFrame(_LITERAL, "id string, name string, node_type string, structural_metadata string"))


_T, _I = ", ".join(f"'{t}'" for t in graph.TYPES), ", ".join(f"'{t}'" for t in graph.INTERFACES)


@query(f"SELECT id, count(*) AS versions FROM (SELECT DISTINCT id, name, node_type, path FROM graph_records WHERE {_NAMED}) GROUP BY id")
def graph_nodes(s, d):
    g = table(s, d, "graph_records").filter("name is not null and trim(name) <> ''").select("id", "name", "node_type", "path").distinct()
    return g.groupBy("id").agg(F.count(F.lit(1)).alias("versions"))


@query(f"SELECT id, kind, member FROM {_MEMBERS}")
def graph_members(s, d):
    return graph.members(table(s, d, "graph_records"))


def _implements_sql(t: str, i: str) -> str:
    return f"""WITH m AS (SELECT id, member FROM {_ALL_MEMBERS} WHERE kind = 'method'), k AS (SELECT DISTINCT id, node_type FROM {_ALL_NODES}),
t AS (SELECT * FROM m WHERE id IN (SELECT id FROM k WHERE node_type IN ({t}))), i AS (SELECT * FROM m WHERE id IN (SELECT id FROM k WHERE node_type IN ({i})))
SELECT type_id, h.interface_id FROM (SELECT t.id AS type_id, i.id AS interface_id, count(*) AS have FROM t JOIN i USING (member) GROUP BY ALL) h JOIN (SELECT id AS interface_id, count(*) AS need FROM i GROUP BY 1) n USING (interface_id) WHERE have = need AND type_id <> h.interface_id"""


@query(_implements_sql(_T, _I))
def implements(s, d):
    return graph.implements(_all_nodes(s, d))


@query(_implements_sql(_T, _T))
def implementations_of(s, d):
    """Types with all methods of another type: the division where types stand in for interfaces."""
    return graph.implements(_all_nodes(s, d), graph.TYPES, graph.TYPES)


@query(f"SELECT member AS field, count(*) AS users FROM {_MEMBERS} WHERE kind = 'field' GROUP BY 1")
def field_usage(s, d):
    return graph.members(table(s, d, "graph_records")).filter("kind = 'field'").groupBy(F.col("member").alias("field")).agg(F.count(F.lit(1)).alias("users"))


@query("SELECT DISTINCT id, name FROM graph_records WHERE contains(lower(name), 'vector')")
def name_search(s, d):
    return table(s, d, "graph_records").filter(F.contains(F.lower("name"), F.lit("vector"))).select("id", "name").distinct()


@query("SELECT DISTINCT id, name, node_type, path FROM graph_records WHERE contains(lower(name), 'vector') ORDER BY name, id, node_type, path LIMIT 20")
def graph_search(s, d):
    return table(s, d, "graph_records").filter(F.contains(F.lower("name"), F.lit("vector"))).select("id", "name", "node_type", "path").distinct().orderBy("name", "id", "node_type", "path").limit(20)


@query(f"SELECT DISTINCT m.member AS field, m.id, g.docstring FROM {_MEMBERS} m JOIN graph_records g ON g.id = m.id WHERE m.kind = 'field' AND m.member = 'key'")
def trace_field(s, d):
    g = table(s, d, "graph_records")
    return graph.members(g).filter("kind = 'field' and member = 'key'").join(g.select("id", "docstring"), "id").select(F.col("member").alias("field"), "id", "docstring").distinct()


# -- changes ------------------------------------------------------------------------------------------------------

_OK = "kind IN ('modify', 'create') AND regexp_extract(path, '\\.([^./]+)$', 1) IN ('go','rs','js','ts','tsx','php','py','md') AND NOT regexp_matches('/' || path, '/(node_modules|dist|build|\\.next|generated/prisma|target)/')"


@query(f"SELECT event_id, project_id, path, kind FROM fs_events WHERE {_OK}")
def cdc_filter(s, d):
    return table(s, d, "fs_events").filter(stream.is_interesting(F.col("kind"), F.col("path"))).select("event_id", "project_id", "path", "kind")


def _burst_sql(table_: str, key: str, gap_us: int, names: tuple[str, str]) -> str:
    return f"""SELECT {key}, min(ts) AS {names[0]}, max(ts) AS {names[1]}, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY {key} ORDER BY ts RANGE UNBOUNDED PRECEDING) AS b FROM
(SELECT {key}, ts, CASE WHEN lag(ts) OVER (PARTITION BY {key} ORDER BY ts) IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY {key} ORDER BY ts)) > {gap_us} THEN 1 ELSE 0 END AS fresh FROM {table_})) GROUP BY {key}, b"""


@query(_burst_sql("(SELECT DISTINCT event_id, project_id, path, ts FROM fs_events WHERE path IS NOT NULL)", "project_id, path", 500_000, ("first_ts", "last_ts")))
def debounce(s, d):
    e = table(s, d, "fs_events").filter("path is not null").select("event_id", "project_id", "path", "ts").distinct()
    return stream.debounce(e, ["project_id", "path"])


@query("""WITH l AS (SELECT project_id, path, arg_max(kind, (ts, event_id)) AS kind FROM fs_events WHERE path IS NOT NULL AND kind IS NOT NULL GROUP BY ALL)
SELECT DISTINCT project_id, path, 'old' AS state FROM code_chunks c WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.project_id = c.project_id AND l.path = c.path)
UNION ALL SELECT DISTINCT project_id, path, 'new' FROM code_files f WHERE EXISTS (SELECT 1 FROM l WHERE l.project_id = f.project_id AND l.path = f.path AND kind <> 'remove')""")
def cdc_apply(s, d):
    rows = table(s, d, "code_chunks").select("project_id", "path").distinct().withColumn("state", F.lit("old"))
    fresh = table(s, d, "code_files").select("project_id", "path").distinct().withColumn("state", F.lit("new"))
    return stream.apply_changes(rows, table(s, d, "fs_events"), fresh, ["project_id", "path"])


@query("""SELECT event_id, user_id, batch_start, ((row_number() OVER (PARTITION BY user_id, batch_start ORDER BY event_id) - 1) // 10)::INT AS batch_no FROM (SELECT event_id, user_id, time_bucket(INTERVAL 5 SECOND, ts, TIMESTAMP '1970-01-01') AS batch_start FROM events)""")
def microbatch_assign(s, d):
    b = stream.micro_batches(table(s, d, "events").select("event_id", "user_id", "ts"), "ts", ["event_id"], key=["user_id"])
    return b.select("event_id", "user_id", F.col("batch_start").cast("timestamp_ntz").alias("batch_start"), "batch_no")


@query()
def token_bucket(s, d):
    return stream.token_bucket(table(s, d, "events"), "user_id", "ts", "event_id")


@query(_burst_sql("(SELECT user_id, ts FROM events)", "user_id", 600_000_000, ("session_start", "session_end")))
def idle_sessions(s, d):
    return stream.idle_sessions(table(s, d, "events").select("user_id", "ts"), ["user_id"])


# -- edits ----------------------------------------------------------------------------------------------------------


@query("""SELECT DISTINCT project_id, path, md5(CASE WHEN strpos(content, 'return') > 0 THEN substring(content, 1, strpos(content, 'return') - 1) || 'yield' || substring(content, strpos(content, 'return') + 6) ELSE content END) AS digest FROM code_files""")
def patch_first(s, d):
    return table(s, d, "code_files").select("project_id", "path", F.md5(code.patch_first(F.col("content"), F.lit("return"), F.lit("yield"))).alias("digest")).distinct()


@query("SELECT DISTINCT project_id, path, contains(content, 'return') AS applicable FROM code_files")
def patch_applicable(s, d):
    return table(s, d, "code_files").select("project_id", "path", F.contains("content", F.lit("return")).alias("applicable")).distinct()


@query("SELECT DISTINCT path, NOT starts_with(path, '/') AND len(list_filter(string_split(path, '/'), lambda p: p NOT IN ('', '.'))) <= 20 AND NOT starts_with(path, '..') AS allowed FROM code_files")
def path_guard(s, d):
    return table(s, d, "code_files").select("path", code.path_allowed(F.col("path")).alias("allowed")).distinct()
