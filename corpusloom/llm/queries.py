"""The pN_ queries, each over its whole tables, and the SQL that some can be compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import credentials, docpairs, handwritten, language, leakage, neardup, neighbours, packing, splitting, syntax


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, d, "code_files"))


def p1_labels(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.labels(table(spark, d, "code_files"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(table(spark, d, "code_chunks"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_chunks(table(spark, d, "code_chunks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.documented(table(spark, d, "graph_records"), table(spark, d, "code_chunks"))


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.pairs(table(spark, d, "graph_records"), table(spark, d, "code_chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(table(spark, d, "records"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(table(spark, d, "records"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid(table(spark, d, "code_files"))


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(table(spark, d, "code_files"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.close_pairs(table(spark, d, "records"))


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(table(spark, d, "records"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.lines({n: table(spark, d, n) for n in ("code_chunks", "records")})


def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redacted({n: table(spark, d, n) for n in ("code_chunks", "records")})


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_report(packing.pack(table(spark, d, "documents")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return language.mislabelled(table(spark, d, "documents"), table(spark, d, "lang_samples"))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.segments(table(spark, d, "documents"), table(spark, d, "lang_samples"))


def p10_documents(spark: SparkSession, d: str) -> DataFrame:
    return language.document_languages(table(spark, d, "documents"), table(spark, d, "lang_samples"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": """
WITH u AS (SELECT id, min(vector) AS v FROM records
           WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(vector, lambda x: x <> 0)) > 0
           GROUP BY id),
p AS (SELECT a.id AS i, b.id AS j, list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]) AS s FROM u a JOIN u b ON a.id <> b.id),
r AS (SELECT i, j, s, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS k FROM p)
SELECT DISTINCT least(i, j) AS id_a, greatest(i, j) AS id_b FROM r WHERE k <= 5 AND s >= 0.8""",
        "p4_found": r"""
WITH t AS (SELECT DISTINCT id, regexp_extract_all(lower(CASE WHEN regexp_matches(coalesce(content, ''), '\S') THEN content ELSE json_extract_string(metadata, '$.summary') END), '[\p{L}\p{N}]+') AS w
           FROM records WHERE metadata IS NULL OR json_valid(metadata) OR regexp_matches(coalesce(content, ''), '\S')),
s AS (SELECT DISTINCT id, hash(w) AS h, array_to_string(w[k : k + 2], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS k FROM t)),
n AS (SELECT id, h, count(*) AS c FROM s GROUP BY id, h),
p AS (SELECT a.id AS i, a.h AS x, b.id AS j, b.h AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT DISTINCT i AS id_a, j AS id_b FROM p JOIN n u ON u.id = i AND u.h = x JOIN n v ON v.id = j AND v.h = y
WHERE k >= 0.7 * (u.c + v.c - k) - 1e-9""",
        "p9_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(nfc_normalize(text), '[\x{AD}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}]', '', 'g')), '[\p{L}\p{N}]+') AS w FROM documents),
e AS (SELECT item_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+') AS w FROM eval_items),
ng AS (SELECT item_id, array_to_string(w[k : k + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS k FROM e)),
dg AS (SELECT doc_id, array_to_string(w[k : k + 9], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS k FROM d))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ng USING (g)""",
        "p2_found": "SELECT DISTINCT id FROM code_chunks WHERE length(content) > 3000",
    }
