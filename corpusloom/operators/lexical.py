"""Inverted index, BM25, phrases and grep over documents (id, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import spread

K1, B = 1.2, 0.75


def postings(docs: DataFrame) -> DataFrame:
    """(id, term, tf)."""
    return spread(docs).select("id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_stats(docs: DataFrame) -> DataFrame:
    """(term, df, cf): documents and places of every term."""
    return postings(docs).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def doc_lengths(docs: DataFrame) -> DataFrame:
    """(id, len): tokens of every document, those without any included."""
    return docs.select("id", F.size(tokens(F.col("text"))).alias("len"))


def bm25(docs: DataFrame, terms: list[str], k: int | None = None) -> DataFrame:
    """(id, score): documents with any of the terms, best first; ties by id.

    Texts are split once: what leaves the scan is an id, a length and a few counts, and that one small exchange
    serves both the statistics, which are one row, and the scores. Documents have ids that are not null.
    """
    terms = list(dict.fromkeys(terms))
    toks = spread(docs).select("id", tokens(F.col("text")).alias("t"))
    counts = [(F.size("t") - F.size(F.array_remove("t", w))).alias(f"_{i}") for i, w in enumerate(terms)]
    rows = toks.select("id", F.size("t").alias("len"), *counts).repartition("id")
    stats = rows.agg(F.count("id").alias("n"), F.avg("len").alias("avg"), *[F.sum((F.col(f"_{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(terms))])
    both = rows.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf = F.col(f"_{i}").cast("double")
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg")))).otherwise(0.0)
    # any term makes the score positive; asked here, the filter stays above the shared exchange
    out = both.withColumn("_s", score).filter("_s > 0").select("id", F.round("_s", 6).alias("score"))
    return out if k is None else out.orderBy(F.desc("score"), "id").limit(k)


def phrase(text: Column, words: list[str]) -> Column:
    """Whether the words follow one another."""
    return F.instr(F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" ")), " " + " ".join(words) + " ") > 0


def grep(docs: DataFrame, needle: str, regex: bool = False, limit: int | None = 100) -> DataFrame:
    """(id, line_no, line): lines with a text in any case, or a pattern, trimmed; the first ``limit`` by place."""
    lines = docs.filter("text is not null").select("id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    hit = lines.filter(F.col("line").rlike(needle) if regex else F.contains(F.lower("line"), F.lit(needle.lower())))
    out = hit.select("id", (F.col("line_no") + 1).alias("line_no"), F.trim(F.regexp_replace("line", "\r$", "")).alias("line"))
    return out if limit is None else out.orderBy("id", "line_no").limit(limit)


def keyword_topk(docs: DataFrame, keywords: list[str], k: int = 20) -> DataFrame:
    """(keyword, id, tf, rank): for each keyword the k documents that hold it most often; ties by id."""
    each = F.array(*[F.struct(F.lit(w).alias("keyword"), ((F.length("text") - F.length(F.replace("text", F.lit(w), F.lit("")))) / len(w)).cast("int").alias("tf")) for w in keywords])
    hits = docs.filter("text is not null").select("id", F.explode(each).alias("e")).select("id", "e.keyword", "e.tf").filter("tf > 0")
    w = Window.partitionBy("keyword").orderBy(F.desc("tf"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
