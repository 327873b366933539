"""Fusion of ranked lists, reranking and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .ordered import running

RRF, OVERSAMPLE = 60, 3


def rrf(left: DataFrame, right: DataFrame, k: int, constant: int = RRF) -> DataFrame:
    """(id, score): reciprocal-rank fusion of two lists (id, rank); an id in one list alone counts once.

    The lists are top-k results, so the join and the sort are of a fixed size.
    """
    a, b = left.select("id", F.col("rank").alias("ra")), right.select("id", F.col("rank").alias("rb"))
    both = a.join(b, "id", "full_outer")
    score = F.coalesce(1.0 / (constant + F.col("ra")), F.lit(0.0)) + F.coalesce(1.0 / (constant + F.col("rb")), F.lit(0.0))
    return both.select("id", F.round(score, 8).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def ranked(hits: DataFrame, *order: Column) -> DataFrame:
    """Adds ``rank`` from 1 to a short result."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def overlap(query: list[str], text: Column) -> Column:
    """Part of the query's terms that a text holds: the reranker used where no model is given."""
    q = F.array(*[F.lit(w) for w in dict.fromkeys(query)])
    return F.round(F.size(F.array_intersect(q, tokens(text))) / F.size(q), 6)


def within_budget(hits: DataFrame, size: Column, most: int, group: list[str], *order: Column) -> DataFrame:
    """Rows while their sizes add up to at most ``most`` in each group; the first always stays. Groups may have any size."""
    return running(hits, group, size, *order).filter((F.col("cum") <= most) | (F.col("rn") == 1))
