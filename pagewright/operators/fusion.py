"""Rank fusion, union of sub-queries, canonical copies, reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_rank, section_matches, signature

RRF_K = 60


def fetch_size(count: int, top_k: int = 8, rerank: int = 30) -> int:
    return min(count, max(top_k * 6, rerank * 2, 40))


def reciprocal_ranks(dense: DataFrame, lexical: DataFrame, k: int = RRF_K) -> DataFrame:
    """query_id, id, distance (null if only lexical), rrf (9 digits): sum of 1 / (k + rank) over the channels, ranks from 0."""
    part = lambda r: F.coalesce(1 / (F.lit(float(k)) + F.col(r)), F.lit(0.0))
    both = dense.select("query_id", "id", "distance", F.col("rank").alias("d")).join(lexical.select("query_id", "id", F.col("rank").alias("l")), ["query_id", "id"], "full_outer")
    return both.select("query_id", "id", "distance", F.round(part("d") + part("l"), 9).alias("rrf"))


def canonical_best(items: DataFrame, text: Column, source: Column, preferred: list[str], keys: list[str] = ("query_id",)) -> DataFrame:
    """Of items with equal signatures the one of the most preferred source, then of the best rrf, then of the smallest id."""
    order = Window.partitionBy(*keys, "__sig").orderBy("__canon", F.desc("rrf"), "id")
    rows = items.withColumns({"__sig": signature(text), "__canon": canonical_rank(source, list(preferred))})
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__sig", "__canon", "__n")


def best(items: DataFrame, limit: int, keys: list[str] = ("query_id",), score: str = "rrf") -> DataFrame:
    """The items with the largest scores of each query, with place (from 1)."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), "id")
    return items.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def union_best(items: DataFrame) -> DataFrame:
    """Over the sub-queries of a question (question_id) each id once, with its largest rrf and that one's distance."""
    top = F.max_by(F.struct("distance", "rrf"), F.struct("rrf", -F.col("query_id"))).alias("x")
    return items.groupBy("question_id", "id").agg(top).select("question_id", "id", "x.distance", "x.rrf")


def filtered_section(items: DataFrame, section: str, glob: str | None) -> DataFrame:
    """Items whose section matches; meant after the union and before reranking."""
    return items.where(section_matches(F.col(section), glob))


def overlap_scores(question: Column, text: Column) -> Column:
    """Stand-in reranker: share of the question's distinct tokens that the first 2000 characters hold."""
    from ..functions.text import tokens

    asked = F.array_distinct(tokens(question))
    held = F.size(F.array_intersect(asked, tokens(F.substring(text, 1, 2000))))
    return F.when(F.size(asked) > 0, F.round(held / F.size(asked), 6)).otherwise(0.0)


def rerank(items: DataFrame, score: Column, top_k: int, key: str = "question_id", candidates: int = 30) -> DataFrame:
    """The best fused candidates by a reranker's score; ties and null scores keep the fused order."""
    cut = best(items, candidates, (key,))
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last("rerank_score"), "place")
    return cut.withColumn("rerank_score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
