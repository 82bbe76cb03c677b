"""Retrieval for many queries at once: lexical and dense top-k, fusion, caps, gates, carry-over.

A ranking is a DataFrame with a query column, a key column and a rank from 1. All tie-breaks are explicit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import vectors

K1, B, RRF_K = 1.5, 0.75, 60


def query_terms(queries: DataFrame, key: str, tokens: Column) -> DataFrame:
    """key, term: distinct terms of each query."""
    return queries.select(key, F.explode(F.array_distinct(tokens)).alias("term"))


def top_k(scored: DataFrame, query: str, key: str, k: int, score: str = "score") -> DataFrame:
    """Adds rank; the k best of each query, ties by key."""
    by = Window.partitionBy(query).orderBy(F.desc(score), key)
    return scored.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def dense_scores(queries: DataFrame, chunks: DataFrame, query: str, key: str) -> DataFrame:
    """query, key, score: exact cosine of every query vector `qv` with every chunk vector `cv`. Each query is compared
    with all chunks by design; Spark sends a small query side to the chunks and deals out blocks of a large one.
    Lengths are worked out once a vector, not once a pair."""
    asked = queries.select(query, "qv", vectors.length(F.col("qv")).alias("_qn"))
    held = chunks.select(key, "cv", vectors.length(F.col("cv")).alias("_cn"))
    return held.crossJoin(asked).select(query, key, F.round(vectors.dot(F.col("qv"), F.col("cv")) / (F.col("_qn") * F.col("_cn")), 6).alias("score"))


def best_of_variants(hits: DataFrame, query: str, key: str) -> DataFrame:
    """Best score of a key over a query's variants (`variant`: their order); the first variant wins ties."""
    return hits.groupBy(query, key).agg(F.max("score").alias("score"), F.max_by("variant", F.struct(F.col("score"), -F.col("variant"))).alias("variant"))


def fused(lists: DataFrame, query: str, key: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of `lists` (query, list_no, rank, key): query, key, score (rounded to 9), rank. Ties keep
    the order in which keys first appear."""
    summed = lists.groupBy(query, key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.min(F.struct("list_no", "rank")).alias("seen"))
    by = Window.partitionBy(query).orderBy(F.desc("score"), "seen", key)
    return summed.withColumn("rank", F.row_number().over(by)).drop("seen")


def capped(ranked: DataFrame, query: str, group: str, per_group: int, limit: int) -> DataFrame:
    """The first `per_group` of each group in rank order (0: all), then the first `limit`; ranks are renewed."""
    inner, outer = Window.partitionBy(query, group).orderBy("rank"), Window.partitionBy(query).orderBy("rank")
    kept = ranked if per_group <= 0 else ranked.withColumn("_in", F.row_number().over(inner)).filter(F.col("_in") <= per_group).drop("_in")
    return kept.withColumn("rank", F.row_number().over(outer)).filter(F.col("rank") <= limit)


def gate_each(reranked: DataFrame, threshold: float, score: str = "rerank_score") -> DataFrame:
    """Citations whose own score clears the threshold, in order."""
    return reranked.filter(F.col(score).isNotNull() & (F.col(score) >= threshold))


def gate_first(reranked: DataFrame, query: str, threshold: float, score: str = "rerank_score") -> DataFrame:
    """All citations of queries whose first one clears the threshold."""
    first = F.first(score).over(Window.partitionBy(query).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return reranked.withColumn("_first", first).filter(F.col("_first") >= threshold).drop("_first")


def overlap_rerank(pairs: DataFrame, query_words: str, doc_words: str) -> DataFrame:
    """A deterministic stand-in for a cross-encoder: the share of a query's distinct words that the document holds."""
    share = F.size(F.array_intersect(query_words, doc_words)) / F.greatest(F.size(F.array_distinct(query_words)), F.lit(1))
    return pairs.withColumn("rerank_score", F.round(share, 6))


def reranked(pairs: DataFrame, query: str, top: int) -> DataFrame:
    """Best rerank scores first; the original rank breaks ties."""
    by = Window.partitionBy(query).orderBy(F.desc("rerank_score"), "rank")
    return pairs.withColumn("new_rank", F.row_number().over(by)).filter(F.col("new_rank") <= top).drop("rank").withColumnRenamed("new_rank", "rank")


def carried_over(pool: DataFrame, extra: DataFrame, query: str, key: str) -> DataFrame:
    """Adds `extra` (query, key, ord) behind `pool` (query, key, rank): keys not yet there, once each, in order."""
    seen = extra.groupBy(query, key).agg(F.min("ord").alias("ord")).join(pool, [query, key], "left_anti")
    last = pool.groupBy(query).agg(F.max("rank").alias("last"))
    by = Window.partitionBy(query).orderBy("ord", key)
    behind = seen.join(last, query, "left").select(query, key, (F.coalesce("last", F.lit(0)) + F.row_number().over(by)).cast("int").alias("rank"), F.lit(True).alias("carried"))
    return pool.select(query, key, "rank", F.lit(False).alias("carried")).unionByName(behind)


def first_of_page(ranked: DataFrame, query: str, page: str, limit: int | None = None) -> DataFrame:
    """A ranking of pages from one of chunks: each page at its best place."""
    best = ranked.groupBy(query, page).agg(F.min("rank").alias("best"))
    out = best.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("best", page)))
    return out if limit is None else out.filter(F.col("rank") <= limit)
