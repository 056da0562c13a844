"""Ranked lists, fusion of tiers, normalisation and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import looks_like_prose

TIERS = ("exact", "lexical", "vector")
DIGITS = 6


def ranked(tier: str, hits: DataFrame, raw: str, key: str = "doc_id", lower_is_better: bool = False, preserve: str | None = None) -> DataFrame:
    """(query_id, tier, key, rank, raw): a tier's hits best first; preserve names a column whose order holds instead."""
    score = F.col(raw).cast("double")
    order = F.col(preserve).asc() if preserve else score.asc() if lower_is_better else score.desc()
    by = Window.partitionBy("query_id").orderBy(order, key)
    return hits.select("query_id", F.lit(tier).alias("tier"), key, F.row_number().over(by).alias("rank"), score.alias("raw"))


def weighted(lists: DataFrame, queries: DataFrame, settings) -> DataFrame:
    """Adds weight: exact 1, vector alpha, lexical 1 - alpha, alpha by whether the query is prose; all 1 if not adaptive."""
    if not settings.adaptive_alpha:
        return lists.withColumn("weight", F.lit(1.0))
    alpha = F.when(looks_like_prose(F.col("query"), settings.prose_min_words), settings.alpha_prose).otherwise(settings.alpha_symbol)
    alphas = queries.select("query_id", alpha.alias("alpha"))
    weight = F.when(F.col("tier") == "exact", 1.0).when(F.col("tier") == "vector", F.col("alpha")).otherwise(1 - F.col("alpha"))
    return lists.join(alphas, "query_id").withColumn("weight", weight).drop("alpha")


def reciprocal_ranks(lists: DataFrame, constant: int = 60, key: str = "doc_id") -> DataFrame:
    """(query_id, key, fused): the sum over tiers of weight / (constant + rank)."""
    return lists.groupBy("query_id", key).agg(F.round(F.sum(F.col("weight") / (constant + F.col("rank"))), 9).alias("fused"))


def first_tier(lists: DataFrame, key: str = "doc_id") -> DataFrame:
    """(query_id, key, fused) of the first tier of each query that has hits; raw alone if it tells them apart, else 1."""
    place = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    by = Window.partitionBy("query_id")
    mine = lists.withColumn("place", place).withColumn("first", F.min("place").over(by)).where("place = first")
    score = F.when(F.col("tier") == "lexical", -F.col("raw")).otherwise(F.col("raw"))
    return mine.select("query_id", key, score.alias("fused"))


def min_max(scores: DataFrame, score: str = "fused") -> DataFrame:
    """Replaces score by its place between a query's least and largest; 1 if all are equal."""
    by = Window.partitionBy("query_id")
    low, high = F.min(score).over(by), F.max(score).over(by)
    return scores.withColumn(score, F.round(F.when(high == low, 1.0).otherwise((F.col(score) - low) / (high - low)), DIGITS))


def merge(lists: DataFrame, queries: DataFrame, settings, key: str = "doc_id") -> DataFrame:
    """Fused scores from 0 to 1 by the configured ranker."""
    if settings.ranker == "none":
        return min_max(first_tier(lists, key))
    return min_max(reciprocal_ranks(weighted(lists, queries, settings), settings.rrf_constant, key))


def evidence(lists: DataFrame, key: str = "doc_id") -> DataFrame:
    """(query_id, key, tiers): the raw score under each tier, keyed by its metric's name."""
    metric = F.when(F.col("tier") == "lexical", "bm25").when(F.col("tier") == "vector", "cosine").otherwise(F.col("tier"))
    entries = F.sort_array(F.collect_list(F.struct(metric.alias("key"), F.col("raw").alias("value"))))
    return lists.groupBy("query_id", key).agg(F.map_from_entries(entries).alias("tiers"))
