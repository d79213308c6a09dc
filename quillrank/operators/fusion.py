"""Merging ranked lists. lists: (query_id, source, doc_id, rank from 1[, score])."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rrf(lists: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (k + rank)."""
    return lists.groupBy("query_id", "doc_id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"))


def rrf_strict(lists: DataFrame, k: int = 60) -> DataFrame:
    """The same; an error if a list lacks a document that another of its query has."""
    n = lists.groupBy("query_id").agg(F.countDistinct("source").alias("sources"))
    fused = lists.groupBy("query_id", "doc_id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"), F.countDistinct("source").alias("present")).join(n, "query_id")
    checked = F.when(F.col("present") == F.col("sources"), F.col("score")).otherwise(F.raise_error(F.lit("a list lacks a document")).cast("double"))
    return fused.select("query_id", "doc_id", checked.alias("score"))


def rrf_on_scores(scores: DataFrame, k: int = 60) -> DataFrame:
    """Sum of 1 / (k + 1 - score) over sources."""
    return scores.groupBy("query_id", "doc_id").agg(F.sum(1 / (k + (1 - F.col("score")))).alias("score"))


def merged_max(lists: DataFrame) -> DataFrame:
    return lists.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


def merged_sum(lists: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum over sources; of a document's repeats within one source its best counts."""
    once = lists.groupBy("query_id", "doc_id", "source").agg(F.max("score").alias("score"))
    w = F.lit(0.0)
    for s, x in weights.items():
        w = F.when(F.col("source") == s, x).otherwise(w)
    return once.groupBy("query_id", "doc_id").agg(F.sum(w * F.col("score")).alias("score"))


def with_rank(hits: DataFrame, by: tuple[str, ...] = ("query_id",), id: str = "doc_id") -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc(id))))


def combined(raw: DataFrame, question: DataFrame, weight: float = 0.5) -> DataFrame:
    """raw + weight * question on documents that both have."""
    return raw.join(question.withColumnRenamed("score", "q"), ["query_id", "doc_id"]).select("query_id", "doc_id", (F.col("score") + weight * F.col("q")).alias("score"))


def appearances(lists: DataFrame) -> DataFrame:
    """How often each document appears over variants and sources."""
    return lists.groupBy("query_id", "doc_id").agg(F.count("*").alias("n"))


def one_of_each_score(hits: DataFrame) -> DataFrame:
    """Of the hits of a query with one score the one of the smallest document."""
    return hits.groupBy("query_id", "score").agg(F.min("doc_id").alias("doc_id"))


def union_of_variants(hits: DataFrame) -> DataFrame:
    """(query_id, doc_id, n, score): documents that any variant of a query finds, how many do, and the best score. hits
    (query_id, variant_no, doc_id, score)."""
    return hits.groupBy("query_id", "doc_id").agg(F.countDistinct("variant_no").alias("n"), F.max("score").alias("score"))


def ordered_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """(query_id, parent_id, rank): parents in the order of their first chunk, without scores."""
    first = hits.join(parents, "doc_id").groupBy("query_id", "parent_id").agg(F.min("rank").alias("_r"))
    return first.select("query_id", "parent_id", F.row_number().over(Window.partitionBy("query_id").orderBy("_r", "parent_id")).alias("rank"))
