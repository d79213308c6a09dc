"""Answers: thresholds, top-N rules, submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import top_k


def top_n(scores: DataFrame, n: int) -> DataFrame:
    return top_k(scores, n, id="citation")


def threshold(scores: DataFrame, least: float) -> DataFrame:
    return scores.where(F.col("score") >= least)


def statutes_only(scores: DataFrame) -> DataFrame:
    return scores.where(F.lower("citation").startswith("art."))


def quota_top_n(scores: DataFrame, limit: int, first_limit: int, first: str = "is_case") -> DataFrame:
    """At most ``first_limit`` rows whose boolean column ``first`` holds, then the others up to ``limit`` in all."""
    kind = F.when(F.col(first), 0).otherwise(1)
    within = Window.partitionBy("query_id", kind).orderBy(F.desc("score"), "citation")
    kept = scores.withColumn("_n", F.row_number().over(within)).where(~F.col(first) | (F.col("_n") <= first_limit))
    over = Window.partitionBy("query_id").orderBy(kind, "_n")
    return kept.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= limit).drop("_n")


def dynamic_top_n(scores: DataFrame, n: int) -> DataFrame:
    """The best max(n, floor(ln(count))) of each query."""
    size = F.count("*").over(Window.partitionBy("query_id"))
    limit = F.greatest(F.lit(n), F.floor(F.ln(size.cast("double"))).cast("int"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "citation")
    return scores.withColumn("_limit", limit).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("_limit")).drop("_limit")


def submission(ranked: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, predicted_citations): joined by ";" in order of rank; queries without an answer get ""."""
    rows = ranked.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("citation").cast("string").alias("c")))), lambda x: x["c"]), ";").alias("predicted_citations"))
    if queries is None:
        return rows
    return queries.select("query_id").distinct().join(rows, "query_id", "left").withColumn("predicted_citations", F.coalesce("predicted_citations", F.lit("")))


def funnel(stages: list, candidates: DataFrame) -> DataFrame:
    """Chained top-k: stages of (k, score) where score maps the survivors to (query_id, doc_id, score)."""
    for k, score in stages:
        candidates = top_k(score(candidates), k).select("query_id", "doc_id", "score")
    return candidates


def candidate_caps(rows: DataFrame, docs: int = 50, per_doc: int = 50, total: int = 1000, keep: str | None = None) -> DataFrame:
    """rows (query_id, doc_id, citation, score): the best ``docs`` documents, of each ``per_doc`` citations, in all
    ``total``; rows whose boolean ``keep`` holds come first in the last cut."""
    best = Window.partitionBy("query_id").orderBy(F.desc("top"), "doc_id")
    ranked = rows.groupBy("query_id", "doc_id").agg(F.max("score").alias("top")).withColumn("n", F.row_number().over(best)).where(F.col("n") <= docs).select("query_id", "doc_id")
    inner = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "citation")
    some = rows.join(ranked, ["query_id", "doc_id"], "left_semi").withColumn("_n", F.row_number().over(inner)).where(F.col("_n") <= per_doc)
    first = [F.desc(keep)] if keep else []
    last = Window.partitionBy("query_id").orderBy(*first, F.desc("score"), "doc_id", "citation")
    return some.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= total).drop("_n")
