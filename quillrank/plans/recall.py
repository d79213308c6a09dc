"""Recall beyond one search: members of clusters scored by themselves, and questions asked by their context alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval
from .base import query, table, with_
from .retrieval import BM25, CONTAINED, LOCAL, _bm25_top, _docs, _queries

_CLUSTERS = """cl AS (SELECT vec_id AS doc_id, label AS cluster FROM embeddings), vo AS (SELECT query_id, cluster, count(*) AS votes FROM bmtop JOIN cl USING (doc_id) GROUP BY 1, 2 HAVING count(*) >= 2),
 vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, cluster) AS n FROM vo), cand AS (SELECT query_id, doc_id, b.text AS query, d.text FROM vr JOIN cl USING (cluster) JOIN benchmark b ON item_id = query_id JOIN documents d USING (doc_id) WHERE n <= 3)"""


@query(with_(BM25, _CLUSTERS, LOCAL[LOCAL.index(" ct AS") + 1 :]) + "SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(coalesce(score, 0), 5) AS score FROM ct LEFT JOIN csc USING (query_id, doc_id))) WHERE rank <= 20")
def cluster_expand_local(spark, d):
    """A query's hits vote for clusters of vectors; BM25 among all members of the chosen ones decides."""
    clusters = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("cluster"))
    chosen = retrieval.chosen_clusters(_bm25_top(spark, d), clusters, votes=2)
    return retrieval.bm25_members(_queries(spark, d), chosen, clusters, _docs(spark, d), 20)


_HALF = "substr(text, 1, length(text) // 2)"


@query(
    with_(BM25.replace("FROM benchmark", f"FROM (SELECT item_id, {_HALF} AS text FROM benchmark)"), CONTAINED, "g AS (SELECT query_id, count(*) AS n FROM inside GROUP BY 1), tp AS (SELECT query_id, count(*) AS tp FROM inside JOIN bmtop USING (query_id, doc_id) GROUP BY 1)")
    + "SELECT query_id, n, coalesce(tp, 0) AS found, round(coalesce(tp, 0) / n, 6) AS recall FROM g LEFT JOIN tp USING (query_id)"
)
def context_recall(spark, d):
    """Queries of a context and a question, put together, taken apart again and asked by the context alone: the first half of a
    passage. Gold are the documents that contain the whole passage."""
    half = F.floor(F.length("text") / 2).cast("int")
    whole = _queries(spark, d).withColumn("query", T.with_context(F.substr("text", F.lit(1), half), F.substr("text", half + 1)))
    context, _ = T.split_context(F.col("query"))
    top = retrieval.bm25_top(whole.select("query_id", context.alias("text")), _docs(spark, d), 100)
    gold = retrieval.containing(_docs(spark, d), _queries(spark, d))
    n = gold.groupBy("query_id").agg(F.count("*").alias("n")).join(gold.join(top, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count("*").alias("found")), "query_id", "left").na.fill(0, ["found"])
    return n.withColumn("recall", F.col("found") / F.col("n"))
