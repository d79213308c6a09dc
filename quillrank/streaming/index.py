"""Incremental document frequencies of citations.

A stream of documents is scanned for citations statelessly; each micro-batch writes its counts under its own batch id,
so a batch that runs again replaces what it wrote. Frequencies are sums over batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.citations import edges


def start(docs: DataFrame, path: str, checkpoint: str):
    """docs: a streaming DataFrame (doc_id, text). Starts the query."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        edges(batch, first=True).groupBy("citation").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{path}/counts/batch={number}")
        batch.agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/docs/batch={number}")
        batch.unpersist()

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def idf(spark: SparkSession, path: str) -> DataFrame:
    n = spark.read.parquet(f"{path}/docs").agg(F.sum("n").alias("n"))
    df = spark.read.parquet(f"{path}/counts").groupBy("citation").agg(F.sum("df").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("citation", "df", F.ln(F.col("n") / (1 + F.col("df"))).alias("idf"))
