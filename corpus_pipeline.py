"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is
written as Parquet and read again for the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm import common, jaccard, packing, quality, spans, suffix, toxicity
from quillrank.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.scored(docs.select(COLUMNS), model).where("predicted = 0").select(COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    return quality.scored(docs.select(COLUMNS), model).where("predicted = 1").select(COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest doc_id of each group of near copies stays, and so does one without words. Rows go and not
    doc_ids: those with a null or repeated doc_id are documents of their own."""
    rows = spans.numbered(docs, carry=("lang", "source", "n_chars"))
    grouped = jaccard.row_groups(rows, n=5, percent=80).where("group is not null")
    stays = grouped.groupBy("group").agg(F.min("row").alias("row"))
    gone = grouped.select("row").join(stays.select("row"), "row", "left_anti")
    return rows.join(gone, "row", "left_anti").select(COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 200-byte strings that occur elsewhere too go, at every place, the first included (op5's rule), and with
    them what a cut leaves of a character. A text of which nothing is left is empty."""
    kept = suffix.dedup_bytes(docs.select(COLUMNS), carry=("lang", "source", "n_chars"), as_text=True)
    return kept.withColumnRenamed("kept", "text").withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return packing.pack_documents(docs.select("doc_id", "text"), vocabulary("byte_bpe_50k.json"), end_id=2)


STAGES = [
    ("toxicity", not_toxic),
    ("quality", good_quality),
    ("near duplicates", one_of_each_group),
    ("repeated passages", without_repeats),
    ("packing", packed),
]

#: Trained models and tokenizers are beyond SQL; tests/llm compares the rows of run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{common.shared_dir(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex[:12]}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
