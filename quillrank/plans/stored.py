"""Tables written in another form and read back, in both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import cache, csv_split, shared, vectors
from .base import query, table
from .retrieval import _docs
from .texts import WORDS


@query("SELECT doc_id, length(text) AS n, sha256(text) AS sha256 FROM documents")
def csv_split_scan(spark, d):
    """Documents as CSV with line breaks in quotes, read in splits."""
    path = shared.new_path(spark, "csv")
    _docs(spark, d).write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    got = csv_split.read_csv(spark, path, ["doc_id", "text"])
    return got.select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").alias("n"), F.sha2("text", 256).alias("sha256"))


@query("SELECT doc_id, round(coalesce(len(list_distinct(w)) / nullif(len(w), 0), 0), 6) AS score FROM (SELECT doc_id, " + WORDS.format("text") + " AS w FROM documents)")
def cached_scores(spark, d):
    """English documents are scored first; all others are, when all are asked for."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    kept = cache.Cache(spark, shared.new_path(spark, "scores"), "share of different words, 1")

    def score(rows):
        w = T.words(F.col("text"))
        return rows.select("key", F.coalesce(F.try_divide(F.size(F.array_distinct(w)), F.size(w)), F.lit(0.0)).alias("value"))

    kept.fill(docs.where("lang = 'en'"), ["text"], score)
    return kept.scored(docs, ["text"], score).select("doc_id", "score")


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id, label, vec_id % 97 AS parent_id, len(embedding) AS n, round(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding]), 6) AS square, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[len(embedding)]::DOUBLE, 6) AS last FROM embeddings")
def vector_shards(spark, d):
    """Embeddings as numbered matrices of 256 rows with parents and metadata beside them, read back."""
    path = shared.new_path(spark, "shards")
    rows = table(spark, d, "embeddings").withColumn("parent_id", F.col("vec_id") % 97)
    vectors.write(rows, path, ["vec_id"], "embedding", "parent_id", ["vec_id", "label"], size=256)
    got = vectors.read(spark, path, parents=True, meta="vec_id BIGINT, label INT")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return got.select("row", "vec_id", "label", "parent_id", F.size("v").alias("n"), square.alias("square"), F.element_at("v", 1).cast("double").alias("first"), F.element_at("v", -1).cast("double").alias("last"))
