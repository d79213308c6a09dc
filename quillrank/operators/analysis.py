"""Stems and lemmas in an index: each distinct term of a corpus is analysed once, and the table of terms is joined."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import shared
from . import retrieval

#: Terms up to which their stems are broadcast: some megabytes.
FEW_TERMS = 200_000


def _stem(words: str) -> Column:
    @F.pandas_udf("string")
    def stems(batch: pd.Series) -> pd.Series:
        return batch.map(T.german_stem, na_action="ignore")

    return stems(words)


def analysed(terms: DataFrame, lemmas: DataFrame | None = None, stopwords: list[str] | None = None, stem: bool = True) -> DataFrame:
    """terms (term) -> (term, root) of its distinct terms that are no stop words: the term's lemma where lemmas (term, lemma) has
    one, the smallest of several, then its German stem."""
    rows = terms.select("term").distinct()
    if stopwords:
        rows = rows.where(~F.col("term").isin(stopwords))
    if lemmas is not None:
        one = lemmas.groupBy("term").agg(F.min("lemma").alias("lemma"))
        rows = rows.join(one, "term", "left").select("term", F.coalesce("lemma", "term").alias("root"))
    else:
        rows = rows.withColumn("root", F.col("term"))
    return rows.withColumn("root", _stem("root")) if stem else rows


def _joined(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(roots) if roots.count() <= FEW_TERMS else roots, "term")


def rooted(rows: DataFrame, lemmas: DataFrame | None = None, stopwords: list[str] | None = None, stem: bool = True) -> DataFrame:
    """rows with a column term -> with its root for it; rows of stop words go."""
    got = _joined(rows, analysed(rows, lemmas, stopwords, stem))
    return got.withColumn("term", F.col("root")).drop("root")


def bm25(queries: DataFrame, docs: DataFrame, lemmas: DataFrame | None = None, stopwords: list[str] | None = None, stem: bool = True, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """retrieval.bm25 over roots: (query_id, doc_id, score) of pairs that share a root. Documents are as long as they have tokens
    that are no stop words. Only roots that a query asks for are counted."""
    toks = T.without_stopwords(T.tokens(F.col("text")), stopwords or [])
    each = docs.select("doc_id", toks.alias("toks")).withColumn("dl", F.size("toks"))
    size = each.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    asked = rooted(retrieval.query_terms(queries), lemmas, stopwords, stem).distinct()
    terms = each.select(F.explode(F.array_distinct("toks")).alias("term"))
    roots = analysed(terms, lemmas, stopwords, stem).join(asked.select(F.col("term").alias("root")).distinct(), "root", "left_semi")
    tf = _joined(each.select("doc_id", "dl", F.explode("toks").alias("term")), roots).groupBy("doc_id", "dl", "root").agg(F.count("*").alias("tf")).withColumnRenamed("root", "term")
    df = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(size))
    idf = df.select("term", "avgdl", F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    gain = F.col("idf") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return tf.join(idf, "term").join(asked, "term").groupBy("query_id", "doc_id").agg(F.sum(gain).alias("score"))


def bm25_top(queries: DataFrame, docs: DataFrame, k: int, lemmas: DataFrame | None = None, stopwords: list[str] | None = None, stem: bool = True, digits: int = 6) -> DataFrame:
    """(query_id, doc_id, score, rank) of the k best of bm25, by scores rounded to ``digits``. Roots are put for tokens where texts are
    read, and each task scores its own documents; neither tokens nor pairs are shuffled. Repeated ids and very many terms go by
    bm25."""
    asked = shared.written(rooted(retrieval.query_terms(queries), lemmas, stopwords, stem).distinct(), "asked")
    each = docs.select("doc_id", T.without_stopwords(T.tokens(F.col("text")), stopwords or []).alias("toks"))
    terms = each.select(F.explode(F.array_distinct("toks")).alias("term"))
    roots = shared.written(analysed(terms, lemmas, stopwords, stem).join(asked.select(F.col("term").alias("root")).distinct(), "root", "left_semi"), "roots")
    if roots.count() > FEW_TERMS or not retrieval._plain(docs, asked):
        return retrieval.top_k(bm25(queries, docs, lemmas, stopwords, stem).withColumn("score", F.round("score", digits)), k)
    told = docs.sparkSession.sparkContext.broadcast([list(x) for x in zip(*roots.select("term", "root").collect(), strict=True)] or [[], []])

    def rooted_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, root = (pa.array(x, pa.string()) for x in told.value)
        for batch in batches:
            toks = batch.column(1)
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(toks).to_numpy(zero_copy_only=False))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), root.take(pc.index_in(toks.flatten(), known)))], names=["doc_id", "toks"])

    rows = shared.written(each.mapInArrow(rooted_tokens, f"doc_id {dict(docs.dtypes)['doc_id']}, toks array<string>"), "roots-of-documents")
    return retrieval.bm25_top_of(asked, rows, k, digits)


def expanded(queries: DataFrame, synonyms: DataFrame, repeat: int = 1) -> DataFrame:
    """(query_id, text): each token's stem ``repeat`` times and, after its first place, the synonyms (term, synonym) of that stem
    which the text has neither as an earlier stem nor as an earlier synonym, in the synonyms' order."""
    toks = queries.select("query_id", F.posexplode(T.punctuation_tokens(F.col("text"))).alias("pos", "term"))
    stems = rooted(toks)
    more = stems.join(synonyms, "term").select("query_id", "pos", F.col("synonym").alias("term"))
    # Among equal terms the stem at a place comes before the synonyms of that place.
    every = stems.withColumn("kind", F.lit(0)).unionByName(more.withColumn("kind", F.lit(1)))
    before = every.groupBy("query_id", "term").agg(F.min(F.struct("pos", "kind")).alias("first"))
    kept = every.join(before, ["query_id", "term"]).where((F.col("kind") == 0) | (F.struct("pos", "kind") == F.col("first"))).select("query_id", "pos", "kind", "term").distinct()
    line = F.transform(F.array_sort(F.collect_list(F.struct("pos", "kind", "term"))), lambda x: F.array_repeat(x["term"], F.when(x["kind"] == 0, repeat).otherwise(1).cast("int")))
    got = kept.groupBy("query_id").agg(F.array_join(F.flatten(line), " ").alias("text"))
    return queries.select("query_id").join(got, "query_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
