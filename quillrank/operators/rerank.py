"""Scorers, encoders and query rewriters as plug-ins: an injected callable runs in Arrow batches.

Factories are called once in a task, so a model is loaded once there. The stubs are deterministic and need no model.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T

#: factory() -> function of (queries, texts) that gives scores.
Scorer = Callable[[], Callable[[list[str], list[str]], list[float]]]


def overlap_scorer():
    """A stub cross-encoder: shared lower-case words over the query's."""

    def score(queries: list[str], texts: list[str]) -> list[float]:
        out = []
        for q, t in zip(queries, texts, strict=True):
            a, b = set((q or "").lower().split()), set((t or "").lower().split())
            out.append(len(a & b) / len(a) if a else 0.0)
        return out

    return score


def rerank(pairs: DataFrame, factory: Scorer = overlap_scorer, batch: int = 64) -> DataFrame:
    """pairs (…, query, text) with score. Within an Arrow batch texts are scored in order of length, so that a padded
    model wastes little."""
    kind = StructType([*pairs.schema.fields, *StructType.fromDDL("score double").fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = factory()
        for pdf in batches:
            order = pdf["text"].fillna("").str.len().sort_values(kind="stable").index
            out = pd.Series(0.0, index=pdf.index)
            for a in range(0, len(order), batch):
                at = order[a : a + batch]
                out.loc[at] = score(pdf.loc[at, "query"].tolist(), pdf.loc[at, "text"].tolist())
            yield pdf.assign(score=out)

    return pairs.mapInPandas(run, kind)


def rerank_chunks(pairs: DataFrame, size: int = 384, overlap: int = 128, factory: Scorer = overlap_scorer, compat: bool = False) -> DataFrame:
    """(query_id, doc_id, query, text) -> the best chunk's score of each document. With compat every chunk gets the whole
    text's score, as in the original system."""
    parts = F.array(F.col("text")) if compat else T.chunks(T.words(F.col("text")), size, overlap)
    rows = pairs.select("query_id", "doc_id", "query", F.explode(parts).alias("text"))
    return rerank(rows, factory).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


def rerank_windows(pairs: DataFrame, width: int = 4, step: int = 1, factory: Scorer = overlap_scorer) -> DataFrame:
    """(query_id, doc_id, window, text, score) of sentence windows."""
    rows = pairs.select("query_id", "doc_id", "query", F.posexplode(T.sentence_windows(T.sentences(F.col("text")), width, step)).alias("window", "text"))
    return rerank(rows, factory).drop("query")


def rerank_with_citation(pairs: DataFrame, factory: Scorer = overlap_scorer) -> DataFrame:
    """The citation stands after the text that is scored."""
    return rerank(pairs.withColumn("plain", F.col("text")).withColumn("text", F.concat_ws(" ", "text", "citation")), factory).withColumn("text", F.col("plain")).drop("plain")


def yes_no(logits: Callable[[], Callable[[list[str], list[str]], list[tuple[float, float]]]], odds: bool = False) -> Scorer:
    """A scorer from a generator's (no, yes) logits: P(yes), or the log-odds."""

    def factory():
        pair = logits()

        def score(queries, texts):
            return [(y - n) if odds else 1 / (1 + math.exp(n - y)) for n, y in pair(queries, texts)]

        return score

    return factory


def hashed_encoder(dim: int = 64):
    """A stub encoder: hashed bag of words, unit length, and the words' weights."""

    def encode(texts: list[str]):
        out = []
        for t in texts:
            v, w = [0.0] * dim, {}
            for x in (t or "").lower().split():
                h = zlib.crc32(x.encode())
                v[h % dim] += 1.0 if h & 1024 else -1.0
                w[x] = w.get(x, 0.0) + 1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append(([x / n for x in v], w))
        return out

    return encode


def encode(docs: DataFrame, factory=hashed_encoder, text: str = "text", batch: int = 10) -> DataFrame:
    """docs with dense (ARRAY<FLOAT>) and sparse (MAP<STRING,FLOAT>)."""
    kind = StructType([*docs.schema.fields, *StructType.fromDDL("dense array<float>, sparse map<string,float>").fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = factory()
        for pdf in batches:
            got = [x for a in range(0, len(pdf), batch) for x in enc(pdf[text].iloc[a : a + batch].tolist())]
            yield pdf.assign(dense=[d for d, _ in got], sparse=[w for _, w in got])

    return docs.mapInPandas(run, kind)


def encode_missing(docs: DataFrame, cache: DataFrame, factory=hashed_encoder) -> tuple[DataFrame, DataFrame]:
    """Embeddings cached by md5(text): (all of docs with dense, the new rows of the cache). cache (key, dense)."""
    keyed = docs.withColumn("key", F.md5(F.coalesce("text", F.lit(""))))
    lack = keyed.select("key", F.coalesce("text", F.lit("")).alias("text")).join(cache.select("key"), "key", "left_anti").groupBy("key").agg(F.min("text").alias("text"))
    new = encode(lack, factory).select("key", "dense")
    return keyed.join(cache.select("key", "dense").unionByName(new), "key").drop("key"), new


def first_evidence(rows: DataFrame) -> DataFrame:
    """One evidence for each (query_id, citation), the first appearance in the best document: rows (…, score, doc_id, pos,
    text)."""
    order = Window.partitionBy("query_id", "citation").orderBy(F.desc("score"), "doc_id", "pos")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def listwise(hits: DataFrame, order: Callable[[str, list[str]], list[int]], window: int = 20, step: int = 5) -> DataFrame:
    """Reranks each query's list from its tail by sliding windows: hits (query_id, rank, doc_id, query, text); order(query,
    texts) gives positions from 0, best first. A query's list is what a reader would see, and fits a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("rank").reset_index(drop=True)
        at = list(range(len(rows)))
        end = len(at)
        while True:
            start = max(0, end - window)
            part = at[start:end]
            given = [i for i in dict.fromkeys(order(rows["query"].iloc[0], rows["text"].iloc[part].tolist())) if 0 <= i < len(part)]
            given += [i for i in range(len(part)) if i not in set(given)]
            at[start:end] = [part[i] for i in given]
            if start == 0:
                break
            end -= step
        return rows.iloc[at].assign(rank=range(1, len(at) + 1))[["query_id", "doc_id", "rank"]]

    kinds = dict(hits.dtypes)
    return hits.groupBy("query_id").applyInPandas(run, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, rank int")


def map_reduce(candidates: list, order: Callable[[list], list[int]], window: int = 40, keep: int = 5) -> list:
    """Windows of candidates are ordered each, the first ``keep`` of each go on, and these are ordered together. A last partial
    window joins the one before it."""

    def first(items: list, most: int | None) -> list:
        given = [i for i in dict.fromkeys(order(items)) if 0 <= i < len(items)]
        return [items[i] for i in (given + [i for i in range(len(items)) if i not in given])[:most]]

    starts = [a for a in range(0, len(candidates), window) if a == 0 or a + window <= len(candidates)]
    parts = [candidates[a : None if a == starts[-1] else a + window] for a in starts]
    return first([x for part in parts for x in first(part, keep)], None)


def aligned(pairs: DataFrame, factory: Scorer = overlap_scorer) -> DataFrame:
    """(query_id, no, doc_id, score) for every document of the input, in its order ``no``: the best score of its chunks, each
    chunk with the whole text's score."""
    scores = rerank_chunks(pairs, factory=factory, compat=True)
    return pairs.select("query_id", "no", "doc_id").join(scores, ["query_id", "doc_id"], "left").select("query_id", "no", "doc_id", "score")


def rewrite(queries: DataFrame, client: Callable[[str, str], list[str]] | None, instruction: str) -> DataFrame:
    """(query_id, variant_no, text): what client(instruction, text) gives, and the query itself last. Without a client, off:
    the query alone. Translation, argument variants, context and question, hypothetical passages, keyword variants and
    diverse rewrites differ in the instruction only."""
    if client is None:
        return queries.select("query_id", F.lit(0).alias("variant_no"), "text")
    kind = dict(queries.dtypes)["query_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(q, i, t) for q, text in zip(pdf["query_id"], pdf["text"], strict=True) for i, t in enumerate([*client(instruction, text), text])]
            yield pd.DataFrame(rows, columns=["query_id", "variant_no", "text"])

    return queries.select("query_id", "text").mapInPandas(run, f"query_id {kind}, variant_no int, text string")


def synonym_expansion(queries: DataFrame, synonyms: DataFrame, repeat: int = 2) -> DataFrame:
    """(query_id, text): the query's tokens ``repeat`` times, then their synonyms that it lacks, in order of appearance.
    synonyms (term, synonym), symmetric."""
    toks = queries.select("query_id", T.punctuation_tokens(F.col("text")).alias("toks"))
    each = toks.select("query_id", F.posexplode("toks").alias("pos", "term")).join(synonyms, "term")
    lacking = each.join(toks, "query_id").where(~F.array_contains("toks", F.col("synonym"))).groupBy("query_id", "synonym").agg(F.min("pos").alias("pos"))
    more = lacking.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "synonym"))), lambda x: x["synonym"]).alias("more"))
    return toks.join(more, "query_id", "left").select("query_id", F.array_join(F.concat(F.flatten(F.array_repeat("toks", repeat)), F.coalesce("more", F.array().cast("array<string>"))), " ").alias("text"))
