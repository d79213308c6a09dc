"""Feature tables for learning to rank, keyed by query and citation unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from . import retrieval

#: What stands for an absent rank.
NO_RANK, NO_POSITION = 99999, 999


def occurrence(rows: DataFrame) -> DataFrame:
    """30 features from occurrences (query_id, citation, score, rank, pos), pos from 1: count, score and rank and position
    statistics, the five best (score, pos, rank) padded with 0, 999, 999, log-sum-exp, means over the maximum."""
    order = Window.partitionBy("query_id", "citation").orderBy(F.desc("score"), "rank", "pos")
    g = rows.withColumn("n", F.row_number().over(order)).withColumn("top", F.max("score").over(Window.partitionBy("query_id", "citation"))).withColumn("best", F.max("score").over(Window.partitionBy("query_id")))
    inv = 1.0 / F.greatest("pos", F.lit(1))
    rel = F.col("score") / (F.col("best") + 1e-8)
    aggs = [
        F.count("*").alias("n_occurrences"), F.max("score").alias("score_max"), F.avg("score").alias("score_mean"), F.sum("score").alias("score_sum"), F.stddev_pop("score").alias("score_std"),
        F.min("rank").alias("rank_min"), F.avg("rank").alias("rank_mean"), F.sum((F.col("rank") <= 10).cast("int")).alias("rank_top10"),
        F.min("pos").alias("pos_min"), F.avg("pos").alias("pos_mean"), F.avg(inv).alias("inv_pos_mean"), F.max(inv).alias("inv_pos_max"),
        (F.max("top") + F.ln(F.sum(F.exp(F.col("score") - F.col("top"))))).alias("score_lse"), F.avg(rel).alias("rel_mean"), F.max(rel).alias("rel_max"),
    ]
    for i in range(1, 6):
        at = F.col("n") == i
        aggs += [F.coalesce(F.max(F.when(at, F.col("score"))), F.lit(0.0)).alias(f"score_{i}"), F.coalesce(F.max(F.when(at, F.col("pos"))), F.lit(NO_POSITION)).alias(f"pos_{i}"), F.coalesce(F.max(F.when(at, F.col("rank"))), F.lit(NO_POSITION)).alias(f"rank_{i}")]
    return g.groupBy("query_id", "citation").agg(*aggs)


def hits_features(hits: DataFrame, edge: DataFrame) -> DataFrame:
    """The second generation: hits (query_id, doc_id, rerank, dense, sparse, rank from 0) with edges (doc_id, citation, pos)."""
    rows = hits.join(edge.groupBy("doc_id", "citation").agg(F.min("pos").alias("pos"), F.count("*").alias("tf")), "doc_id")
    r = F.col("rank").cast("double")
    s, d, p = (F.coalesce(c, F.lit(0.0)) for c in ("rerank", "dense", "sparse"))
    return rows.groupBy("query_id", "citation").agg(
        F.sum(s / F.ln(2 + r)).alias("rerank_log"), F.sum(s / (1 + r)).alias("rerank_inv"), F.sum(d / F.ln(2 + r)).alias("dense_log"), F.sum(p / F.ln(2 + r)).alias("sparse_log"),
        F.sum(F.when(r < 10, s).otherwise(0.0)).alias("top10_bonus"), F.max(s).alias("rerank_max"), F.sum(s * s / F.ln(2 + r)).alias("rerank_sq"),
        F.min("rank").alias("rank_min"), F.max("rank").alias("rank_max"), F.avg("rank").alias("rank_mean"), F.sum(d).alias("dense_sum"), F.sum(p).alias("sparse_sum"),
        (F.sum(d) / (F.sum(p) + 1e-9)).alias("dense_sparse_ratio"), F.countDistinct("doc_id").alias("n_docs"), F.sum(F.col("tf") * s).alias("weighted_coverage"), F.avg("pos").alias("pos_mean"),
    )


def by_source(hits: DataFrame, edge: DataFrame, sources: tuple[str, ...] = ("dense", "sparse", "rerank")) -> DataFrame:
    """The third generation: eight features for each source, from scores scaled to 0..1 within (query, source). hits
    (query_id, doc_id, source, score, rank from 0). Absent sources get rank 99999 and else 0."""
    scaled = hits.withColumn("s", S.min_max(F.col("score"), ["query_id", "source"]))
    rows = scaled.join(edge.select("doc_id", "citation").distinct(), "doc_id")
    key = ["query_id", "citation", "source"]
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("s"), "rank"))).withColumn("low", F.min("rank").over(Window.partitionBy(*key)))
    r, s = F.col("rank").cast("double"), F.col("s")
    g = rows.groupBy("query_id", "citation").pivot("source", list(sources)).agg(
        F.min("rank").alias("rank_min"), F.avg(s).alias("mean"), (F.sum(F.when(F.col("n") <= 3, s).otherwise(0.0)) / (1 + F.count(F.lit(1)))).alias("top3"), F.avg(1 / (1 + r)).alias("inv"),
        F.avg(1 / F.ln(2 + r)).alias("log"), F.avg(F.when(F.col("rank") == F.col("low"), s)).alias("at_best"), F.avg(s / (1 + r)).alias("s_inv"), F.avg(s / F.ln(2 + r)).alias("s_log"),
    )
    for c in g.columns[2:]:
        g = g.withColumn(c, F.coalesce(c, F.lit(NO_RANK if c.endswith("rank_min") else 0.0)))
    return g


def tf_idf_overlap(pairs: DataFrame, a: str, b: str, most: int = 5000) -> DataFrame:
    """pairs (id, texts a and b) -> (id, overlap): the sum over shared terms of idf, over the ``most`` terms of the greatest
    document frequency in b."""
    toks = pairs.select("id", F.explode(F.array_distinct(T.tokens(F.col(b)))).alias("term"))
    n = pairs.agg(F.count("*").alias("n"))
    df = toks.groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(most).crossJoin(F.broadcast(n)).select("term", F.ln((1.0 + F.col("n")) / (1 + F.col("df"))).alias("idf"))
    ask = pairs.select("id", F.explode(F.array_distinct(T.tokens(F.col(a)))).alias("term"))
    got = ask.join(toks, ["id", "term"]).join(df, "term").groupBy("id").agg(F.sum("idf").alias("overlap"))
    return pairs.select("id").join(got, "id", "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))


def _trigger_words(text: str) -> list[Column]:
    low = F.lower(text)
    return [F.length(text).alias("len"), F.contains(low, F.lit("gemäss")).cast("int").alias("has_gemaess"), F.contains(low, F.lit("vgl")).cast("int").alias("has_vgl")]


def window_features(pairs: DataFrame, query: str = "q_v", window: str = "v") -> DataFrame:
    """The fourth generation's own features of pairs with two vectors and the window's text: cosine, length, two trigger
    words. tf_idf_overlap and document scores come by joins."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return pairs.select("*", (dot(query, window) / (F.sqrt(dot(query, query)) * F.sqrt(dot(window, window)) + 1e-6)).alias("dense_sim"), *_trigger_words("text"))


def window_texts(windows: DataFrame) -> DataFrame:
    """(doc_id, len, has_gemaess, has_vgl) of windows (doc_id, text): what doesn't depend on the query."""
    return windows.select("doc_id", *_trigger_words("text"))


def window_pairs(queries: DataFrame, windows: DataFrame, by: str) -> DataFrame:
    """The same features of all pairs of a query (query_id, by, v) and another window (doc_id, by, v and those of its text) of one
    ``by``: a text is read once, whatever the number of queries."""
    return retrieval.scored_within(queries, windows, by, retrieval.cosines).withColumnRenamed("score", "dense_sim")


def _letters3(text: Column) -> Column:
    return T.tokens(text, T.LETTERS3)


def vocabulary(docs: DataFrame, most: int = 500, tokens=_letters3) -> DataFrame:
    """(term, tc, df, weight): tc * ln(N/(df+1)) of terms of more than two letters in more than one document, the
    ``most`` greatest. tokens: text column -> array of terms."""
    toks = docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("term"))
    n = docs.agg(F.count("*").alias("n"))
    g = toks.groupBy("term", "doc_id").agg(F.count("*").alias("c")).groupBy("term").agg(F.sum("c").alias("tc"), F.count("*").alias("df")).where("df > 1")
    return g.crossJoin(F.broadcast(n)).withColumn("weight", F.round(F.col("tc") * F.ln(F.col("n") / (F.col("df") + 1)), S.ROUND)).select("term", "tc", "df", "weight").orderBy(F.desc("weight"), "term").limit(most)


def term_frequencies(docs: DataFrame, vocab: DataFrame, tokens=_letters3) -> DataFrame:
    """(doc_id, term, tf): count over the document's length, for terms of the vocabulary."""
    rows = docs.select("doc_id", tokens(F.col("text")).alias("t")).withColumn("n", F.size("t")).select("doc_id", "n", F.explode("t").alias("term"))
    return rows.join(vocab.select("term"), "term").groupBy("doc_id", "term", "n").agg(F.count("*").alias("c")).select("doc_id", "term", (F.col("c") / F.col("n")).alias("tf"))


#: Keyword lists of the rule-based features.
KEYWORDS = {
    "pos_strong": ["gemäss", "nach", "laut", "gestützt auf", "in anwendung von", "im sinne von", "aufgrund von"],
    "pos_med": ["vgl.", "vgl. auch", "siehe", "siehe auch"],
    "pos_conclusion": ["entscheidend ist", "massgebend ist", "ist zu prüfen", "ist zu entscheiden", "ergibt sich aus", "folgt aus"],
    "neg_strong": ["kann offen bleiben", "nicht entscheidend", "braucht nicht entschieden"],
    "neg_fact": ["macht geltend", "stellte fest", "wird ausgeführt", "laut den angaben"],
    "neg_weak": ["unter anderem", "beispielsweise", "z.b.", "insbesondere"],
}


def rule_based(rows: DataFrame) -> DataFrame:
    """rows (sentence, sentence_idx, n_sentences, citation, start, n_citations), one an occurrence -> with 13 features more.
    The dependency flags need a parser and are 0, as where none is installed."""
    s = F.col("sentence")
    n = {k: T.keyword_count(s, w) for k, w in KEYWORDS.items()}
    some = lambda k: (n[k] > 0).cast("int")
    return rows.select(
        "*", (2 * n["pos_strong"] + n["pos_med"] + 3 * n["pos_conclusion"]).alias("pos_keyword_score"), (3 * n["neg_strong"] + 2 * n["neg_fact"] + n["neg_weak"]).alias("neg_keyword_score"),
        some("pos_conclusion").alias("is_conclusion_sentence"), some("neg_fact").alias("is_fact_sentence"), some("pos_strong").alias("has_strong_positive"),
        (F.col("sentence_idx") / F.greatest("n_sentences", F.lit(1))).alias("pos_norm"), (F.col("start") / F.greatest(F.length(s), F.lit(1))).alias("char_pos_norm"),
        F.lit(0).alias("is_prep_object"), F.lit(0).alias("is_subject"), F.col("n_citations").alias("num_citations_in_sentence"), (F.col("n_citations") == 1).cast("int").alias("is_single_citation"), F.length(s).alias("sentence_len"),
    )


def interaction(query: Column, citation: Column, before: Column, after: Column) -> dict[str, Column]:
    """Query and citation: mention by the first six characters, same family, hit rates of the query's terms before and
    after, and their asymmetry."""
    q = F.array_distinct(T.words(F.lower(query)))
    rate = lambda c: F.size(F.array_intersect(q, T.words(F.lower(c)))) / (F.size(q) + F.lit(1e-8))
    b, a = rate(before), rate(after)
    fam = lambda c: F.when(c.rlike(r"(?i)BGE\s+\d"), "bge").when(c.rlike(r"(?i)SR\s*\d"), "sr").when(c.rlike(r"(?i)Art\.?\s*\d"), "art")
    return {"mentioned": F.contains(F.lower(query), F.lower(F.substring(citation, 1, 6))).cast("int"), "same_family": F.coalesce(fam(query) == fam(citation), F.lit(False)).cast("int"), "rate_before": b, "rate_after": a, "asymmetry": F.abs(a - b)}


def combos(rows: DataFrame) -> DataFrame:
    """The fifth generation's score combinations of rows with dense, sparse, rerank, freq, pos and n_sentences."""
    d, s, r = (F.coalesce(c, F.lit(0.0)) for c in ("dense", "sparse", "rerank"))
    f = F.col("freq").cast("double")
    return rows.withColumn("sum_scores", d + s + r).withColumn("dense_x_sparse", d * s).withColumn("rerank_x_dense", r * d).withColumn("rerank_x_sparse", r * s).withColumn("max_score", F.greatest(d, s, r)).withColumn("min_score", F.least(d, s, r)).withColumn("score_gap", F.greatest(d, s, r) - F.least(d, s, r)).withColumn("log_freq", F.ln(1 + f)).withColumn("rerank_x_freq", r * F.ln(1 + f)).withColumn("rel_pos", F.col("pos") / F.greatest("n_sentences", F.lit(1))).withColumn("inv_pos", 1 / (1.0 + F.col("pos"))).withColumn("density", f / F.greatest("n_sentences", F.lit(1)))


def two_stage(rows: DataFrame, k: int = 60) -> DataFrame:
    """prob, rel_pos, ln(1+freq), three scores and their pseudo rank fusion."""
    parts = sum((1 / (k + (1 - F.col(c))) for c in ("dense", "sparse", "rerank")), F.lit(0.0))
    return rows.select("query_id", "citation", "prob", (F.col("pos") / F.greatest("n_sentences", F.lit(1))).alias("rel_pos"), F.ln(1.0 + F.col("freq")).alias("log_freq"), "dense", "sparse", "rerank", parts.alias("fused"))


def doc_probabilities(rows: DataFrame, cut: float = 0.5) -> DataFrame:
    """(query_id, doc_id) -> max, mean of prob, predicted count, count."""
    return rows.groupBy("query_id", "doc_id").agg(F.max("prob").alias("prob_max"), F.avg("prob").alias("prob_mean"), F.sum((F.col("prob") >= cut).cast("int")).alias("n_predicted"), F.count("*").alias("n"))


def labelled(rows: DataFrame, gold: DataFrame) -> DataFrame:
    """rows with label 1 where (query_id, citation) is gold."""
    g = gold.select("query_id", "citation").distinct().withColumn("label", F.lit(1))
    return rows.join(g, ["query_id", "citation"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
