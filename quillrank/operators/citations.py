"""Citation graph: edges from text, statistics, per-query citation scores, dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import scores as S
from ..functions import text as T
from ..sources import shared


def edges(docs: DataFrame, first: bool = False, dialect: str = "loose") -> DataFrame:
    """(doc_id, citation, pos): each citation found in a text, at every sentence that contains it (0-based), or with
    first at the first one. docs (doc_id, text). No join: the sentences of a text meet its own citations."""
    rows = docs.select("doc_id", C.extract(F.col("text"), dialect).alias("found"), F.col("text")).withColumn("sentences", T.protected_sentences(F.col("text"), F.col("found")))
    each = rows.select("doc_id", "found", F.posexplode("sentences").alias("pos", "sentence")).select("doc_id", "pos", F.explode(F.filter("found", lambda c: F.contains(F.col("sentence"), c))).alias("citation"))
    return each.groupBy("doc_id", "citation").agg(F.min("pos").alias("pos")) if first else each.select("doc_id", "citation", "pos")


def inverted_index(edge: DataFrame) -> DataFrame:
    """(citation, docs): normalised edges are better kept as rows; this is for export."""
    return edge.groupBy("citation").agg(F.array_sort(F.collect_set("doc_id")).alias("docs"))


def posting_stats(edge: DataFrame) -> DataFrame:
    n = edge.select("doc_id", "citation").distinct().groupBy("citation").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("citations"), F.max("n").alias("longest"), F.avg("n").alias("mean"))


def idf(edge: DataFrame, docs: DataFrame) -> DataFrame:
    """(citation, df, idf): ln(N / (1 + df))."""
    n = docs.select("doc_id").agg(F.countDistinct("doc_id").alias("n"))
    df = edge.select("doc_id", "citation").distinct().groupBy("citation").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("citation", "df", F.ln(F.col("n") / (1 + F.col("df"))).alias("idf"))


def doc_triple(evidence: DataFrame, w: tuple[float, float, float] = (0.4, 0.4, 0.2), threshold: float | None = None) -> DataFrame:
    """(doc_id, citation, coverage, peak, position, score) from evidence (doc_id, citation, score, weight):
    w1*ln(1+coverage)+w2*peak+w3*position. With threshold, one weak appearance (coverage 1 and a peak below it) goes."""
    rows = evidence.groupBy("doc_id", "citation").agg(F.count("*").alias("coverage"), F.max("score").alias("peak"), F.max("weight").alias("position"))
    if threshold is not None:
        rows = rows.where(~((F.col("coverage") == 1) & (F.col("peak") < threshold)))
    return rows.withColumn("score", w[0] * F.ln(1.0 + F.col("coverage")) + w[1] * F.col("peak") + w[2] * F.col("position"))


def pooled(per_doc: DataFrame, pool: str = "sum") -> DataFrame:
    return per_doc.groupBy("query_id", "citation").agg(S.pooled(pool, F.col("score")).alias("score"))


def global_fusion(rerank: DataFrame, recall: DataFrame, pool: str = "max", decay: str = "log", weights: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """Pools rerank (query_id, doc_id, citation, score) and decayed recall (the same with rank from 1) over documents,
    scales each to 0..1 within a query and adds them."""
    side = lambda df, c, w: df.groupBy("query_id", "citation").agg(S.pooled(pool, c).alias("s")).select("query_id", "citation", (w * S.min_max(F.col("s"), ["query_id"])).alias("s"))
    a = side(rerank, F.col("score"), weights[0])
    b = side(recall, F.col("score") * S.decay(decay, F.col("rank") - 1), weights[1])
    return a.unionByName(b).groupBy("query_id", "citation").agg(F.sum("s").alias("score"))


def position_score(hits: DataFrame, edge: DataFrame, decay: str = "reciprocal") -> DataFrame:
    """Sum over a query's documents of score * decay(first position). edge: any positions."""
    first = edge.groupBy("doc_id", "citation").agg(F.min("pos").alias("pos"))
    return hits.join(first, "doc_id").groupBy("query_id", "citation").agg(F.sum(F.col("score") * S.decay(decay, F.col("pos"))).alias("score"))


def section_score(hits: DataFrame, edge: DataFrame) -> DataFrame:
    """Sum over documents of score * the greatest section weight: edge (doc_id, citation, weight)."""
    best = edge.groupBy("doc_id", "citation").agg(F.max("weight").alias("weight"))
    return hits.join(best, "doc_id").groupBy("query_id", "citation").agg(F.sum(F.col("score") * F.col("weight")).alias("score"))


def softmax_tfidf(hits: DataFrame, edge: DataFrame, idfs: DataFrame, k: int = 20, alpha: float = 5.0, beta: float = 0.1) -> DataFrame:
    """Over the k best documents: softmax(alpha*score) * ln(1+tf) * idf * mean(exp(-beta*pos)), summed, times
    ln(1+number of documents). Citations without an idf count 1."""
    from .retrieval import top_k

    top = top_k(hits.select("query_id", "doc_id", "score"), k).withColumn("w", S.softmax(F.col("score"), ["query_id"], alpha))
    per_doc = edge.groupBy("doc_id", "citation").agg(F.count("*").alias("tf"), F.avg(F.exp(-beta * F.col("pos"))).alias("near"))
    rows = top.join(per_doc, "doc_id").join(idfs.select("citation", "idf"), "citation", "left")
    part = F.col("w") * F.ln(1.0 + F.col("tf")) * F.coalesce("idf", F.lit(1.0)) * F.col("near")
    return rows.groupBy("query_id", "citation").agg((F.sum(part) * F.ln(1.0 + F.count("*"))).alias("score"))


def min_max_pool(hits: DataFrame, edge: DataFrame, pool: str, idfs: DataFrame | None = None, gate: float | None = None, top: int | None = None) -> DataFrame:
    """Scores scaled to 0..1 within a query, decayed by 1/ln(1+max(pos,1)) at the first position, pooled by max or by sum
    (of the ``top`` greatest parts only), times idf, times ln(1+count), over the query's maximum. gate: documents
    below it after scaling go first."""
    scaled = hits.withColumn("s", S.min_max(F.col("score"), ["query_id"]))
    if gate is not None:
        scaled = scaled.where(F.col("s") >= gate)
    first = edge.groupBy("doc_id", "citation").agg(F.min("pos").alias("pos"))
    rows = scaled.join(first, "doc_id").withColumn("part", F.col("s") / F.ln(1.0 + F.greatest("pos", F.lit(1))))
    if top is not None:
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "citation").orderBy(F.desc("part"), "doc_id"))).where(F.col("n") <= top)
    got = rows.groupBy("query_id", "citation").agg(S.pooled(pool, F.col("part")).alias("p"), F.count("*").alias("n"))
    if idfs is not None:
        got = got.join(idfs.select("citation", "idf"), "citation", "left").withColumn("p", F.col("p") * F.coalesce("idf", F.lit(1.0)))
    return got.withColumn("raw", F.col("p") * F.ln(1.0 + F.col("n"))).select("query_id", "citation", S.by_max(F.col("raw"), ["query_id"]).alias("score"))


def best_evidence(evidence: DataFrame, k: int = 5) -> DataFrame:
    """Sum of the k greatest evidence scores of each (query_id, citation): evidence also has an id."""
    order = Window.partitionBy("query_id", "citation").orderBy(F.desc("score"), "id")
    return evidence.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).groupBy("query_id", "citation").agg(F.sum("score").alias("score"))


def votes(hits: DataFrame, edge: DataFrame, k: int) -> DataFrame:
    """(query_id, citation, votes): documents of the query that cite it, for citations that one of the k best has."""
    from .retrieval import top_k

    cited = edge.select("doc_id", "citation").distinct()
    all_of = hits.select("query_id", "doc_id").join(cited, "doc_id")
    seen = top_k(hits.select("query_id", "doc_id", "score"), k).join(cited, "doc_id").select("query_id", "citation").distinct()
    return all_of.join(seen, ["query_id", "citation"], "left_semi").groupBy("query_id", "citation").agg(F.count("*").alias("votes"))


def position_sum(hits: DataFrame, edge: DataFrame, idfs: DataFrame) -> DataFrame:
    """Sum of 1/(1+pos) over all appearances in the query's documents, times idf (1 without)."""
    s = hits.select("query_id", "doc_id").join(edge, "doc_id").groupBy("query_id", "citation").agg(F.sum(1 / (1.0 + F.col("pos"))).alias("s"))
    return s.join(idfs.select("citation", "idf"), "citation", "left").select("query_id", "citation", (F.col("s") * F.coalesce("idf", F.lit(1.0))).alias("score"))


def doc_softmax_rank(evidence: DataFrame) -> DataFrame:
    """Softmax within each (query_id, doc_id), the greatest of each citation, ranked within a query."""
    p = evidence.withColumn("p", S.softmax(F.col("score"), ["query_id", "doc_id"]))
    best = p.groupBy("query_id", "citation").agg(F.max("p").alias("score")).withColumn("score", S.rounded("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "citation")))


def top_doc_max(hits: DataFrame, edge: DataFrame, k: int) -> DataFrame:
    """The greatest document score over the k best documents that cite it."""
    from .retrieval import top_k

    return top_k(hits.select("query_id", "doc_id", "score"), k).join(edge.select("doc_id", "citation").distinct(), "doc_id").groupBy("query_id", "citation").agg(F.max("score").alias("score"))


def anchor_match(similar: DataFrame, threshold: float = 0.8) -> DataFrame:
    """similar (query_id, citation, sentence, anchor, score) -> the best anchor of each sentence, the best sentence of each
    citation, those of at least threshold."""
    best = similar.groupBy("query_id", "citation", "sentence").agg(F.max("score").alias("score"))
    return best.groupBy("query_id", "citation").agg(F.max("score").alias("score")).where(F.col("score") >= threshold)


def parsed(rows: DataFrame, citation: str = "citation") -> DataFrame:
    """(citation, p, norm, gran) of the different citations that can be parsed, once each. The parse is written: as a mere column
    it would be made again, with all its expressions, for every part that is asked of it."""
    each = rows.select(F.col(citation).alias("citation")).distinct()
    told = shared.written(each.select("citation", C.parse(F.col("citation")).alias("p")), "parsed").where("p is not null")
    return told.select("citation", "p", C.normal(F.col("p")).alias("norm"), C.granularity(F.col("p")).alias("gran"))


def dedup(rows: DataFrame, citation: str = "citation", by: tuple[str, ...] = ("query_id",), compat: bool = False) -> DataFrame:
    """Distinct normal forms of each group. Laws of one key keep the form with a numeric SR law, then the finer one;
    then each article keeps its finest forms alone. The key is (law, article, ...); with compat the law isn't in
    it, as in the original system. What can't be parsed goes."""
    cited = shared.written(rows.select(*by, F.col(citation).alias("citation")).distinct(), "cited")
    p = cited.join(parsed(cited), "citation").select(*by, "p", "norm", "gran").distinct()
    cases = p.where("p.kind != 'law'").select(*by, F.col("norm").alias("citation"))
    law = F.lit("") if compat else F.col("p.law")
    laws = p.where("p.kind = 'law'").select(*by, "norm", "gran", law.alias("law"), F.coalesce("p.art", F.lit("")).alias("art"), F.coalesce("p.abs", F.lit("")).alias("abs"), F.coalesce("p.lit", F.lit("")).alias("lit"), F.coalesce("p.ziff", F.lit("")).alias("ziff"), C.is_sr(F.coalesce("p.law", F.lit(""))).cast("int").alias("sr"))
    one = Window.partitionBy(*by, "law", "art", "abs", "lit", "ziff").orderBy(F.desc("sr"), F.desc("gran"), "norm")
    best = laws.withColumn("n", F.row_number().over(one)).where("n = 1")
    finest = best.withColumn("top", F.max("gran").over(Window.partitionBy(*by, "law", "art"))).where("gran = top")
    return finest.select(*by, F.col("norm").alias("citation")).unionByName(cases).distinct()


def survivors(rows: DataFrame, compat: bool = True) -> DataFrame:
    """(query_id, citation, score) of the citations that dedup leaves as they are: rows (query_id, citation, score, pos), of
    which the last score of a citation counts."""
    last = shared.written(rows.groupBy("query_id", "citation").agg(F.max_by("score", "pos").alias("score")), "last")
    return last.join(dedup(last, compat=compat), ["query_id", "citation"], "left_semi")


def dedup_scored(rows: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(…, citation, score, pos): of each (law, article) the finest form with its score, the first on a tie, in the place
    of its first appearance. pos: order of the input."""
    # Of one citation only its first place can count.
    first = shared.written(rows.groupBy(*by, "citation").agg(F.max_by("score", F.struct(-F.col("pos"))).alias("score"), F.min("pos").alias("pos")), "first")
    p = first.join(parsed(first), "citation")
    key = F.when(F.col("p.kind") != "law", F.col("norm")).otherwise(F.concat_ws("|", "p.law", "p.art"))
    best = p.groupBy(*by, key.alias("key")).agg(F.max_by(F.struct("norm", "score"), F.struct("gran", -F.col("pos"))).alias("b"), F.min("pos").alias("pos"))
    return best.select(*by, F.col("b.norm").alias("citation"), F.col("b.score").alias("score"), "pos")


def without_shadowed(rows: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Drops a bare article where the group also has the same article and law with a paragraph."""
    cited = shared.written(rows.select(*by, "citation").distinct(), "cited")
    keyed = cited.join(parsed(cited).select("citation", F.col("p").alias("_p")), "citation").withColumn("_art", F.lower("_p.art")).withColumn("_law", F.upper("_p.law"))
    fine = keyed.where("_p.abs is not null and _art is not null").select(*by, "_art", "_law").distinct()
    bare = F.col("_p.kind").eqNullSafe("law") & F.col("_p.abs").isNull() & F.col("_art").isNotNull()
    shadowed = keyed.where(bare).join(fine, [*by, "_art", "_law"], "left_semi").select(*by, "citation").distinct()
    return rows.join(shadowed, [*by, "citation"], "left_anti")


def known_only(rows: DataFrame, *ids: DataFrame) -> DataFrame:
    """Rows whose citation one of the id tables (a first column each) has."""
    known = None
    for df in ids:
        some = df.select(F.col(df.columns[0]).alias("citation"))
        known = some if known is None else known.unionByName(some)
    return rows.join(known.distinct(), "citation", "left_semi")


def run_max(rows: DataFrame, order: str, id: str, score: str, value: str, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Consecutive rows of one id, in each group's order, become the one of greatest score. Rows of one place in the order stand
    by value, the greatest first, and runs that begin there are numbered together, as SQL's default frame has it."""
    w = Window.partitionBy(*by).orderBy(order)
    before = F.lag(id).over(Window.partitionBy(*by).orderBy(order, F.desc(value), id))
    marked = rows.withColumn("_new", (before.isNull() | (before != F.col(id))).cast("int")).withColumn("_run", F.sum("_new").over(w))
    return marked.groupBy(*by, "_run", id).agg(F.max_by(value, F.struct(F.col(score), -F.col(order), F.col(value))).alias(value), F.max(score).alias(score), F.min(order).alias(order)).drop("_run")


def gold_frequency(gold: DataFrame) -> DataFrame:
    """(citation, n): how many queries have it as gold."""
    return gold.select("query_id", "citation").distinct().groupBy("citation").agg(F.count("*").alias("n"))


def best_with_label(rows: DataFrame) -> DataFrame:
    """(query_id, citation, score, label): the greatest of each over all appearances."""
    return rows.groupBy("query_id", "citation").agg(F.max("score").alias("score"), F.max("label").alias("label"))


def documents_with_gold(edge: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, doc_id, label): 1 where a document has a gold citation of the query. edge (query_id, doc_id, citation)."""
    g = gold.select("query_id", "citation").distinct().withColumn("hit", F.lit(1))
    return edge.join(g, ["query_id", "citation"], "left").groupBy("query_id", "doc_id").agg(F.max(F.coalesce("hit", F.lit(0))).alias("label"))


def recalled(hits: DataFrame, edge: DataFrame, k: int) -> DataFrame:
    """(query_id, citation): all citations of a query's k best documents."""
    from .retrieval import top_k

    return top_k(hits.select("query_id", "doc_id", "score"), k).join(edge.select("doc_id", "citation").distinct(), "doc_id").select("query_id", "citation").distinct()


def sources_of_gold(gold: DataFrame, edge: DataFrame) -> DataFrame:
    """(query_id, citation, doc_id): the documents that cite a gold citation."""
    return gold.select("query_id", "citation").distinct().join(edge.select("doc_id", "citation").distinct(), "citation")


def exploded(records: DataFrame) -> DataFrame:
    """Nested records (query_id, cc_list of (cc_id, rerank_score, citations)) -> (query_id, cc_id, rerank_score, citation),
    one row a candidate; a document without citations has none."""
    docs = records.select("query_id", F.explode("cc_list").alias("d"))
    return docs.select("query_id", "d.cc_id", "d.rerank_score", F.explode("d.citations").alias("citation"))
