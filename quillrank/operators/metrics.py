"""Set, ranking and calibration metrics. predicted (query_id, citation), ranked (query_id, citation, rank), gold
(query_id, citation)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_query(predicted: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, n_pred, n_gold, tp, precision, recall, f1) of every query; by convention both empty 1,1,1, no
    prediction 0,0,0, no gold 0,1,0."""
    p, g = predicted.select("query_id", "citation").distinct(), gold.select("query_id", "citation").distinct()
    marks = p.withColumn("p", F.lit(1)).withColumn("g", F.lit(0)).unionByName(g.withColumn("p", F.lit(0)).withColumn("g", F.lit(1)))
    pair = marks.groupBy("query_id", "citation").agg(F.max("p").alias("p"), F.max("g").alias("g"))
    n = pair.groupBy("query_id").agg(F.sum("p").alias("n_pred"), F.sum("g").alias("n_gold"), F.sum(F.col("p") * F.col("g")).alias("tp"))
    rows = queries.select("query_id").distinct().join(n, "query_id", "left").na.fill(0, ["n_pred", "n_gold", "tp"])
    none = (F.col("n_pred") == 0) & (F.col("n_gold") == 0)
    precision = F.when(none, 1.0).when((F.col("n_pred") == 0) | (F.col("n_gold") == 0), 0.0).otherwise(F.col("tp") / F.greatest("n_pred", F.lit(1)))
    recall = F.when(none, 1.0).when(F.col("n_pred") == 0, 0.0).when(F.col("n_gold") == 0, 1.0).otherwise(F.col("tp") / F.greatest("n_gold", F.lit(1)))
    rows = rows.withColumn("precision", precision).withColumn("recall", recall)
    f1 = F.when(none, 1.0).when(F.col("tp") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return rows.withColumn("f1", f1)


def macro(per: DataFrame) -> DataFrame:
    return per.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")])


def micro(per: DataFrame) -> DataFrame:
    s = per.agg(F.sum("tp").alias("tp"), F.sum("n_pred").alias("np"), F.sum("n_gold").alias("ng"))
    p, r = F.col("tp") / F.nullif(F.col("np"), F.lit(0)), F.col("tp") / F.nullif(F.col("ng"), F.lit(0))
    s = s.select(F.coalesce(p, F.lit(0.0)).alias("precision"), F.coalesce(r, F.lit(0.0)).alias("recall"))
    return s.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-300))))


def mean_recall_precision(ranked: DataFrame, gold: DataFrame, k: int | None = None) -> DataFrame:
    """Mean recall over the gold list as it stands, repeats included, and mean precision over predictions, 0 without any;
    then the F1 of the two means."""
    some = ranked if k is None else ranked.where(F.col("rank") <= k)
    size = gold.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    p = some.select("query_id", "citation").distinct()
    n = p.groupBy("query_id").agg(F.count("*").alias("n_pred"))
    tp = p.join(gold.select("query_id", "citation").distinct(), ["query_id", "citation"]).groupBy("query_id").agg(F.count("*").alias("tp"))
    rows = size.join(n, "query_id", "left").join(tp, "query_id", "left").na.fill(0)
    means = rows.agg(F.avg(F.col("tp") / F.col("n_gold")).alias("recall"), F.avg(F.when(F.col("n_pred") == 0, 0.0).otherwise(F.col("tp") / F.greatest("n_pred", F.lit(1)))).alias("precision"))
    return means.withColumn("f1_of_means", F.when(F.col("recall") + F.col("precision") == 0, 0.0).otherwise(2 * F.col("recall") * F.col("precision") / F.greatest(F.col("recall") + F.col("precision"), F.lit(1e-300))))


def ranking(labelled: DataFrame, k: int, count_misses: bool = False) -> DataFrame:
    """MRR, recall@k and NDCG@k of labelled (query_id, rank, label): recall is over positives among the candidates. Queries
    without a positive are skipped; with count_misses their reciprocal rank counts 0."""
    gain = F.col("label") / F.log2(F.col("rank") + 1.0)
    ideal = Window.partitionBy("query_id").orderBy(F.desc("label"), "rank")
    rows = labelled.withColumn("ideal", F.row_number().over(ideal))
    q = rows.groupBy("query_id").agg(
        F.sum("label").alias("n"),
        F.min(F.when(F.col("label") > 0, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rank") <= k, F.col("label")).otherwise(0)).alias("hits"),
        F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("ideal") <= k, F.col("label") / F.log2(F.col("ideal") + 1.0)).otherwise(0.0)).alias("best"),
    )
    has = F.col("n") > 0
    mrr = F.when(has, 1.0 / F.col("first")).otherwise(F.lit(0.0) if count_misses else None)
    return q.agg(F.coalesce(F.avg(mrr), F.lit(0.0)).alias("mrr"), F.coalesce(F.avg(F.when(has, F.col("hits") / F.greatest("n", F.lit(1)))), F.lit(0.0)).alias("recall_at_k"), F.coalesce(F.avg(F.when(has, F.col("dcg") / F.greatest("best", F.lit(1e-300)))), F.lit(0.0)).alias("ndcg_at_k"))


def f1_at_k(labelled: DataFrame, n_gold: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), by_candidates: bool = True) -> DataFrame:
    """Mean F1 with the k best as predictions: precision over k, or over min(k, candidates). labelled (…, rank, label),
    n_gold (…, n_gold). Groups without candidates are skipped."""
    q = labelled.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.when(F.col("rank") <= k, F.col("label")).otherwise(0)).alias("tp")).join(n_gold, list(by))
    base = F.least(F.lit(k), F.col("n")) if by_candidates else F.lit(k)
    p, r = F.col("tp") / base, F.col("tp") / F.greatest("n_gold", F.lit(1))
    return q.select(F.when(F.col("tp") == 0, 0.0).otherwise(2 * p * r / F.greatest(p + r, F.lit(1e-300))).alias("f1")).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("f1_at_k"))


def auc(scored: DataFrame) -> DataFrame:
    """ROC AUC by rank sums (ties share their mean rank) and accuracy at 0.5 of (score, label). Ranks come from counts of
    equal scores and of buckets of scores, so no task gets all rows, nor all distinct scores."""
    c = scored.groupBy("score").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    # Counts below a score: those of lower buckets, of which there are at most 4096, and those within its own.
    bounds = c.agg(F.min("score").alias("_low"), F.max("score").alias("_high"))
    c = c.crossJoin(F.broadcast(bounds)).withColumn("_b", F.when(F.col("_high") > F.col("_low"), F.floor((F.col("score") - F.col("_low")) / (F.col("_high") - F.col("_low")) * 4095)).otherwise(0))
    lower = c.groupBy("_b").agg(F.sum("n").alias("_all")).withColumn("_under", F.sum("_all").over(Window.orderBy("_b")) - F.col("_all")).select("_b", "_under")
    inner = F.sum("n").over(Window.partitionBy("_b").orderBy("score")) - F.col("n")
    r = c.withColumn("_in", inner).join(F.broadcast(lower), "_b").withColumn("mean", F.col("_under") + F.col("_in") + (F.col("n") + 1) / 2)
    s = r.agg(F.sum(F.col("mean") * F.col("pos")).alias("ranks"), F.sum("pos").alias("p"), F.sum("n").alias("n"), F.sum(F.when(F.col("score") >= 0.5, F.col("pos")).otherwise(F.col("n") - F.col("pos"))).alias("right"))
    p, n = F.col("p").cast("double"), (F.col("n") - F.col("p")).cast("double")
    return s.select(F.when((p > 0) & (n > 0), (F.col("ranks") - p * (p + 1) / 2) / F.greatest(p * n, F.lit(1.0))).alias("auc"), (F.col("right") / F.col("n")).alias("accuracy"))


def average_precision(labelled: DataFrame) -> DataFrame:
    """Mean over queries of the mean precision at each positive: labelled (query_id, rank, label)."""
    seen = F.sum("label").over(Window.partitionBy("query_id").orderBy("rank"))
    at = labelled.withColumn("p", F.when(F.col("label") > 0, seen / F.col("rank")))
    return at.groupBy("query_id").agg(F.avg("p").alias("ap")).agg(F.avg("ap").alias("map"))


def limit_sweep(ranked: DataFrame, gold: DataFrame, queries: DataFrame, limits: list[int]) -> DataFrame:
    """Macro F1 for each cut: (limit, f1). One pass: the ranked rows are repeated for the limits that hold them."""
    p = ranked.select("query_id", "citation", "rank")
    g = gold.select("query_id", "citation").distinct()
    size = g.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    marked = p.join(g.withColumn("hit", F.lit(1)), ["query_id", "citation"], "left").na.fill(0, ["hit"])
    each = marked.withColumn("limit", F.explode(F.array(*map(F.lit, limits)))).where(F.col("rank") <= F.col("limit"))
    n = each.groupBy("query_id", "limit").agg(F.count("*").alias("n_pred"), F.sum("hit").alias("tp"))
    all_of = queries.select("query_id").distinct().withColumn("limit", F.explode(F.array(*map(F.lit, limits))))
    rows = all_of.join(n, ["query_id", "limit"], "left").join(size, "query_id", "left").na.fill(0, ["n_pred", "tp", "n_gold"])
    f1 = F.when((F.col("n_pred") == 0) & (F.col("n_gold") == 0), 1.0).when(F.col("tp") == 0, 0.0).otherwise(2 * F.col("tp") / (F.col("n_pred") + F.col("n_gold")))
    return rows.withColumn("f1", f1).groupBy("limit").agg(F.avg("f1").alias("f1"))


def gold_coverage(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """Of (query_id, doc_id, citation) candidates: the share of (query, document) pairs with a gold citation, and queries with
    any."""
    g = gold.select("query_id", "citation").distinct().withColumn("hit", F.lit(1))
    pairs = candidates.join(g, ["query_id", "citation"], "left").groupBy("query_id", "doc_id").agg(F.max(F.coalesce("hit", F.lit(0))).alias("has"))
    q = pairs.groupBy("query_id").agg(F.sum("has").alias("docs"), F.count("*").alias("n"))
    return q.agg(F.sum("docs").alias("with_gold"), F.sum("n").alias("pairs"), F.sum((F.col("docs") > 0).cast("int")).alias("queries_with_gold"))


def recall_filter(predicted: DataFrame, gold: DataFrame, least: float = 0.5) -> DataFrame:
    """(query_id, recall) of the queries of which at least that share of the gold citations is predicted; queries without
    gold go."""
    g, p = gold.select("query_id", "citation").distinct(), predicted.select("query_id", "citation").distinct()
    marked = g.join(p.withColumn("hit", F.lit(1)), ["query_id", "citation"], "left")
    return marked.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall")).where(F.col("recall") >= least)


#: Characters of a citation's beginning that find it in texts; each has the greatest of these that it is as long as.
KEY_LENGTHS = (8, 12, 16, 20)
#: Different beginnings of four characters up to which a text is sought for them alone.
FEW_BEGINNINGS = 200


def containment(docs: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, docs, with_gold, containments): documents of a query, those whose text contains a gold citation of it, and
    pairs of both. docs (query_id, doc_id, text), gold (query_id, citation). What follows in a text where a citation may begin
    meets the query's citations that begin alike; only citations shorter than any key meet all of the query's texts."""
    least = KEY_LENGTHS[0]
    g = gold.select("query_id", "citation").where("citation is not null").distinct()
    keyed = g.where(F.length("citation") >= least)
    starts = [r[0] for r in keyed.select(F.substring("citation", 1, 4)).distinct().limit(FEW_BEGINNINGS + 1).collect()]
    longest = keyed.agg(F.max(F.length("citation"))).first()[0] or least
    quoted = lambda t: "".join(c if c.isalnum() or c == " " else rf"\x{{{ord(c):x}}}" for c in t)
    some = f"(?:{'|'.join(map(quoted, starts))})" if len(starts) <= FEW_BEGINNINGS else ".{4}"
    at = F.regexp_extract_all("text", F.lit(rf"(?s)(?=({some}.{{{least - 4},{longest - 4}}}))"), F.lit(1))
    places = docs.select("query_id", "doc_id", F.explode(F.array_distinct(at)).alias("s"))
    places = places.select("*", F.explode(F.array(*[F.lit(n) for n in KEY_LENGTHS])).alias("n")).where(F.length("s") >= F.col("n"))
    size = F.lit(least)
    for n in KEY_LENGTHS[1:]:
        size = F.when(F.length("citation") >= n, n).otherwise(size)
    begin = lambda c, n: F.substring(F.col(c), F.lit(1), n)
    keys = keyed.withColumn("n", size).select("query_id", "citation", "n", begin("citation", F.col("n")).alias("key"))
    pairs = places.withColumn("key", begin("s", F.col("n"))).join(keys, ["query_id", "n", "key"]).where(F.startswith("s", "citation"))
    short = docs.join(g.where(F.length("citation") < least), "query_id").where(F.contains("text", "citation"))
    pairs = pairs.select("query_id", "doc_id", "citation").distinct().unionByName(short.select("query_id", "doc_id", "citation"))
    found = pairs.groupBy("query_id", "doc_id").agg(F.count("*").alias("n"))
    rows = docs.select("query_id", "doc_id").join(found, ["query_id", "doc_id"], "left")
    return rows.groupBy("query_id").agg(F.count("*").alias("docs"), F.count("n").alias("with_gold"), F.coalesce(F.sum("n"), F.lit(0)).alias("containments"))


def f1_by_document(rows: DataFrame, k: int, most: int = 100) -> DataFrame:
    """Mean F1@k over (query, document) pairs that have a gold citation: rows (query_id, doc_id, citation, score, label), of
    each pair at most ``most`` candidates, gold ones first."""
    key = ["query_id", "doc_id"]
    some = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("label"), F.desc("score"), "citation"))).where(F.col("_n") <= most).drop("_n")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "citation")))
    n_gold = rows.groupBy(*key).agg(F.sum("label").alias("n_gold")).where("n_gold > 0")
    return f1_at_k(ranked, n_gold, k, by=("query_id", "doc_id"))
