"""Deterministic sampling, splits and pair mining: a hash of the key and a seed orders rows, never a random generator."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(seed: int, *columns: str) -> Column:
    """MD5 of the seed and the columns as text: the same in any engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def downsample(rows: DataFrame, ratio: int = 10, seed: int = 42) -> DataFrame:
    """All positives and at most ratio times as many negatives of each query; ratio -1 keeps all. rows (query_id, citation,
    label)."""
    if ratio < 0:
        return rows
    pos = F.sum("label").over(Window.partitionBy("query_id"))
    order = Window.partitionBy("query_id", "label").orderBy(order_key(seed, "query_id", "citation"), "citation")
    return rows.withColumn("_p", pos).withColumn("_n", F.row_number().over(order)).where((F.col("label") == 1) | (F.col("_n") <= ratio * F.col("_p"))).drop("_p", "_n")


def min_positives(rows: DataFrame, least: int = 1) -> DataFrame:
    return rows.withColumn("_p", F.sum("label").over(Window.partitionBy("query_id"))).where(F.col("_p") >= least).drop("_p")


def hard_first(rows: DataFrame, hard: int, total: int, score: str = "score", seed: int = 42) -> DataFrame:
    """All positives; of the negatives the ``hard`` of greatest score and others by hash, up to ``total``."""
    w = Window.partitionBy("query_id", "label")
    ranked = rows.withColumn("_h", F.row_number().over(w.orderBy(F.desc(score), "citation")))
    late = F.when(F.col("_h") <= hard, F.lit("")).otherwise(order_key(seed, "query_id", "citation"))
    picked = ranked.withColumn("_k", late).withColumn("_n", F.row_number().over(w.orderBy("_k", "_h")))
    return picked.where((F.col("label") == 1) | (F.col("_n") <= total)).drop("_h", "_k", "_n")


def hardness(rerank: str, bm25: str, hit: str, kw: str, density: str) -> Column:
    return F.col(rerank) + F.col(bm25) + F.col(hit) + 0.3 * F.col(kw) - 0.5 * F.col(density)


def before_first_positive(ranked: DataFrame) -> DataFrame:
    """Negatives ranked before the query's first positive: ranked (query_id, citation, rank, label)."""
    first = F.min(F.when(F.col("label") == 1, F.col("rank"))).over(Window.partitionBy("query_id"))
    return ranked.withColumn("_f", first).where((F.col("label") == 0) & (F.col("rank") < F.col("_f"))).drop("_f")


def near_positives(ranked: DataFrame, half: int) -> DataFrame:
    """Rows within ``half`` ranks of a positive."""
    near = F.max("label").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(-half, half))
    return ranked.withColumn("_p", near).where("_p = 1").drop("_p")


def pairwise(rows: DataFrame, gold: DataFrame, window: int = 2, per_gold: int = 2, docs: int = 3, randoms: int = 1, seed: int = 42) -> DataFrame:
    """Training pairs (query_id, doc_id, pos, neg, source): negatives within ``window`` sentences of the gold citation in
    its document ("hard"), from the ``docs`` best documents without gold ("inter_doc"), and any other of the query
    ("random"); at most per_gold, per_gold, randoms for each (document, gold). rows (query_id, doc_id, citation,
    pos, score)."""
    g = gold.select("query_id", "citation").distinct().withColumn("gold", F.lit(1))
    rows = rows.groupBy("query_id", "doc_id", "citation").agg(F.min("pos").alias("at"), F.max("score").alias("score"))
    m = rows.join(g, ["query_id", "citation"], "left").withColumn("gold", F.coalesce("gold", F.lit(0)))
    pos = m.where("gold = 1").select("query_id", "doc_id", F.col("citation").alias("pos"), F.col("at").alias("pos_at"))
    neg = m.where("gold = 0")

    def take(pairs: DataFrame, n: int, source: str, order: list) -> DataFrame:
        w = Window.partitionBy("query_id", "doc_id", "pos").orderBy(*order)
        return pairs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).select("query_id", "doc_id", "pos", "neg", F.lit(source).alias("source"))

    near = pos.join(neg.select("query_id", "doc_id", F.col("citation").alias("neg"), "at"), ["query_id", "doc_id"]).where(F.abs(F.col("at") - F.col("pos_at")) <= window)
    hard = take(near, per_gold, "hard", [F.abs(F.col("at") - F.col("pos_at")), F.col("neg")])
    free = m.groupBy("query_id", "doc_id").agg(F.max("gold").alias("g"), F.max("score").alias("s")).where("g = 0")
    free = free.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "doc_id"))).where(F.col("n") <= docs).select("query_id", F.col("doc_id").alias("other"))
    pool = free.join(neg.select("query_id", F.col("doc_id").alias("other"), F.col("citation").alias("neg")), ["query_id", "other"]).select("query_id", "neg").distinct()
    # Each (document, gold) needs the first per_gold of its query by hash: the pool keeps no more than that.
    small = pool.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(order_key(seed, "query_id", "neg"), "neg"))).where(F.col("_n") <= per_gold).drop("_n")
    inter = take(pos.join(small, "query_id"), per_gold, "inter_doc", [F.col("neg")])
    every = neg.select("query_id", F.col("citation").alias("neg")).distinct()
    few = every.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(order_key(seed + 1, "query_id", "neg"), "neg"))).where(F.col("_n") <= randoms).drop("_n")
    rand = take(pos.join(few, "query_id"), randoms, "random", [F.col("neg")])
    return hard.unionByName(inter).unionByName(rand)


def cross_query_negatives(gold: DataFrame, per_positive: int = 2, seed: int = 42) -> DataFrame:
    """(query_id, neg): for each gold citation ``per_positive`` citations of other queries, by hash, or all there are.
    Citations lie on a ring in the order of their hashes; each query takes those that follow its own hash and aren't
    its own."""
    g = gold.select("query_id", "citation").distinct()
    cited = g.where("citation is not null").select("citation").distinct().withColumn("_k", order_key(seed, "citation")).withColumn("_b", F.substring("_k", 1, 2))
    # Places on the ring: those of a bucket follow all of the buckets before it, at most 256.
    ends = cited.groupBy("_b").agg(F.count("*").alias("_m")).withColumn("_end", F.sum("_m").over(Window.orderBy("_b")))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_k", "citation")) - 1
    ring = cited.withColumn("_r", place).join(F.broadcast(ends), "_b").select((F.col("_end") - F.col("_m") + F.col("_r")).alias("_at"), F.col("citation").alias("neg"))
    total = ends.agg(F.max("_end").alias("_total"))
    # Of (per_positive + 1) * n successive places a query's own citations take n at most, so enough are left.
    asked = g.groupBy("query_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).where("_total > 0")
    steps = F.sequence(F.lit(0).cast("long"), F.least((per_positive + 1) * F.col("n"), F.col("_total")) - 1)
    walk = asked.select("query_id", "n", "_total", F.explode(steps).alias("_i"))
    start = F.crc32(F.concat_ws("|", F.lit(str(seed)), F.col("query_id").cast("string")))
    walk = walk.where("query_id is not null").withColumn("_at", F.pmod(start + F.col("_i"), F.col("_total")))
    pairs = walk.join(ring, "_at").join(g.select("query_id", F.col("citation").alias("neg")), ["query_id", "neg"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("_i")
    return pairs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_positive * F.col("n")).select("query_id", "neg")


def groups_of(rows: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """(query_id, pos, neg, slot): every positive with size - 1 negatives of its query, repeated from the start if short."""
    neg = rows.where("label = 0").withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(order_key(seed, "query_id", "citation"), "citation")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("query_id"))).where(F.col("i") < size - 1)
    pos = rows.where("label = 1").select("query_id", F.col("citation").alias("pos"), F.explode(F.sequence(F.lit(0), F.lit(size - 2))).alias("slot"))
    count = neg.select("query_id", F.least("n", F.lit(size - 1)).alias("n")).distinct()
    return pos.join(count, "query_id").withColumn("i", F.pmod("slot", "n")).join(neg.select("query_id", "i", F.col("citation").alias("neg")), ["query_id", "i"]).select("query_id", "pos", "neg", "slot")


def split_by_query(rows: DataFrame, shares: tuple[float, ...] = (0.8, 0.1, 0.1), names: tuple[str, ...] = ("train", "valid", "test"), seed: int = 42) -> DataFrame:
    """rows with split: all rows of a query in one, by the CRC of the seed and query_id."""
    u = F.pmod(F.crc32(F.concat_ws("|", F.lit(str(seed)), F.col("query_id").cast("string"))), F.lit(1000)) / 1000.0
    out, total = F.lit(names[-1]), 1.0 - shares[-1]
    for name, share in list(zip(names, shares))[-2::-1]:
        out = F.when(u < total, name).otherwise(out)
        total -= share
    return rows.withColumn("split", out)


def group_folds(rows: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    return rows.withColumn("fold", F.pmod(F.crc32(F.concat_ws("|", F.lit(str(seed)), F.col("query_id").cast("string"))), F.lit(folds)).cast("int"))


def group_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("query_id").agg(F.count("*").alias("n"))


def top_negatives(ranked: DataFrame, ratio: int = 6) -> DataFrame:
    """All positives and, in order of rank, ratio times as many negatives of each query: ranked (query_id, citation, rank,
    label)."""
    n = F.sum("label").over(Window.partitionBy("query_id"))
    order = Window.partitionBy("query_id", "label").orderBy("rank")
    return ranked.withColumn("_p", n).withColumn("_n", F.row_number().over(order)).where((F.col("label") == 1) | (F.col("_n") <= ratio * F.col("_p"))).drop("_p", "_n")


def balanced_weights(rows: DataFrame) -> DataFrame:
    """rows with weight: both labels weigh alike, and all weights sum to the number of rows."""
    n = rows.groupBy("label").agg(F.count("*").alias("_c"))
    total = n.agg(F.sum("_c").alias("_n"), F.count("*").alias("_k"))
    return rows.join(F.broadcast(n.crossJoin(total).select("label", (F.col("_n") / (F.col("_k") * F.col("_c"))).alias("weight"))), "label")


def weighted_draws(rows: DataFrame, n: int, id: str = "id", weight: str = "weight", buckets: int = 1024, seed: int = 42) -> DataFrame:
    """n draws with replacement, each row by its weight: (draw from 0, id). Weights are counted in 2**-20; none, null or
    negative ones are never drawn. ids are unique.

    All rows lie end to end on a line; a draw is a point on it, by hash. The few rows of more than a bucket's mean weight come
    first and are looked up; the others lie in their buckets, in which one pass over rows and draws by place settles all.
    """
    digits = lambda k, n: F.conv(F.substring(k, 1, n), 16, 10).cast("long")
    some = rows.select(F.col(id).alias("id"), F.round(F.col(weight) * (1 << 20)).cast("long").alias("w")).where("w > 0").withColumn("bucket", digits(order_key(seed, "id"), 4) % buckets)
    total = some.agg(F.sum("w")).first()[0] or 0
    spark = rows.sparkSession
    if not total:
        return some.select(F.lit(0).cast("long").alias("draw"), F.col("id").alias(id)).limit(0)
    heavy = some.where(F.col("w") * buckets > total).orderBy("id").select("id", "w").collect()  # fewer than buckets
    light = some.where(F.col("w") * buckets <= total)
    sums = {r["bucket"]: r["w"] for r in light.groupBy("bucket").agg(F.sum("w").alias("w")).collect()}  # at most buckets
    heavy_ends = np.cumsum([r["w"] for r in heavy], dtype=np.int64)
    names = sorted(sums)
    ends = (int(heavy_ends[-1]) if heavy else 0) + np.cumsum([sums[b] for b in names], dtype=np.int64)

    @F.pandas_udf("struct<heavy: long, bucket: long, place: long>")
    def where(points: pd.Series) -> pd.DataFrame:
        p = points.to_numpy(np.int64)
        i, j = np.searchsorted(heavy_ends, p, side="right"), np.searchsorted(ends, p, side="right")
        is_heavy = i < len(heavy_ends)
        low = np.concatenate([[heavy_ends[-1] if len(heavy_ends) else 0], ends])
        return pd.DataFrame({"heavy": np.where(is_heavy, i, -1), "bucket": np.where(is_heavy, -1, np.array([*names, -1])[j]), "place": p - low[np.minimum(j, len(low) - 1)]})

    point = F.floor(digits(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("draw"), F.col("draw").cast("string"))), 13) / float(1 << 52) * float(total)).cast("long")
    draws = spark.range(n).select(F.col("id").alias("draw")).withColumn("at", where(point)).select("draw", "at.*")
    kind = dict(some.dtypes)["id"]
    told = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(heavy)], f"heavy long, id {kind}")
    first = draws.where("heavy >= 0").join(F.broadcast(told), "heavy").select("draw", "id")
    start = F.sum("w").over(Window.partitionBy("bucket").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    lines = light.select("bucket", F.coalesce(start, F.lit(0)).alias("place"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("draw"), "id")
    points = draws.where("heavy < 0").select("bucket", "place", F.lit(1).alias("kind"), "draw", F.lit(None).cast(kind).alias("id"))
    last = F.last("id", ignorenulls=True).over(Window.partitionBy("bucket").orderBy("place", "kind", "draw").rowsBetween(Window.unboundedPreceding, 0))
    others = lines.unionByName(points).withColumn("id", last).where("draw is not null").select("draw", "id")
    return first.unionByName(others).withColumnRenamed("id", id)


def of_split(records: DataFrame, pairs: DataFrame, id: str = "query_id") -> DataFrame:
    """The records whose id some pair has."""
    return records.join(pairs.select(id).distinct(), id, "left_semi")


def in_context(rows: DataFrame, gold: DataFrame, window: int = 2, most: int = 4, total: int = 6, least: float | None = None, seed: int = 42) -> DataFrame:
    """(query_id, doc_id, pos, neg, source): for each gold citation of a document up to ``most`` other citations within
    ``window`` sentences ("in_context"), by hash; filled up to ``total`` with citations that are gold for nobody ("random").
    rows (query_id, doc_id, citation, pos, score); documents below ``least`` go."""
    if least is not None:
        rows = rows.where(F.col("score") >= least)
    g = gold.select("query_id", "citation").distinct().withColumn("gold", F.lit(1))
    at = rows.groupBy("query_id", "doc_id", "citation").agg(F.min("pos").alias("at"))
    m = at.join(g, ["query_id", "citation"], "left").withColumn("gold", F.coalesce("gold", F.lit(0)))
    pos = m.where("gold = 1").select("query_id", "doc_id", F.col("citation").alias("pos"), F.col("at").alias("pos_at"))
    near = pos.join(m.where("gold = 0").select("query_id", "doc_id", F.col("citation").alias("neg"), "at"), ["query_id", "doc_id"]).where(F.abs(F.col("at") - F.col("pos_at")) <= window)
    order = Window.partitionBy("query_id", "doc_id", "pos").orderBy(order_key(seed, "query_id", "doc_id", "pos", "neg"), "neg")
    near = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select("query_id", "doc_id", "pos", "neg")
    have = near.groupBy("query_id", "doc_id", "pos").agg(F.count("*").alias("_c"))
    lack = pos.join(have, ["query_id", "doc_id", "pos"], "left").withColumn("_c", total - F.coalesce("_c", F.lit(0))).where("_c > 0")
    # A ring of the citations that are nobody's gold; each pair takes those that follow its own hash.
    free = rows.select("citation").distinct().join(g.select("citation").distinct(), "citation", "left_anti").withColumn("_k", order_key(seed, "citation")).withColumn("_b", F.substring("_k", 1, 2))
    ends = free.groupBy("_b").agg(F.count("*").alias("_m")).withColumn("_end", F.sum("_m").over(Window.orderBy("_b")))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_k", "citation")) - 1
    ring = free.withColumn("_r", place).join(F.broadcast(ends), "_b").select((F.col("_end") - F.col("_m") + F.col("_r")).alias("_at"), F.col("citation").alias("neg"))
    size = ends.agg(F.max("_end").alias("_total"))
    # ``most`` of its own may lie in the way, so that many more places are looked at.
    walk = lack.crossJoin(F.broadcast(size)).where("_total > 0").withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("_c") + most, F.col("_total")) - 1)))
    start = F.crc32(F.concat_ws("|", F.lit(str(seed)), "query_id", "doc_id", "pos"))
    fill = walk.withColumn("_at", F.pmod(start + F.col("_i"), F.col("_total"))).join(ring, "_at").join(near, ["query_id", "doc_id", "pos", "neg"], "left_anti")
    fill = fill.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "doc_id", "pos").orderBy("_i"))).where(F.col("_n") <= F.col("_c"))
    return near.withColumn("source", F.lit("in_context")).unionByName(fill.select("query_id", "doc_id", "pos", "neg", F.lit("random").alias("source")))
