"""Evidence, weighted draws and the cache of scores."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from quillrank.operators import evidence, sampling
from quillrank.sources import cache


def test_draws_follow_weights(spark):
    """One row has half of all weight; draws are the same for any partitioning, and near what is expected."""
    rows = [(i, w) for i, w in enumerate([50.0, *[0.5] * 90, *[5.0]])] + [(200, 0.0), (201, None), (202, -1.0)]
    df = spark.createDataFrame(rows, "id long, weight double")
    n = 20_000
    got = sampling.weighted_draws(df, n, buckets=16)
    one = sorted(map(tuple, got.collect()))
    assert one == sorted(map(tuple, sampling.weighted_draws(df.repartition(7), n, buckets=16).collect())) and [d for d, _ in one] == list(range(n))
    count = collections.Counter(i for _, i in one)
    for i, w in rows:
        mean = n * max(w or 0, 0) / 100
        assert abs(count[i] - mean) <= 5 * mean**0.5
    assert one != sorted(map(tuple, sampling.weighted_draws(df, n, buckets=16, seed=1).collect()))
    assert sampling.weighted_draws(df.where("id >= 200"), 5).count() == 0


def test_seeds_ask_until_they_have_enough(spark):
    """The nearest documents are all gold; k grows for the seed that needs it alone."""
    vectors = spark.createDataFrame([(i, [1.0 - i / 100, 0.0]) for i in range(40)], "doc_id int, v array<double>")
    seeds = spark.createDataFrame([(1, 7, [1.0, 0.0]), (2, 8, [1.0, 0.0]), (3, 9, [1.0, 0.0])], "query_id int, seed int, v array<double>")
    gold = spark.createDataFrame([(1, i) for i in range(12)] + [(3, i) for i in range(38)], "query_id int, doc_id int")
    asked = []

    def search(queries, docs, k):
        from quillrank.operators.retrieval import dense_search

        asked.append((k, queries.count()))
        return dense_search(queries, docs, k)

    got = evidence.seeded_negatives(seeds, vectors, gold, 3, search).orderBy("query_id", "rank")
    assert [(r["query_id"], r["doc_id"]) for r in got.collect()] == [(1, 12), (1, 13), (1, 14), (2, 0), (2, 1), (2, 2), (3, 38), (3, 39)]
    assert asked == [(3, 3), (6, 2), (12, 2), (24, 2), (40, 1)]


def test_seeds_apart_by_label(spark):
    """The same as with gold in a table, by one search; null labels are no one's."""
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(3)], i % 4 if i % 9 else 0) for i in range(80)]
    vectors = spark.createDataFrame(rows, "doc_id int, v array<double>, label int").repartition(3)
    seeds = vectors.where("doc_id < 12").select((F.col("doc_id") % 3).alias("query_id"), F.col("doc_id").alias("seed"), "v", "label")
    gold = seeds.select("query_id", "seed", "label").join(vectors, "label").select(F.struct("query_id", "seed").alias("query_id"), "doc_id")
    named = seeds.select(F.struct("query_id", "seed").alias("query_id"), "seed", "v")
    flat = lambda df: sorted((r["query_id"], r["seed"], r["doc_id"], r["rank"]) for r in df.collect())
    want = flat(evidence.seeded_negatives(named, vectors.select("doc_id", "v"), gold, 4).select("query_id.query_id", "seed", "doc_id", "rank"))
    assert flat(evidence.seeded_apart(seeds, vectors, 4)) == want and len(want) == 48
    null = spark.createDataFrame([(99, rows[0][1], None)], vectors.schema)
    assert flat(evidence.seeded_apart(seeds, vectors.unionByName(null), 4)) == want


def test_evidence_that_searches(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, doc_id int, rank int")
    edges = spark.createDataFrame([(10, "g", 0), (10, "x", 1), (11, "y", 0), (12, "g", 3), (13, "z", 2), (13, "z", 5)], "doc_id int, citation string, pos int")
    gold = spark.createDataFrame([(1, "g")], "query_id int, citation string")
    vectors = spark.createDataFrame([(10, [1.0]), (12, [0.9]), (13, [0.8]), (11, [0.1])], "doc_id int, v array<double>")
    places = spark.createDataFrame([(10, 0, [1.0])], "doc_id int, place int, v array<double>")
    got = {tuple(r) for r in evidence.by_evidence(ranked, edges, gold, vectors, places, k=1).collect()}
    assert got == {(1, 10, 0, 1, "gold"), (1, 13, 2, 0, "hard")}  # 12 is near, but gold


def test_cache_computes_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    kept = cache.Cache(spark, str(tmp_path / "c"), "length, 1")

    def score(rows):
        length = F.udf(lambda t: seen.add(1) or float(len(t or "")), "double")
        return rows.select("key", length("text").alias("value"))

    docs = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "bb"), (4, None), (5, "")], "id int, text string")
    assert kept.known().count() == 0
    first = sorted((r["id"], r["score"]) for r in kept.scored(docs.where("id < 3"), ["text"], score).collect())
    assert first == [(1, 1.0), (2, 2.0)] and seen.value == 2
    assert sorted((r["id"], r["score"]) for r in kept.scored(docs, ["text"], score).collect()) == [(1, 1.0), (2, 2.0), (3, 2.0), (4, 0.0), (5, 0.0)]
    assert seen.value == 4 and kept.fill(docs, ["text"], score) is None
    assert cache.Cache(spark, str(tmp_path / "c"), "length, 2").fill(docs, ["text"], score) is not None


def test_cache_shows_whole_runs_only(spark, tmp_path):
    kept = cache.Cache(spark, str(tmp_path / "c"), "s")
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "id int, text string").repartition(4)

    def broken(rows):
        return rows.select("key", F.when(F.col("text") == "t7", F.raise_error(F.lit("lost"))).otherwise(1.0).cast("double").alias("value"))

    with pytest.raises(Exception, match="lost"):
        kept.fill(docs, ["text"], broken)
    assert kept.known().count() == 0
    # Two writers that don't see each other's run compute the same keys.
    ready = []
    two = cache.Cache(spark, str(tmp_path / "c"), "s")
    two.publish = ready.append
    two.fill(docs, ["text"], lambda rows: rows.select("key", F.lit(2.0).alias("value")))
    assert kept.known().count() == 0
    one = kept.fill(docs, ["text"], lambda rows: rows.select("key", F.lit(1.0).alias("value")))
    kept.publish(ready[0])
    rows = kept.known().collect()
    assert len(rows) == 20 and {r["value"] for r in rows} == {1.0 if one < ready[0] else 2.0}
