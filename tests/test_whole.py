"""Queries that once left rows out."""

from collections import Counter

import numpy as np
import pytest

from quillrank.operators import sampling
from quillrank.plans import retrieval as plans


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """Vectors 0 and 50, both queries, are copies; the others lie about ten centres."""
    d = str(tmp_path_factory.mktemp("vectors"))
    rnd = np.random.default_rng(3)
    v = rnd.normal(size=(10, 16))[np.arange(300) % 10] + 0.1 * rnd.normal(size=(300, 16))
    v[50] = v[0]
    v /= np.linalg.norm(v, axis=1)[:, None]
    spark.createDataFrame([(i, v[i].tolist(), i % 10) for i in range(300)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


def test_vectors_of_queries_are_found_too(spark, vectors):
    pairs = {(r["query_id"], r["doc_id"]) for r in plans.lsh_pairs(spark, vectors).collect()}
    assert (0, 50) in pairs and (50, 0) in pairs and all(a != b for a, b in pairs)
    found = {(r["query_id"], r["doc_id"]) for r in plans.cluster_expand_kmeans(spark, vectors).collect()}
    assert (0, 50) in found and (50, 0) in found


def test_clusters_and_projection_take_all_vectors(spark, vectors):
    stats = plans.cluster_size_stats(spark, vectors).first()
    assert round(stats["mean"] * stats["clusters"]) == 300
    assert {r["doc_id"] for r in plans.pca_projection(spark, vectors).collect()} == set(range(300))


def test_each_gold_citation_has_its_negatives(spark):
    gold = {(1, c) for c in range(700)} | {(q, c) for q in range(2, 30) for c in range(1000 + 60 * q, 1060 + 60 * q)} | {(30, 5), (31, 3000)}
    df = spark.createDataFrame(sorted(gold), "query_id long, citation long")
    got = [(r["query_id"], r["neg"]) for r in sampling.cross_query_negatives(df).collect()]
    assert len(got) == len(set(got)) and not set(got) & gold
    own, every = Counter(q for q, _ in gold), len({c for _, c in gold})
    assert Counter(q for q, _ in got) == {q: min(2 * n, every - n) for q, n in own.items()}
    few = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 3)], "query_id long, citation long")
    assert sorted(map(tuple, sampling.cross_query_negatives(few.repartition(3)).collect())) == [(1, 3), (2, 1), (2, 3), (3, 1), (3, 2)]
