"""Rows that become many more are made where they are read, and aren't shuffled."""

import pytest
from pyspark.sql import functions as F

from quillrank.operators import citations, features, retrieval


def shuffled_after_join(df):
    """Whether pairs are grouped, and so dealt by their key, after the join."""
    return "keys=[query_id" in df._jdf.queryExecution().sparkPlan().toString()


def test_members_of_clusters(spark):
    clusters = spark.createDataFrame([(i, i % 3) for i in range(30)] + [(40, None)], "doc_id long, cluster long")
    chosen = spark.createDataFrame([(7, 0), (7, 1), (8, 1), (9, 5)], "query_id long, cluster long")
    want = {(q, i) for q, cs in ((7, {0, 1}), (8, {1})) for i in range(30) if i % 3 in cs}
    got = retrieval.members(chosen, clusters, block=2)
    assert sorted(map(tuple, got.collect())) == sorted(want) and not shuffled_after_join(got)
    twice = clusters.unionByName(spark.createDataFrame([(0, 1), (1, 1), (2, 1)], "doc_id long, cluster long"))
    assert sorted(map(tuple, retrieval.members(chosen, twice).collect())) == sorted(want | {(7, 2), (8, 0), (8, 2)})
    assert retrieval.members(chosen.where("query_id = 0"), clusters).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i, i % 2, [((i * 7 + j * 3) % 11) / 3.0 for j in range(4)]) for i in range(12)] + [(12, None, [1.0] * 4), (13, 1, None), (14, 0, [1.0, None, 0.0, 1.0])]
    return spark.createDataFrame(rows, "id long, label long, v array<float>")


def test_late_interaction_within_groups(spark, vectors):
    q, d = vectors.where("id % 3 = 1").withColumnRenamed("id", "query_id"), vectors.withColumnRenamed("id", "doc_id")
    got = retrieval.scored_within(q, d, "label", retrieval.late(2), block=2)
    cut = F.array(F.slice("v", 1, 2), F.slice("v", 3, 2)).alias("vectors")
    pairs = q.select("query_id", "label").join(d.where("doc_id < 13").select("doc_id", "label", cut), "label").where("query_id != doc_id").drop("label")
    want = {(r[0], r[1]): r[2] for r in retrieval.max_sim(q.where("v is not null").select("query_id", cut), pairs).collect()}
    rows = {(r["query_id"], r["doc_id"]): r["score"] for r in got.collect()}
    assert {k: s for k, s in rows.items() if s is not None} == {k: s for k, s in want.items() if k[0] != 13}
    assert {k for k, s in rows.items() if s is None} == {(a, b) for a in (1, 7) for b in (13,)} | {(4, 14), (10, 14)} | {(13, b) for b in range(1, 12, 2)}
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_window_features_read_each_text_once(spark, vectors):
    texts = spark.createDataFrame([(i, "Gemäss vgl. " * (i % 3)) for i in range(12)], "doc_id long, text string")
    q, d = vectors.where("id % 5 = 0").withColumnRenamed("id", "query_id"), vectors.where("id < 12").withColumnRenamed("id", "doc_id")
    got = features.window_pairs(q, d.join(features.window_texts(texts), "doc_id"), "label")
    want = features.window_features(q.withColumnRenamed("v", "q_v").join(d, "label").where("query_id != doc_id").join(texts, "doc_id"))
    cols = ["query_id", "doc_id", "dense_sim", "len", "has_gemaess", "has_vgl"]
    rows = sorted(map(tuple, got.select(cols).collect()))
    assert rows == sorted(map(tuple, want.select(cols).collect())) and len(rows) == 15


def test_citations_are_parsed_once(spark):
    """No plan parses for itself: the grammar's expressions were in it for every part of a parse, some hundred times."""
    rows = spark.createDataFrame([(1, "Art. 1 OR", 0.5, 3), (1, "Art. 1 Abs. 2 OR", 0.2, 9), (1, "Art. 1 Abs. 2 OR", 0.7, 4), (1, "Art. 1 Abs. 3 OR", 0.9, 7), (2, "Art. 1 OR", 0.1, 1), (2, "BGE 1 II 3", 0.3, 2), (2, None, 0.4, 5), (2, "nichts", 0.4, 6)], "query_id long, citation string, score double, pos long")
    got = {"dedup": citations.dedup(rows), "survivors": citations.survivors(rows), "scored": citations.dedup_scored(rows), "shadow": citations.without_shadowed(rows.select("query_id", "citation"))}
    for name, df in got.items():
        assert df._jdf.queryExecution().optimizedPlan().toString().count(r"lit\.?") == 0, name
    found = {name: sorted(map(repr, (tuple(r) for r in df.collect()))) for name, df in got.items()}
    assert found["dedup"] == sorted(map(repr, [(1, "Art. 1 Abs. 2 OR"), (1, "Art. 1 Abs. 3 OR"), (2, "Art. 1 OR"), (2, "BGE 1 II 3")]))
    assert found["survivors"] == sorted(map(repr, [(1, "Art. 1 Abs. 2 OR", 0.2), (1, "Art. 1 Abs. 3 OR", 0.9), (2, "Art. 1 OR", 0.1), (2, "BGE 1 II 3", 0.3)]))
    assert found["scored"] == sorted(map(repr, [(1, "Art. 1 Abs. 2 OR", 0.7, 3), (2, "Art. 1 OR", 0.1, 1), (2, "BGE 1 II 3", 0.3, 2)]))
    assert found["shadow"] == sorted(map(repr, [(1, "Art. 1 Abs. 2 OR"), (1, "Art. 1 Abs. 2 OR"), (1, "Art. 1 Abs. 3 OR"), (2, "Art. 1 OR"), (2, "BGE 1 II 3"), (2, None), (2, "nichts")]))


def test_bm25_of_cluster_members_shuffles_no_pair(spark, monkeypatch):
    words = "der die und haftung vertrag frist klage antrag".split()
    text = lambda i, n: " ".join(words[(i * 5 + j * j) % 8] for j in range(n))
    docs = spark.createDataFrame([(i, text(i, i % 9)) for i in range(60)] + [(60, None)], "doc_id long, text string").repartition(3)
    clusters = spark.createDataFrame([(i, i % 4) for i in range(3, 70)], "doc_id long, cluster long")
    queries = spark.createDataFrame([(1, "die frist der klage"), (2, "vertrag und antrag"), (3, "nichts"), (4, None), (5, "frist")], "query_id long, text string")
    chosen = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 3), (3, 2), (4, 2), (9, 0)], "query_id long, cluster long")
    pairs = retrieval.members(chosen, clusters).join(queries.withColumnRenamed("text", "query"), "query_id").join(docs, "doc_id")
    want = retrieval.top_k(retrieval.bm25_local(pairs).withColumn("score", F.round("score", 5)), 7)
    rows = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())
    twice = clusters.unionByName(clusters.limit(1))
    assert rows(retrieval.bm25_members(queries, chosen, twice, docs, 7)) == rows(want) and {r[0] for r in rows(want)} == {1, 2, 3, 4}
    monkeypatch.setattr(retrieval, "bm25_local", None)
    monkeypatch.setattr(retrieval, "members", None)
    assert rows(retrieval.bm25_members(queries, chosen, clusters, docs, 7, block=2)) == rows(want)
