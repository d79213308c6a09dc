"""What only shows on larger tables, on small ones made for it."""

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quillrank.operators import instances, metrics, retrieval
from quillrank.plans import base, graph  # noqa: F401


def test_run_lengths_beyond_rank_2147(spark, tmp_path):
    n = 2500
    pd.DataFrame({"o_orderkey": range(n), "o_custkey": 7, "o_totalprice": [float(n - i) for i in range(n)]}).to_parquet(tmp_path / "orders.parquet")
    pd.DataFrame({"l_orderkey": range(n), "l_partkey": [i // 3 for i in range(n)], "l_linenumber": np.ones(n, np.int32), "l_extendedprice": 1.0}).to_parquet(tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = base.QUERIES["run_length_max"](spark, str(tmp_path)).toPandas()
    want = con.sql(base.ORACLES["run_length_max"]).df()[list(got.columns)]
    rows = lambda df: sorted(map(tuple, df.itertuples(index=False)))
    assert rows(got) == rows(want)


def test_run_lengths_of_tied_places(spark):
    """Rows of one place, as part keys from 100000 on make them, give the same runs however they come."""
    from quillrank.operators import citations

    rows = [(1, 1, 0.5, 10, 3), (1, 1, 0.4, 20, 4), (1, 2, 0.4, 20, 9), (1, 2, 0.3, 30, 5), (1, 3, 0.2, 40, 7), (1, 3, 0.2, 40, 8)]
    want = [(1, 2, 0.4, 20, 9), (1, 1, 0.4, 20, 4), (1, 1, 0.5, 10, 3), (1, 2, 0.3, 30, 5), (1, 3, 0.2, 40, 8)]
    for given in (rows, rows[::-1]):
        df = spark.createDataFrame(given, "query_id int, id int, score double, o long, v long").coalesce(1)
        got = citations.run_max(df, "o", "id", "score", "v").select("query_id", "id", "score", "o", "v")
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_best_keeps_few_rows_and_all_ties_by_id():
    r = np.random.default_rng(1)
    ids, scores = r.permutation(4000), np.round(r.integers(0, 40, (6, 4000)) / 7, 3)
    best = retrieval.Best(6, 15, 3)
    best.WAITING = 100
    for a in range(0, 4000, 50):
        best.add(scores[:, a : a + 50] + r.uniform(-1e-7, 1e-7, (6, 50)), ids[a : a + 50], least=0.0)
        assert best.size <= 6 * 15 + 100 + 6 * 50
    got = best.rows(list("abcdef"))
    for q, name in enumerate("abcdef"):
        assert got[got["query_id"] == name]["doc_id"].tolist() == ids[np.lexsort((ids, -scores[q]))[:15]].tolist()


def test_searches_for_the_best_give_the_best_of_all_pairs(spark):
    words = "der die und haftung vertrag frist klage antrag strafe eigentum".split()
    r = np.random.default_rng(2)
    text = lambda: " ".join(r.choice(words, r.integers(1, 12)))
    texts = [text() for _ in range(60)] * 2 + ["", None, "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    q = spark.createDataFrame([(i, text()) for i in range(9)] + [(9, "nichts"), (10, None)], "query_id long, text string")
    rows = lambda df: sorted((x["query_id"], x["rank"], x["doc_id"], round(x["score"], 6)) for x in df.collect())
    want = retrieval.top_k(retrieval.bm25(q, docs).withColumn("score", F.round("score", 6)), 7)
    assert rows(retrieval.bm25_top(q, docs, 7)) == rows(want) and len(rows(want)) > 50
    named = q.select(F.struct("query_id", F.lit("x").alias("seed")).alias("query_id"), "text")
    assert {(x[0]["query_id"], x[1]) for x in retrieval.bm25_top(named, docs, 7).select("query_id", "doc_id").collect()} == {(x[0], x[2]) for x in rows(want)}
    again = docs.unionByName(docs.where("doc_id < 5"))  # a repeated id is one document in two rows
    assert rows(retrieval.bm25_top(q, again, 7)) == rows(retrieval.top_k(retrieval.bm25(q, again).withColumn("score", F.round("score", 6)), 7))
    weights = retrieval.query_terms(q).withColumn("weight", F.lit(0.25))
    shares = retrieval.term_counts(docs).select("doc_id", "term", (F.col("tf") / F.col("dl")).alias("weight"))
    assert rows(retrieval.sparse_top(weights, docs, 7)) == rows(retrieval.top_k(retrieval.sparse_search(weights, shares).withColumn("score", F.round("score", 9)), 7))
    # Pairs are never shuffled: what goes to the last exchange is at most k rows a query and task.
    assert all(x not in retrieval.bm25_top(q, docs, 7)._jdf.queryExecution().executedPlan().toString() for x in ("SortMergeJoin", "BroadcastHashJoin"))


def test_dense_search_in_blocks_of_named_queries(spark):
    r = np.random.default_rng(3)
    v = [[float(x) for x in r.integers(-3, 4, 4)] for _ in range(90)]
    docs = spark.createDataFrame(list(enumerate(v)), "doc_id long, v array<float>").repartition(4)
    asked = docs.where("doc_id < 11").select(F.struct(F.col("doc_id").alias("a"), F.lit("x").alias("b")).alias("query_id"), "v")
    got = sorted((x["query_id"]["a"], x["rank"], x["doc_id"]) for x in retrieval.dense_search(asked, docs, 5, block=4).collect())
    m = np.array(v)
    assert got == sorted((i, k + 1, int(d)) for i in range(11) for k, d in enumerate(np.lexsort((np.arange(90), -(m @ m[i])))[:5]))


def test_containment_meets_citations_by_their_beginnings(spark):
    texts = ["Nach Art. 12 ZGB und BGE 120 II 150.", "smart. 5 OR gilt", "SR 220 SR 220 Art. 4", "BGE 120 II 15 E. 3 BGE 120 II 15", "", None, "Art. 12 ZGArt. 12 ZGB\nx"]
    gold = ["Art. 12 ZGB", "art. 5 OR", "SR 220", "SR 220 Art. 4", "BGE 120 II 15", "BGE 120 II 15 E. 3", "(nur) dies?", "", "Art. 12 ZGB\nx"]
    docs = spark.createDataFrame([(q, i, t) for q in (1, 2) for i, t in enumerate(texts)], "query_id int, doc_id int, text string")
    g = spark.createDataFrame([(q, c) for q in (1, 2) for c in gold[q - 1 :]] * 2 + [(1, None)], "query_id int, citation string")
    want = set()
    for q in (1, 2):
        n = [sum(c in t for c in gold[q - 1 :]) for t in texts if t is not None]
        want.add((q, len(texts), sum(x > 0 for x in n), sum(n)))
    assert set(map(tuple, metrics.containment(docs, g).collect())) == want
    # No text meets a citation that doesn't begin in it.
    plan = metrics.containment(docs, g.where("length(citation) >= 8"))._jdf.queryExecution().optimizedPlan().toString()
    assert "key" in plan


def test_instances_go_on_without_texts(spark):
    """Vectors named by an expression are those that stand for each sentence, and terms, texts and vectors aren't shuffled."""
    words = "der die haftung vertrag gemäss frist klage antrag strafe Art. 41 OR".split()
    r = np.random.default_rng(4)
    rows = [(d, i, " ".join(r.choice(words[:-3], 5)) + (f" Art. {d % 3 + 1} OR" if i % 2 else "")) for d in range(30) for i in range(5)]
    sentences = spark.createDataFrame(rows, "doc_id long, idx long, sentence string")
    hits = spark.createDataFrame([(q, d, 0.5, None, 0.1 * q) for q in (1, 2) for d in range(q, 30)], "query_id long, doc_id long, dense double, sparse double, rerank double")
    v = spark.createDataFrame([(i, [float(x) for x in r.normal(size=4)]) for i in range(6)], "id long, v array<float>")
    asked = spark.createDataFrame([(1, "Haftung und Frist", [1.0, 0.0, 0.0, 1.0]), (2, "1 2", [0.0, 2.0, 0.0, 1.0])], "query_id long, query string, q_v array<double>")
    at = (F.col("doc_id") + F.col("idx")) % 7  # 6 has no vector
    plain = instances.generation5(hits, sentences, asked, sentences.join(v, at == F.col("id")).select("doc_id", "idx", "v"))
    named = instances.generation5(hits, sentences, asked, v, by=at)
    rows = lambda df: sorted(map(tuple, df.select(*instances.KEY, *[F.round(c, 9) for c in df.columns[3:]]).collect()))
    assert rows(plain) == rows(named) and len(rows(named)) == 57 and {x["emb_l2"] == 0 for x in named.collect()} == {True, False}
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    assert all(x not in plan for x in ("Generate", " sentence#", "before#"))


def test_bm25_reads_documents_once_to_count_and_once_to_score(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = [(i, " ".join(f"w{i * j % 7}x" for j in range(i))) for i in range(20)] + [(20, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(counted, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "w1x w2x zz"), (2, "w0x"), (3, "")], "query_id long, text string")
    got = retrieval.bm25_top(asked, docs, 50)
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in got.collect()}
    assert read.value <= 3 * len(rows)  # and once to look for repeated ids
    want = retrieval.bm25(asked, docs).collect()
    assert got == {(r["query_id"], r["doc_id"]): round(r["score"], 6) for r in want}
    assert retrieval.bm25_top(asked, docs.where("doc_id < 0"), 50).count() == 0


def test_rows_to_fit_are_joined_once(spark, monkeypatch):
    """What a learner reads again and again is a table, and no join."""
    from quillrank.operators import ml

    plans, fit, predicted = [], ml.fit_logistic, ml.predicted
    seen = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(ml, "fit_logistic", lambda rows, names: fit(seen(rows), names))
    monkeypatch.setattr(ml, "predicted", lambda model, rows: seen(predicted(model, rows)))
    assert base.QUERIES["balanced_classifier"](spark, "/root/testdata/sf0.001").count() == 1
    assert len(plans) == 2 and all("Exchange" not in p and "Join" not in p for p in plans)
