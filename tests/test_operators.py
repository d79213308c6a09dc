import math

import pytest
from pyspark.sql import functions as F

from quillrank.operators import citations, fusion, metrics, ranking, rerank, retrieval, sampling, sections
from quillrank.sources import io


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_rrf(spark):
    lists = spark.createDataFrame([(1, s, d, i + 1) for s, ds in (("a", "ABC"), ("b", "CBA")) for i, d in enumerate(ds)], "query_id int, source string, doc_id string, rank int")
    got = {r["doc_id"]: r["score"] for r in fusion.rrf_strict(lists).collect()}
    assert got["A"] == got["C"] == pytest.approx(1 / 61 + 1 / 63) and got["B"] == pytest.approx(2 / 62)
    with pytest.raises(Exception, match="lacks a document"):
        fusion.rrf_strict(lists.where("not (source = 'b' and doc_id = 'B')")).collect()


def test_sparse_and_run_max(spark):
    docs = spark.createDataFrame([(0, "C", 0.3), (0, "A", 0.1), (1, "C", 0.1), (2, "E", 1.0)], "doc_id int, term string, weight double")
    q = spark.createDataFrame([(9, "C", 0.2)], "query_id int, term string, weight double")
    assert [(d, round(s, 6)) for d, s in rows(retrieval.sparse_search(q, docs), "doc_id", "score")] == [(0, 0.06), (1, 0.02)]
    r = spark.createDataFrame([(1, i, d, s, v) for i, (d, s, v) in enumerate([(1, 0.5, "a"), (1, 0.8, "b"), (2, 0.3, "c"), (2, 0.6, "d"), (2, 0.4, "e"), (3, 0.9, "f")])], "query_id int, o int, id int, s double, v string")
    assert rows(citations.run_max(r, "o", "id", "s", "v"), "v", "s") == [("b", 0.8), ("d", 0.6), ("f", 0.9)]


def test_dedup(spark):
    found = spark.createDataFrame([(1, c) for c in ("Art. 48 Abs. 1 OR", "Art. 47 Abs. 2 OR", "Art. 47 OR", "Art. 48 OR", "BGE 145 II 32 E. 3.1", "kein")], "query_id int, citation string")
    assert rows(citations.dedup(found), "citation") == [("Art. 47 Abs. 2 OR",), ("Art. 48 Abs. 1 OR",), ("BGE 145 II 32 E. 3.1",)]
    assert rows(citations.without_shadowed(found), "citation") == [("Art. 47 Abs. 2 OR",), ("Art. 48 Abs. 1 OR",), ("BGE 145 II 32 E. 3.1",), ("kein",)]
    scored = spark.createDataFrame([(1, "Art. 47 OR", 0.5, 0), (1, "Art. 47 Abs. 2 OR", 0.9, 1), (1, "Art. 48 Abs. 1 OR", 0.8, 2), (1, "Art. 48 OR", 0.7, 3)], "query_id int, citation string, score double, pos int")
    assert rows(citations.dedup_scored(scored), "citation", "score") == [("Art. 47 Abs. 2 OR", 0.9), ("Art. 48 Abs. 1 OR", 0.8)]


def test_set_metrics(spark):
    schema = "query_id int, citation string"
    pred = spark.createDataFrame([(3, "a"), (4, "a"), (4, "b")], schema)
    gold = spark.createDataFrame([(2, "a"), (4, "b"), (4, "c")], schema)
    q = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "query_id int")
    got = {r["query_id"]: (r["precision"], r["recall"], r["f1"]) for r in metrics.per_query(pred, gold, q).collect()}
    assert got == {1: (1, 1, 1), 2: (0, 0, 0), 3: (0, 1, 0), 4: (0.5, 0.5, 0.5)}


def test_ranking_metrics(spark):
    lab = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (2, 1, 0)], "query_id int, rank int, label int")
    r = metrics.ranking(lab, 10).first()
    assert r["mrr"] == 0.5 and r["recall_at_k"] == 1 and r["ndcg_at_k"] == pytest.approx(1 / math.log2(3))
    assert metrics.ranking(lab, 10, count_misses=True).first()["mrr"] == 0.25


def test_submission_and_quota(spark):
    s = spark.createDataFrame([(1, "c", 0.9, True), (1, "d", 0.8, True), (1, "a", 0.5, False)], "query_id int, citation string, score double, is_case boolean")
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    assert rows(ranking.submission(ranking.quota_top_n(s, 2, 1), q), "query_id", "predicted_citations") == [(1, "c;a"), (2, "")]


def test_bm25_and_dense(spark):
    docs = spark.createDataFrame([(1, "apfel birne"), (2, "apfel apfel kirsche"), (3, None)], "doc_id int, text string")
    q = spark.createDataFrame([(7, "apfel")], "query_id int, text string")
    got = {r["doc_id"]: r["score"] for r in retrieval.bm25(q, docs).collect()}
    idf, avg = math.log(1 + (3 - 2 + 0.5) / 2.5), 5 / 3
    assert got[1] == pytest.approx(idf * 1 / (1 + 1.5 * (0.25 + 0.75 * 2 / avg))) and set(got) == {1, 2}
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)] + [(9, None)], "doc_id int, v array<double>")
    top = retrieval.dense_search(spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, v array<double>"), v, 2)
    assert rows(top, "rank", "doc_id", "score") == [(1, 4, 4.0), (2, 3, 3.0)]


def test_containing_has_no_nested_loop_for_long_needles(spark):
    docs = spark.createDataFrame([(1, "x eins zwei drei vier fünf y"), (2, "eins zwei drei")], "doc_id int, text string")
    needle = spark.createDataFrame([(5, "eins zwei drei vier fünf"), (6, "zwei")], "query_id int, text string")
    assert rows(retrieval.containing(docs, needle), "doc_id", "query_id") == [(1, 5), (1, 6), (2, 6)]


def test_plugins(spark):
    pairs = spark.createDataFrame([(1, 1, "a b", "a c"), (1, 2, "a b", "b a")], "query_id int, doc_id int, query string, text string")
    assert rows(rerank.rerank(pairs), "doc_id", "score") == [(1, 0.5), (2, 1.0)]
    hits = pairs.withColumn("rank", F.col("doc_id"))
    assert rows(rerank.listwise(hits, lambda q, ts: list(range(len(ts)))[::-1]), "rank", "doc_id") == [(1, 2), (2, 1)]
    q = spark.createDataFrame([(1, "x")], "query_id int, text string")
    assert rows(rerank.rewrite(q, lambda i, t: [t + "1"], ""), "variant_no", "text") == [(0, "x1"), (1, "x")]
    assert rows(rerank.rewrite(q, None, ""), "variant_no", "text") == [(0, "x")]
    syn = spark.createDataFrame([("haus", "heim")], "term string, synonym string")
    assert rerank.synonym_expansion(spark.createDataFrame([(1, "Haus am See")], "query_id int, text string"), syn).first()["text"] == "haus am see haus am see heim"


def test_sections():
    got = sections.split_court_document("Sachverhalt\nA klagte.\n\nWeiter so.\n\nErwägungen\nEs gilt BGE 1.\n\nDemnach erkennt das Gericht")
    assert [(s.type, s.start_line, s.confidence) for s in got] == [("sachverhalt", 1, "header"), ("erwaegungen", 6, "header"), ("dispositiv", 9, "header")]
    assert sections.split_court_document(None) == []


def test_sampling_is_deterministic(spark):
    r = spark.createDataFrame([(1, f"c{i}", int(i == 0)) for i in range(50)], "query_id int, citation string, label int")
    a, b = (rows(sampling.downsample(x, 5), "citation") for x in (r, r.repartition(7)))
    assert a == b and len(a) == 6
    assert sampling.split_by_query(r).select("split").distinct().count() == 1


def test_io(spark, tmp_path):
    p = str(tmp_path / "c.csv")
    with open(p, "w") as f:
        f.write('citation,text\nA,"eins\nzwei ""x"""\nB,drei\n')
    assert rows(io.read_csv(spark, p, io.CORPUS), "citation", "text") == [("A", 'eins\nzwei "x"'), ("B", "drei")]
    post = spark.createDataFrame([("d", "t", 1.0), ("d", "u", 2.0)], "doc_id string, term string, weight double")
    io.write_postings(post, str(tmp_path / "p"))
    assert rows(io.read_postings(spark, str(tmp_path / "p"), ["u"]), "term", "weight") == [("u", 2.0)]
    io.append_missing(post, str(tmp_path / "m"), "term", lambda x: x)
    io.append_missing(post, str(tmp_path / "m"), "term", lambda x: x)
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2


def test_streaming_index(spark, tmp_path):
    from quillrank.streaming import index

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "Art. 1 OR gilt."), (2, "Art. 1 OR und Art. 2 OR.")], "doc_id int, text string").write.parquet(src)
    stream = spark.readStream.schema("doc_id int, text string").parquet(src)
    q = index.start(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert {r["citation"]: r["df"] for r in index.idf(spark, str(tmp_path / "out")).collect()} == {"Art. 1 OR": 2, "Art. 2 OR": 1}


def test_keywords_are_those_contained(spark):
    """The automaton finds what a search for each keyword finds, overlapping and nested ones too."""
    from quillrank.functions import patterns

    groups = {"a": ["gilt", "ist", "ist nicht", "nicht"], "b": ["NICHT anwendbar", "gilt"], "none": ["zzz"]}
    texts = ["Das ist nicht anwendbar.", "GILT gilt Gilt", "", None, "nichts", "ist  nicht"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", patterns.keyword_counts(F.col("t"), groups).alias("n")).collect()
    want = [tuple(sum(w.lower() in (t or "").lower() for w in ws) for ws in groups.values()) for t in texts]
    assert [tuple(r["n"]) for r in sorted(rows)] == want
    assert patterns.Keywords({"a": []}).counts("x") == [0]


def test_contexts_of_citations(spark):
    from quillrank.operators import instances

    said = ["Eins.", "Nach Art. 8 ZGB gilt das.", "Drei.", "Art. 8 ZGB und BGE 101 II 3.", "Fünf."]
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(said)], "doc_id int, idx int, sentence string")
    got = {r["citation"]: r for r in instances.contexts(rows, 1).collect()}
    one, two = got["Art. 8 ZGB"], got["BGE 101 II 3"]
    assert (one["before"], one["after"], one["freq"], one["is_isolated"], one["is_art"]) == ("Eins.", "Drei.", 2, 1, 1)
    assert (two["before"], two["after"], two["idx"], two["is_isolated"], two["n_citations"], two["density"]) == ("Drei.", "Fünf.", 3, 0, 2, 0.4)
