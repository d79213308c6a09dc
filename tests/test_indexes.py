"""The index of citations against plain search, and stems against the published rules' own cases."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillrank.functions import text as T
from quillrank.operators import analysis, citation_index, retrieval
from quillrank.sources import shared


def window_by_hand(text, citation, size):
    cut = lambda x: re.findall(r"\w+|\S", x)
    t, c = cut(text), cut(citation)
    for i in range(len(t)):
        if t[i : i + len(c)] == c:
            return " ".join(t[max(0, i - size // 2) : i + len(c) + size // 2])
    return None


def test_windows_of_citations(spark):
    rnd = random.Random(1)
    word = lambda: rnd.choice(["der", "Ausdruck,", "gilt.", "(so", "nicht)", "Art. 41 OR", "BGE 145 II 32"])
    docs = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 40, 200, 600])]
    got = {(r["doc_id"], r["citation"], r["text"]): r["size"] for r in citation_index.citation_windows(spark.createDataFrame(docs + [(9, None), (10, "")], "doc_id int, text string")).collect()}
    want = {}
    for i, text in docs:
        for c in set(re.findall(r"Art\. 41 OR|BGE 145 II 32", text)):
            for size in (256, 128):
                want[i, c, window_by_hand(text, c, size)] = size
    assert got == want and any(len(text.split()) < 200 for _, _, text in got)


@pytest.fixture(scope="module")
def searched(spark):
    """Windows of one subject stand together, as documents of one kind do, among 1200 of many subjects."""
    rnd = random.Random(2)
    rows = [(i, " ".join(["common"] * rnd.randint(1, 3) + [f"subject{i // 40}x{rnd.randrange(4)}" for _ in range(rnd.randint(1, 8))])) for i in range(1200)]
    rows += [(2000, None), (2001, "")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    asked = spark.createDataFrame([(q, f"common subject{3 * q}x1 subject{3 * q}x2 nowhere") for q in range(9)] + [(50, "nowhere"), (51, None)], "query_id int, text string")
    index = citation_index.CitationIndex.build(df, shared.new_path(spark, "index"), ["doc_id"], width=16, buckets=4)
    return df, asked, index


def test_search_is_exact(spark, searched):
    df, asked, index = searched
    rows = lambda x: sorted((r["query_id"], r["rank"], r["doc_id"], pytest.approx(r["score"], abs=1e-8)) for r in x.collect())
    plain = retrieval.bm25(asked, df).withColumn("score", F.round("score", 9))
    for k in (1, 10, 2000):
        got = rows(citation_index.load(spark, index.path).search(asked, k))
        assert got == rows(retrieval.top_k(plain, k)) and len(got) == sum(min(k, 1200) for _ in range(9))


def test_search_skips_blocks(searched):
    """A tenth or so of the postings is read where the best blocks differ from the others, all where all are wanted."""
    _, asked, index = searched
    assert index.share_read(asked, 10) < 0.2 < 1.0 == index.share_read(asked, 2000)


def test_a_frequent_term_has_many_blocks(searched):
    _, _, index = searched
    common = index.table("blocks").where("term = 'common'")
    assert common.agg(F.max("n")).first()[0] <= 16 and common.agg(F.sum("n")).first()[0] == 1200 and common.count() >= 75


#: Words and stems of the published description of the German stemmer.
PUBLISHED = {
    "aufeinander": "aufeinand", "aufeinanderbiss": "aufeinanderbiss", "aufeinanderfolge": "aufeinanderfolg", "aufeinanderfolgen": "aufeinanderfolg", "aufeinanderfolgend": "aufeinanderfolg", "aufeinanderfolgende": "aufeinanderfolg", "aufeinanderfolgenden": "aufeinanderfolg",
    "aufeinanderfolgender": "aufeinanderfolg", "aufeinanderfolgt": "aufeinanderfolgt", "aufeinanderschlügen": "aufeinanderschlug", "kategorie": "kategori", "kategorien": "kategori", "kategorisch": "kategor", "kategorische": "kategor", "kater": "kat", "katern": "kat", "katers": "kat", "kätzchen": "katzch",
}


def test_stems_are_the_published_ones():
    assert {w: T.german_stem(w) for w in PUBLISHED} == PUBLISHED


def test_lemmas_come_before_stems(spark):
    terms = spark.createDataFrame([(t,) for t in ("ging", "ging", "gehen", "der", "häuser")], "term string")
    lemmas = spark.createDataFrame([("ging", "gehen"), ("ging", "zzz")], "term string, lemma string")
    roots = lambda **k: {r["term"]: r["root"] for r in analysis.analysed(terms, lemmas, ["der"], **k).collect()}
    assert roots() == {"ging": "geh", "gehen": "geh", "häuser": "haus"} and roots(stem=False) == {"ging": "gehen", "gehen": "gehen", "häuser": "häuser"}


def test_bm25_over_stems(spark):
    docs = [(1, "das Haus steht"), (2, "die Häuser stehen im Wald"), (3, "Wald"), (4, ""), (5, None)]
    df, asked = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([(7, "Hause im Wald")], "query_id int, text string")
    words = {d: [T.german_stem(w) for w in (t or "").lower().split()] for d, t in docs}
    mean = sum(map(len, words.values())) / len(words)
    want = {}
    for term in {T.german_stem(w) for w in ("hause", "im", "wald")}:
        df_ = sum(term in w for w in words.values())
        for d, w in words.items():
            if term in w:
                want[d] = want.get(d, 0) + math.log(1 + (len(words) - df_ + 0.5) / (df_ + 0.5)) * w.count(term) / (w.count(term) + 1.5 * (0.25 + 0.75 * len(w) / mean))
    assert {r["doc_id"]: r["score"] for r in analysis.bm25(asked, df).collect()} == pytest.approx(want) and set(want) == {1, 2, 3}


def test_synonyms_of_stems(spark):
    asked = spark.createDataFrame([(1, "Die Häuser, die Haus"), (2, ""), (3, None)], "query_id int, text string")
    synonyms = spark.createDataFrame([("haus", "gebäude"), ("haus", "die"), ("gebäude", "haus")], "term string, synonym string")
    assert {r["query_id"]: r["text"] for r in analysis.expanded(asked, synonyms, 2).collect()} == {1: "die die haus haus gebäude die die haus haus", 2: "", 3: ""}


def test_no_block_meets_a_query_in_a_shuffle(spark, searched):
    """Bounds and scores of blocks stay in the task that reads them: only each query's best rows go on."""
    _, asked, index = searched
    for one in index._asked(asked):
        shape, kinds = index._told(asked)
        floor, tried = index._floor(one, asked, 10, 4)
        assert all(len(x) <= 4 for x in tried) and (floor[[len(x) > 1 for x in tried]] > 0).all()
        rows = index.table("postings").mapInArrow(index._scored(one, 10, kinds, floor), shape)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
        assert rows.count() <= 10 * len(one.ids) * rows.rdd.getNumPartitions()


def test_best_by_roots_are_those_of_all_pairs(spark):
    """Roots are put where texts are read: only tasks' best rows are shuffled for the last step."""
    docs = spark.createDataFrame([(1, "Die Verträge und die Klagen"), (2, "vertrag klage klage"), (3, None), (4, "der"), (5, "Häuser waren hier, Vertrages"), (6, "was is")], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "Vertrag der Klage"), (2, "Haus war"), (3, "nichts"), (4, None)], "query_id long, text string")
    lemmas = spark.createDataFrame([("waren", "war"), ("was", "be"), ("is", "be")], "term string, lemma string")
    rows = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in df.collect())
    want = lambda df: rows(retrieval.top_k(analysis.bm25(asked, df, lemmas, ["der", "die"]).withColumn("score", F.round("score", 6)), 2))
    got = analysis.bm25_top(asked, docs, 2, lemmas, ["der", "die"])
    assert rows(got) == want(docs) and len(want(docs)) == 3
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    again = docs.unionByName(docs.where("doc_id < 3"))
    assert rows(analysis.bm25_top(asked, again, 2, lemmas, ["der", "die"])) == want(again)
    assert analysis.bm25_top(asked.where("query_id > 2"), docs, 2).count() == 0
