"""Queries of filters, labels, mining, unions and texts that the other plans leave out."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import text as T
from ..operators import citations, features, fusion, metrics, ranking, rerank, retrieval, sampling
from . import base as B
from .base import EDGE, GOLD, HITS, LEGAL, RANKED, SCORES, query, table, with_
from .retrieval import BM25, BOTH, CONTAINED, DENSE, SPARSE, _bm25_top, _dense_top, _docs, _lists, _queries, _sparse_top
from .texts import FOUND, PARSED, SENT, STRICT, WORDS

LABELLED = "lab AS (SELECT r.query_id, r.citation, score, rank, (g.citation IS NOT NULL)::INT AS label FROM ranked r LEFT JOIN gold g ON g.query_id = r.query_id AND g.citation = r.citation)"


def _ranked(spark, d):
    return B.scores(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "citation")))


def _labelled(spark, d):
    return features.labelled(_ranked(spark, d), B.gold(spark, d))


def _cited(spark, d):
    """(query_id, doc_id, citation, pos, score): hits with the citations of their documents."""
    return B.hits(spark, d).join(B.edge(spark, d), "doc_id").select("query_id", "doc_id", "citation", "pos", "score", "price")


CITED = "cited AS (SELECT query_id, doc_id, citation, pos, score, price FROM hits JOIN edge USING (doc_id))"


@query(with_(HITS, EDGE, SCORES, RANKED, GOLD) + "SELECT query_id, round(count(r.citation) / count(*), 6) AS recall FROM gold g LEFT JOIN (SELECT * FROM ranked WHERE rank <= 100) r USING (query_id, citation) GROUP BY query_id HAVING count(r.citation) / count(*) >= 0.5")
def query_recall_filter(spark, d):
    return metrics.recall_filter(_ranked(spark, d).where("rank <= 100"), B.gold(spark, d))


@query(with_(HITS) + "SELECT query_id, doc_id, round(score, 6) AS score FROM hits WHERE score >= 0.5")
def rerank_score_filter(spark, d):
    return ranking.threshold(B.hits(spark, d), 0.5)


@query(with_(HITS, EDGE, SCORES, RANKED) + "SELECT query_id, citation FROM ranked WHERE rank <= 7")
def gold_explode(spark, d):
    """Lists in one string, exploded again."""
    rows = ranking.submission(_ranked(spark, d).where("rank <= 7"))
    loose = rows.select("query_id", F.concat(F.lit(" "), F.replace("predicted_citations", F.lit(";"), F.lit(" ; ")), F.lit(";")).alias("gold"))
    return loose.select("query_id", F.explode(T.listed(F.col("gold"))).alias("c")).select("query_id", F.col("c").cast("long").alias("citation"))


@query(with_(HITS, EDGE) + "SELECT DISTINCT query_id, doc_id AS cc_id, round(score, 6) AS rerank_score, citation FROM hits JOIN edge USING (doc_id)")
def candidate_explode(spark, d):
    """Nested records of each query, exploded to candidates."""
    docs = B.edge(spark, d).groupBy("doc_id").agg(F.collect_set("citation").alias("citations"))
    cc = B.hits(spark, d).join(docs, "doc_id").select("query_id", F.struct(F.col("doc_id").alias("cc_id"), F.col("score").alias("rerank_score"), "citations").alias("d"))
    return citations.exploded(cc.groupBy("query_id").agg(F.collect_list("d").alias("cc_list")))


@query(with_(GOLD) + "SELECT citation, count(*) AS n FROM gold GROUP BY 1")
def gold_frequency(spark, d):
    return citations.gold_frequency(B.gold(spark, d))


@query(with_(HITS, EDGE, GOLD, CITED) + "SELECT query_id, c.citation, round(max(score), 6) AS score, max((g.citation IS NOT NULL)::INT) AS label FROM cited c LEFT JOIN gold g USING (query_id, citation) GROUP BY query_id, c.citation")
def group_max_label(spark, d):
    return citations.best_with_label(features.labelled(_cited(spark, d), B.gold(spark, d)))


@query(with_(HITS) + "SELECT query_id, score, min(doc_id) AS doc_id FROM (SELECT query_id, doc_id, round(score, 2) AS score FROM hits) GROUP BY 1, 2")
def dedup_by_score(spark, d):
    return fusion.one_of_each_score(B.hits(spark, d).withColumn("score", F.round("score", 2)))


@query(with_(HITS, EDGE, GOLD, CITED) + "SELECT query_id, doc_id, max((g.citation IS NOT NULL)::INT) AS label FROM cited c LEFT JOIN gold g USING (query_id, citation) GROUP BY 1, 2")
def doc_label_any(spark, d):
    return citations.documents_with_gold(_cited(spark, d), B.gold(spark, d))


GOLD_TEXT = "gt AS (SELECT DISTINCT doc_id % 200 AS query_id, unnest(found) AS citation FROM fd WHERE doc_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45))"


def _gold_text(spark, d):
    """Gold are the citations of orders of which something was returned in quantity."""
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity >= 45").select(F.col("l_orderkey").alias("doc_id"))
    legal = B.legal(spark, d).join(returned, "doc_id", "left_semi")
    return legal.select((F.col("doc_id") % 200).alias("query_id"), F.explode(C.extract(F.col("text"))).alias("citation")).distinct()


@query(with_(LEGAL, FOUND, GOLD_TEXT, "ct AS (SELECT l.doc_id, l.doc_id % 200 AS query_id, count(g.citation) AS n FROM legal l LEFT JOIN gt g ON g.query_id = l.doc_id % 200 AND contains(l.text, g.citation) GROUP BY 1, 2)") + "SELECT query_id, count(*) AS docs, count(*) FILTER (WHERE n > 0) AS with_gold, sum(n)::BIGINT AS containments FROM ct GROUP BY 1")
def gold_containment(spark, d):
    docs = B.legal(spark, d).withColumn("query_id", F.col("doc_id") % 200)
    return metrics.containment(docs, _gold_text(spark, d))


@query(with_(HITS, EDGE, GOLD, CITED, "u AS (SELECT query_id, doc_id, citation, max(price) AS price FROM cited GROUP BY ALL), l AS (SELECT u.*, (g.citation IS NOT NULL)::INT AS label, row_number() OVER (PARTITION BY u.query_id, doc_id ORDER BY price DESC, u.citation) AS rank FROM u LEFT JOIN gold g ON g.query_id = u.query_id AND g.citation = u.citation), q AS (SELECT query_id, doc_id, count(*) AS n, sum(label) AS gold, sum(label) FILTER (WHERE rank <= 3) AS tp FROM l GROUP BY 1, 2 HAVING sum(label) > 0)") + "SELECT round(avg(CASE WHEN coalesce(tp, 0) = 0 THEN 0 ELSE 2 * (tp / least(3, n)) * (tp / gold) / (tp / least(3, n) + tp / gold) END), 6) AS f1_at_k FROM q")
def f1_by_document(spark, d):
    rows = _cited(spark, d).groupBy("query_id", "doc_id", "citation").agg(F.max("price").alias("score"))
    return metrics.f1_by_document(features.labelled(rows, B.gold(spark, d)), 3)


@query(with_(LEGAL, STRICT, "cs AS (SELECT doc_id % 200 AS query_id, unnest(found) AS citation, doc_id FROM fd)", PARSED, "w AS (SELECT *, row_number() OVER (PARTITION BY query_id, art, abs ORDER BY (citation LIKE 'SR %') DESC, gran DESC, norm) AS n FROM (SELECT DISTINCT query_id, citation, norm, art, abs, gran FROM pn WHERE law <> '')), t AS (SELECT *, max(gran) OVER (PARTITION BY query_id, art) AS top FROM w WHERE n = 1), kept AS (SELECT query_id, norm AS citation FROM t WHERE gran = top UNION SELECT query_id, norm FROM pn WHERE law = ''), l AS (SELECT query_id, citation, max(doc_id) AS score FROM cs GROUP BY 1, 2)") + "SELECT query_id, citation, score FROM l SEMI JOIN kept USING (query_id, citation)")
def dedup_survivors(spark, d):
    """Scores of the citations that dedup leaves as they are."""
    c = B.legal(spark, d).select((F.col("doc_id") % 200).alias("query_id"), "doc_id", F.explode(C.extract(F.col("text"), "strict")).alias("citation"))
    return citations.survivors(c.select("query_id", "citation", F.col("doc_id").alias("pos"), F.col("doc_id").alias("score")))


@query(with_(DENSE, "p AS (SELECT query_id, doc_id // 4 AS parent_id, min(rank) AS r FROM dnr WHERE rank <= 40 GROUP BY 1, 2)") + "SELECT query_id, parent_id, row_number() OVER (PARTITION BY query_id ORDER BY r, parent_id) AS rank FROM p")
def dense_ordered_parents(spark, d):
    parents = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.floor(F.col("vec_id") / 4).cast("long").alias("parent_id"))
    return fusion.ordered_parents(_dense_top(spark, d, 40), parents)


@query(with_(DENSE) + "SELECT query_id, doc_id FROM dnr WHERE rank <= 150 AND score >= 0")
def dense_threshold_set(spark, d):
    return ranking.threshold(_dense_top(spark, d, 150), 0.0).select("query_id", "doc_id")


@query(with_(SPARSE) + "SELECT query_id, doc_id // 4 AS doc_id, round(max(s), 6) AS score FROM spr WHERE rank <= 40 GROUP BY 1, 2")
def sparse_parent_max(spark, d):
    parents = _docs(spark, d).select("doc_id", F.floor(F.col("doc_id") / 4).cast("long").alias("parent_id"))
    return retrieval.parent_max(_sparse_top(spark, d, 40), parents)


@query(with_(DENSE) + "SELECT query_id, doc_id AS anchor, rank, round(score, 6) AS score FROM dnr WHERE rank <= 3")
def anchor_search(spark, d):
    """The three nearest core sentences; every vector is one, but for the query's own."""
    return _dense_top(spark, d, 3).withColumnRenamed("doc_id", "anchor")


@query(with_(HITS, EDGE, "t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM hits) WHERE r <= 20)") + "SELECT DISTINCT query_id, citation FROM t JOIN edge USING (doc_id)")
def recalled_citations(spark, d):
    return citations.recalled(B.hits(spark, d), B.edge(spark, d), 20)


@query(with_(EDGE, GOLD) + "SELECT DISTINCT query_id, citation, doc_id FROM gold JOIN edge USING (citation)")
def sources_of_gold(spark, d):
    return citations.sources_of_gold(B.gold(spark, d), B.edge(spark, d))


@query(with_(BM25, SPARSE, BOTH, CONTAINED, "three AS (SELECT query_id, doc_id, score FROM lists UNION ALL SELECT query_id, doc_id, 50 FROM inside)") + "SELECT query_id, doc_id, round(max(score), 6) AS score FROM three GROUP BY 1, 2")
def three_way_recall(spark, d):
    third = retrieval.containing(_docs(spark, d), _queries(spark, d)).withColumn("score", F.lit(50.0))
    return fusion.merged_max(_lists(spark, d).select("query_id", "doc_id", "score").unionByName(third))


@query(with_(BM25, "p AS (SELECT query_id, rank - 1 AS no, doc_id, list_distinct(list_filter(string_split_regex(lower(b.text), '\\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split_regex(lower(d.text), '\\s+'), lambda x: x <> '')) AS b FROM bmtop JOIN benchmark b ON item_id = query_id JOIN documents d USING (doc_id) WHERE rank <= 5)") + "SELECT query_id, no, doc_id, round(len(list_intersect(a, b)) / len(a), 6) AS score FROM p")
def rerank_aligned(spark, d):
    top = _bm25_top(spark, d, 5).select("query_id", (F.col("rank") - 1).alias("no"), "doc_id")
    return rerank.aligned(top.join(_queries(spark, d).withColumnRenamed("text", "query"), "query_id").join(_docs(spark, d), "doc_id"))


@query(with_(BM25) + "SELECT query_id, doc_id, round(1.0 / (60 + (1 - score)), 6) AS score FROM bmtop WHERE rank <= 30")
def rrf_on_scores(spark, d):
    return fusion.rrf_on_scores(_bm25_top(spark, d, 30))


@query(with_(BM25, SPARSE) + "SELECT query_id, doc_id, round(b.score + 0.5 * s.s, 6) AS score FROM (SELECT * FROM bmtop) b JOIN (SELECT * FROM spr WHERE rank <= 100) s USING (query_id, doc_id)")
def combined_scores(spark, d):
    return fusion.combined(_bm25_top(spark, d).select("query_id", "doc_id", "score"), _sparse_top(spark, d, 100).select("query_id", "doc_id", "score"))


@query(with_(BM25, SPARSE, BOTH) + "SELECT query_id, doc_id, round(sum(CASE source WHEN 'bm25' THEN 0.5::DOUBLE / 1.0007 ELSE 0.2::DOUBLE / 1.0003 END * score), 5) AS score FROM lists GROUP BY 1, 2")
def hybrid_in_model(spark, d):
    return retrieval.hybrid(_lists(spark, d), {"bm25": 0.5 / 1.0007, "sparse": 0.2 / 1.0003}).withColumn("score", F.round("score", 5))


@query(with_(HITS, EDGE, SCORES, RANKED, GOLD, LABELLED) + "SELECT query_id, citation, rank, label FROM (SELECT *, sum(label) OVER (PARTITION BY query_id) AS p, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS n FROM lab) WHERE label = 1 OR n <= 6 * p")
def top_negatives(spark, d):
    return sampling.top_negatives(_labelled(spark, d)).select("query_id", "citation", "rank", "label")


@query(with_(HITS, EDGE, SCORES, RANKED, GOLD, LABELLED) + "SELECT label, round(max((SELECT count(*) FROM lab) / (2.0 * (SELECT count(*) FROM lab l WHERE l.label = lab.label))), 6) AS weight, count(*) AS n FROM lab GROUP BY label")
def balanced_weights(spark, d):
    return sampling.balanced_weights(_labelled(spark, d)).groupBy("label").agg(F.max("weight").alias("weight"), F.count("*").alias("n"))


@query(with_(HITS, EDGE, SCORES, RANKED, GOLD) + "SELECT query_id, doc_id FROM hits WHERE query_id IN (SELECT query_id FROM gold JOIN ranked USING (query_id, citation) WHERE rank <= 10)")
def dev_records(spark, d):
    """Pairs of the dev set are gold citations among a query's ten best."""
    pairs = B.gold(spark, d).join(_ranked(spark, d).where("rank <= 10"), ["query_id", "citation"])
    return sampling.of_split(B.hits(spark, d), pairs).select("query_id", "doc_id")


@query(with_(HITS, EDGE, SCORES, RANKED, GOLD, LABELLED) + "SELECT query_id, count(*) AS n FROM lab GROUP BY 1 HAVING sum(label) >= 2")
def min_positives(spark, d):
    return sampling.group_sizes(sampling.min_positives(_labelled(spark, d), 2))


@query(with_(HITS, EDGE, GOLD, CITED, "u AS (SELECT query_id, doc_id, citation, min(pos) AS at FROM cited WHERE score >= 0.5 GROUP BY ALL), l AS (SELECT u.*, (g.citation IS NOT NULL) AS gold FROM u LEFT JOIN gold g ON g.query_id = u.query_id AND g.citation = u.citation), n AS (SELECT p.query_id, p.doc_id, p.citation AS pos, m.citation AS neg FROM l p JOIN l m ON p.query_id = m.query_id AND p.doc_id = m.doc_id AND p.gold AND NOT m.gold AND abs(p.at - m.at) <= 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, pos ORDER BY md5(concat_ws('|', '42', query_id, doc_id, pos, neg)), neg) AS k FROM n)") + "SELECT query_id, doc_id, pos, neg FROM r WHERE k <= 4")
def in_context_negatives(spark, d):
    rows = sampling.in_context(_cited(spark, d).drop("price"), B.gold(spark, d), least=0.5)
    return rows.where("source = 'in_context'").drop("source")


@query(with_(HITS, EDGE, GOLD, CITED, "u AS (SELECT query_id, doc_id, citation, min(pos) AS at FROM cited WHERE score >= 0.5 GROUP BY ALL), l AS (SELECT u.*, (g.citation IS NOT NULL) AS gold FROM u LEFT JOIN gold g ON g.query_id = u.query_id AND g.citation = u.citation), free AS (SELECT count(*) AS f FROM (SELECT DISTINCT citation FROM cited WHERE score >= 0.5 AND citation NOT IN (SELECT citation FROM gold))), n AS (SELECT p.query_id, p.doc_id, p.citation AS pos, least(4, count(m.citation)) AS k FROM l p LEFT JOIN l m ON p.query_id = m.query_id AND p.doc_id = m.doc_id AND NOT m.gold AND abs(p.at - m.at) <= 2 WHERE p.gold GROUP BY ALL)") + "SELECT query_id, doc_id, pos, 6 AS n FROM n, free WHERE f > 20")
def in_context_filled(spark, d):
    """Every gold citation of a document gets six negatives."""
    rows = sampling.in_context(_cited(spark, d).drop("price"), B.gold(spark, d), least=0.5)
    return rows.groupBy("query_id", "doc_id", "pos").agg(F.countDistinct("neg").alias("n"))


def _any(words: str, column: str = "text") -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words.split("|")) + ")::BIGINT"


@query("SELECT doc_id, " + ", ".join(f"{_any(w)} AS {k}" for k, w in {
    "q_is_procedural": "verfahren|zuständigkeit|frist|rechtsmittel|beschwerde|klage|antrag",
    "q_is_substantive": "haftung|schadenersatz|vertrag|eigentum|strafe|verjährung|anspruch",
    "q_is_interpretive": "auslegung|analog|sinn|zweck|ratio|bedeutung|begrif",
    "q_domain_criminal": "straf|delikt|täter|opfer|schuld",
    "q_domain_civil": "vertrag|schuld|eigentum|miete|kauf",
    "q_domain_admin": "verwaltung|behörde|bewilligung|verfügung",
}.items()) + " FROM documents")
def query_intents(spark, d):
    return _docs(spark, d).select("doc_id", *[c.alias(k) for k, c in T.query_intents(F.col("text")).items()])


@query(f"SELECT doc_id, length(text) AS chars, len({WORDS.format('text')}) AS words, length(text) - length(replace(text, '[', '')) AS brackets FROM documents")
def text_lengths(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", F.length(t).alias("chars"), F.size(T.words(t)).alias("words"), T.occurrences(t, "[").alias("brackets"))


@query(with_(LEGAL, "s AS (SELECT doc_id, text, " + SENT.format("text") + " AS s FROM legal), p AS (SELECT *, list_position([contains(x, 'BGE 101') FOR x IN s], true) AS i FROM s)") + "SELECT doc_id, CASE WHEN i > 0 THEN array_to_string(s[greatest(i - 2, 1):i + 2], ' ') ELSE text END AS context FROM p")
def citation_context(spark, d):
    return B.legal(spark, d).select("doc_id", T.context(F.col("text"), F.lit("BGE_101")).alias("context"))


@query(with_(LEGAL) + "SELECT doc_id, (doc_id % 3 = 0 AND contains(text, 'BGE 10'))::BIGINT AS inside FROM legal")
def in_parentheses(spark, d):
    t = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", r"(BGE [0-9IVX ]+E\. \d)", "($1)")).otherwise(F.col("text"))
    return B.legal(spark, d).select("doc_id", T.in_parentheses(t, F.lit("BGE 10 II")).cast("int").alias("inside"))


@query(with_(LEGAL, FOUND) + "SELECT citation, (lower(citation) LIKE 'bge %')::BIGINT AS is_bge, (lower(citation) LIKE 'art%')::BIGINT AS is_art, (lower(citation) LIKE 'sr %')::BIGINT AS is_sr FROM (SELECT DISTINCT unnest(found) AS citation FROM fd)")
def citation_flags(spark, d):
    c = B.legal(spark, d).select(F.explode(C.extract(F.col("text"))).alias("citation")).distinct()
    return c.select("citation", *[x.cast("int").alias(k) for k, x in C.type_flags(F.col("citation")).items()])


@query(with_(HITS, EDGE, SCORES) + "SELECT query_id, citation, score FROM scores WHERE citation % 2 = 0")
def statutes_only(spark, d):
    """Even citations are given the names of statutes."""
    s = B.scores(spark, d)
    named = s.withColumn("citation", F.when(F.col("citation") % 2 == 0, F.concat(F.lit("Art. "), "citation")).otherwise(F.concat(F.lit("BGE "), "citation")))
    return ranking.statutes_only(named).select("query_id", F.substring_index("citation", " ", -1).cast("long").alias("citation"), "score")


@query(with_(HITS, "a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM hits) WHERE r <= 150), b AS (SELECT * FROM (SELECT query_id, doc_id, doc_id % 97 AS s, row_number() OVER (PARTITION BY query_id ORDER BY doc_id % 97 DESC, doc_id) AS r FROM a) WHERE r <= 50), c AS (SELECT query_id, doc_id, doc_id % 31 AS s, row_number() OVER (PARTITION BY query_id ORDER BY doc_id % 31 DESC, doc_id) AS r FROM b)") + "SELECT query_id, doc_id, s AS score FROM c WHERE r <= 20")
def funnel(spark, d):
    by = lambda m: lambda df: df.select("query_id", "doc_id", (F.col("doc_id") % m).alias("score"))
    return ranking.funnel([(150, lambda df: df), (50, by(97)), (20, by(31))], B.hits(spark, d).select("query_id", "doc_id", "score"))


@query(with_(HITS, EDGE, CITED) + "SELECT query_id, citation, round(sum(score), 6) AS score FROM cited GROUP BY 1, 2")
def pooled_sum(spark, d):
    return citations.pooled(_cited(spark, d), "sum")


@query(with_(HITS, EDGE, "w AS (SELECT doc_id, citation, max(CASE WHEN pos = 0 THEN 1.5 ELSE 0.5 END) AS weight FROM edge GROUP BY 1, 2)") + "SELECT query_id, citation, round(sum(score * weight::DOUBLE), 6) AS score FROM hits JOIN w USING (doc_id) GROUP BY 1, 2")
def section_score(spark, d):
    edge = B.edge(spark, d).withColumn("weight", F.when(F.col("pos") == 0, 1.5).otherwise(0.5))
    return citations.section_score(B.hits(spark, d), edge)


@query(with_(HITS, EDGE, CITED) + "SELECT query_id, citation, doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id, citation ORDER BY score DESC, doc_id, pos) AS n FROM cited) WHERE n = 1")
def first_evidence(spark, d):
    return rerank.first_evidence(_cited(spark, d)).select("query_id", "citation", "doc_id", "pos")


@query(with_(HITS, EDGE, "l AS (SELECT query_id, ln(sum(exp(score))) AS lse FROM hits GROUP BY 1)") + "SELECT query_id, round(lse, 6) AS logsumexp FROM l")
def logsumexp(spark, d):
    from ..functions import scores as S

    return S.logsumexp("score", ["query_id"])(B.hits(spark, d))


GEN4 = "p AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, q.embedding::DOUBLE[] AS a, c.embedding::DOUBLE[] AS b FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)"


@query(with_(GEN4) + f"SELECT query_id, p.doc_id, round(list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b)) + 1e-6), 6) AS dense_sim, length(text) AS len, contains(lower(text), 'gemäss')::BIGINT AS has_gemaess, contains(lower(text), 'vgl')::BIGINT AS has_vgl FROM p JOIN documents d ON d.doc_id = p.doc_id")
def features_gen4(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("v"))
    windows = e.select(F.col("vec_id").alias("doc_id"), "label", F.col("embedding").alias("v")).join(features.window_texts(_docs(spark, d)), "doc_id")
    return features.window_pairs(q, windows, "label").select("query_id", "doc_id", "dense_sim", "len", "has_gemaess", "has_vgl")
