"""Citation graph, ranking, feature, sampling and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import citations, features, metrics, ranking, sampling
from ..sources import shared
from . import base as B
from .base import EDGE, FIRST, GOLD, HITS, IDFS, QS, RANKED, SCORES, query, table, with_

MM = "CASE WHEN max({0}) OVER q = min({0}) OVER q THEN 0.0 ELSE ({0} - min({0}) OVER q) / (max({0}) OVER q - min({0}) OVER q) END"


@query(with_(EDGE, FIRST) + "SELECT doc_id, citation, pos FROM firsts")
def citation_edges_first(spark, d):
    return B.edge(spark, d).groupBy("doc_id", "citation").agg(F.min("pos").alias("pos"))


@query(with_(EDGE) + "SELECT citation, array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS docs FROM edge GROUP BY 1")
def inverted_index(spark, d):
    return citations.inverted_index(B.edge(spark, d)).select("citation", F.array_join(F.transform("docs", lambda x: x.cast("string")), ",").alias("docs"))


@query(with_(EDGE, "n AS (SELECT citation, count(DISTINCT doc_id) AS n FROM edge GROUP BY 1)") + "SELECT count(*) AS citations, max(n) AS longest, round(avg(n), 6) AS mean FROM n")
def inverted_index_stats(spark, d):
    return citations.posting_stats(B.edge(spark, d))


def _idf(spark, d):
    e = B.edge(spark, d)
    return citations.idf(e, e)


@query(with_(EDGE, IDFS) + "SELECT citation, df, round(idf, 6) AS idf FROM idfs")
def citation_idf(spark, d):
    return _idf(spark, d)


EVID = "ev AS (SELECT l_orderkey AS doc_id, l_partkey % 50 AS citation, l_extendedprice / 70001 AS score, CASE l_returnflag WHEN 'R' THEN 1.5 WHEN 'A' THEN 0.5 ELSE 0.2 END AS weight FROM lineitem)"


@query(with_(EVID, "t AS (SELECT doc_id, citation, count(*) AS coverage, max(score) AS peak, max(weight) AS position FROM ev GROUP BY 1, 2)") + "SELECT doc_id, citation, coverage, round(peak, 6) AS peak, round(position, 6) AS position, round(0.4 * ln(1 + coverage) + 0.4 * peak + 0.2 * position, 6) AS score FROM t WHERE NOT (coverage = 1 AND peak < 0.3)")
def doc_citation_triple(spark, d):
    ev = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 50).alias("citation"), (F.col("l_extendedprice") / 70001).alias("score"), F.when(F.col("l_returnflag") == "R", 1.5).when(F.col("l_returnflag") == "A", 0.5).otherwise(0.2).alias("weight"))
    return citations.doc_triple(ev, threshold=0.3)


@query(with_(HITS, EDGE, "a AS (SELECT query_id, citation, max(price) AS s FROM hits JOIN edge USING (doc_id) GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM hits), b AS (SELECT query_id, citation, max(score / ln(r - 1 + 2)) AS s FROM rk JOIN edge USING (doc_id) GROUP BY 1, 2)", f"u AS (SELECT query_id, citation, 0.7 * {MM.format('s')} AS s FROM a WINDOW q AS (PARTITION BY query_id) UNION ALL SELECT query_id, citation, 0.3 * {MM.format('s')} FROM b WINDOW q AS (PARTITION BY query_id))") + "SELECT query_id, citation, round(sum(s), 6) AS score FROM u GROUP BY 1, 2")
def global_fusion(spark, d):
    from ..operators.fusion import with_rank

    h, e = B.hits(spark, d), B.edge(spark, d)
    rerank = h.drop("score").join(e.withColumnRenamed("price", "score"), "doc_id")
    return citations.global_fusion(rerank, with_rank(h).join(e, "doc_id"))


def _position(kind: str, sql: str):
    @query(with_(HITS, EDGE, FIRST) + f"SELECT query_id, citation, round(sum(score * {sql}), 6) AS score FROM hits JOIN firsts USING (doc_id) GROUP BY 1, 2", name=f"sentence_pos_score_{kind}")
    def run(spark, d):
        return citations.position_score(B.hits(spark, d), B.edge(spark, d), kind)


for _k, _s in (("reciprocal", "1 / (pos + 1.0)"), ("log", "1 / ln(pos + 2)"), ("exp", "exp(-0.3 * pos)")):
    _position(_k, _s)


@query(with_(HITS, EDGE, IDFS, "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM hits) WHERE r <= 20), w AS (SELECT query_id, doc_id, exp(5 * (score - max(score) OVER q)) / sum(exp(5 * (score - (SELECT max(t2.score) FROM top t2 WHERE t2.query_id = top.query_id)))) OVER q AS w FROM top WINDOW q AS (PARTITION BY query_id)), pd AS (SELECT doc_id, citation, count(*) AS tf, avg(exp(-0.1 * pos)) AS near FROM edge GROUP BY 1, 2)") + "SELECT query_id, citation, round(sum(w * ln(1 + tf) * idf * near) * ln(1 + count(*)), 6) AS score FROM w JOIN pd USING (doc_id) JOIN idfs USING (citation) GROUP BY 1, 2")
def softmax_tfidf_score(spark, d):
    return citations.softmax_tfidf(B.hits(spark, d), B.edge(spark, d), _idf(spark, d))


SCALED = f"sc AS (SELECT query_id, doc_id, {MM.format('score')} AS s FROM hits WINDOW q AS (PARTITION BY query_id)), pt AS (SELECT query_id, citation, doc_id, s, s / ln(1 + greatest(pos, 1)) AS part FROM sc JOIN firsts USING (doc_id))"
OVERMAX = "SELECT query_id, citation, round(CASE WHEN max(raw) OVER q > 0 THEN raw / max(raw) OVER q ELSE raw END, 6) AS score FROM raw WINDOW q AS (PARTITION BY query_id)"


@query(with_(HITS, EDGE, FIRST, IDFS, SCALED, "raw AS (SELECT query_id, citation, max(part) * any_value(idf) * ln(1 + count(*)) AS raw FROM pt JOIN idfs USING (citation) WHERE s >= 0.23 GROUP BY 1, 2)") + OVERMAX)
def minmax_max_pool(spark, d):
    return citations.min_max_pool(B.hits(spark, d), B.edge(spark, d), "max", _idf(spark, d), gate=0.23)


@query(with_(HITS, EDGE, FIRST, SCALED, "tp AS (SELECT *, row_number() OVER (PARTITION BY query_id, citation ORDER BY part DESC, doc_id) AS n FROM pt), raw AS (SELECT query_id, citation, sum(part) * ln(1 + count(*)) AS raw FROM tp WHERE n <= 3 GROUP BY 1, 2)") + OVERMAX)
def minmax_sum_pool(spark, d):
    return citations.min_max_pool(B.hits(spark, d), B.edge(spark, d), "sum", top=3)


@query(with_(HITS, EDGE, "r AS (SELECT query_id, citation, price, row_number() OVER (PARTITION BY query_id, citation ORDER BY price DESC, doc_id * 10 + pos) AS n FROM hits JOIN edge USING (doc_id))") + "SELECT query_id, citation, round(sum(price), 6) AS score FROM r WHERE n <= 5 GROUP BY 1, 2")
def topk_evidence_sum(spark, d):
    ev = B.hits(spark, d).drop("score").join(B.edge(spark, d), "doc_id").select("query_id", "citation", F.col("price").alias("score"), (F.col("doc_id") * 10 + F.col("pos")).alias("id"))
    return citations.best_evidence(ev)


@query(with_(HITS, EDGE, "ce AS (SELECT DISTINCT doc_id, citation FROM edge), top AS (SELECT DISTINCT query_id, citation FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM hits) JOIN ce USING (doc_id) WHERE r <= 10)") + "SELECT query_id, citation, count(*) AS votes FROM hits JOIN ce USING (doc_id) JOIN top USING (query_id, citation) GROUP BY 1, 2")
def vote_topk_docs(spark, d):
    return citations.votes(B.hits(spark, d), B.edge(spark, d), 10)


@query(with_(HITS, EDGE, IDFS) + "SELECT query_id, citation, round(sum(1 / (1.0 + pos)) * any_value(idf), 6) AS score FROM hits JOIN edge USING (doc_id) JOIN idfs USING (citation) GROUP BY 1, 2")
def position_sum_idf(spark, d):
    return citations.position_sum(B.hits(spark, d), B.edge(spark, d), _idf(spark, d))


@query(with_(HITS, EDGE, "e AS (SELECT query_id, doc_id, citation, price, max(price) OVER (PARTITION BY query_id, doc_id) AS m FROM hits JOIN edge USING (doc_id)), p AS (SELECT query_id, citation, round(max(x), 6) AS score FROM (SELECT query_id, citation, exp(price - m) / sum(exp(price - m)) OVER (PARTITION BY query_id, doc_id) AS x FROM e) GROUP BY 1, 2)") + "SELECT query_id, citation, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, citation) AS rank FROM p")
def per_doc_softmax_global_rank(spark, d):
    ev = B.hits(spark, d).drop("score").join(B.edge(spark, d), "doc_id").withColumnRenamed("price", "score")
    return citations.doc_softmax_rank(ev)


@query(with_(HITS, EDGE, "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM hits) WHERE r <= 10)") + "SELECT query_id, citation, round(max(score), 6) AS score FROM top JOIN (SELECT DISTINCT doc_id, citation FROM edge) USING (doc_id) GROUP BY 1, 2")
def top_doc_max(spark, d):
    return citations.top_doc_max(B.hits(spark, d), B.edge(spark, d), 10)


@query(with_(HITS, EDGE, "b AS (SELECT query_id, citation, pos, max(price) AS s FROM hits JOIN edge USING (doc_id) GROUP BY 1, 2, 3)") + "SELECT query_id, citation, round(max(s), 6) AS score FROM b GROUP BY 1, 2 HAVING max(s) >= 0.8")
def anchor_match(spark, d):
    s = B.hits(spark, d).drop("score").join(B.edge(spark, d), "doc_id").select("query_id", "citation", F.col("pos").alias("sentence"), F.col("doc_id").alias("anchor"), F.col("price").alias("score"))
    return citations.anchor_match(s)


def _ranked(spark, d):
    return ranking.top_n(B.scores(spark, d), 1 << 30)


@query(with_(HITS, EDGE, SCORES, RANKED) + "SELECT query_id, citation, score, rank FROM ranked WHERE rank <= 25")
def topn_per_query(spark, d):
    return ranking.top_n(B.scores(spark, d), 25)


@query(with_(HITS, EDGE, SCORES, "m AS (SELECT *, citation % 3 = 0 AS c FROM scores), w AS (SELECT *, row_number() OVER (PARTITION BY query_id, c ORDER BY score DESC, citation) AS n FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, n) AS rank FROM w WHERE NOT c OR n <= 10)") + "SELECT query_id, citation, score, rank FROM k WHERE rank <= 30")
def quota_topn(spark, d):
    return ranking.quota_top_n(B.scores(spark, d).withColumn("is_case", F.col("citation") % 3 == 0), 30, 10).drop("is_case")


@query(with_(HITS, EDGE, SCORES, RANKED, "z AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM ranked)") + "SELECT query_id, citation, score, rank FROM z WHERE rank <= greatest(5, CAST(floor(ln(n)) AS BIGINT))")
def dynamic_limit(spark, d):
    return ranking.dynamic_top_n(B.scores(spark, d), 5)


@query(with_(HITS, EDGE, SCORES, RANKED, QS) + "SELECT query_id, coalesce(string_agg(CAST(citation AS VARCHAR), ';' ORDER BY rank), '') AS predicted_citations FROM qs LEFT JOIN (SELECT * FROM ranked WHERE rank <= 19) USING (query_id) GROUP BY 1")
def submission_concat(spark, d):
    return ranking.submission(ranking.top_n(B.scores(spark, d), 19), B.queries_of(spark, d))


@query(with_(HITS, EDGE, SCORES) + "SELECT query_id, citation, score FROM scores WHERE citation IN (SELECT p_partkey FROM part WHERE p_size <= 25 UNION SELECT s_suppkey FROM supplier) AND score >= 1")
def known_ids_threshold(spark, d):
    known = citations.known_only(B.scores(spark, d), table(spark, d, "part").where("p_size <= 25").select("p_partkey"), table(spark, d, "supplier").select("s_suppkey"))
    return ranking.threshold(known, 1.0).select("query_id", "citation", "score")


@query(with_(HITS, EDGE, "x AS (SELECT query_id, doc_id, citation, max(price) AS price FROM hits JOIN edge USING (doc_id) GROUP BY 1, 2, 3), dr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY max(price) DESC, doc_id) AS r FROM x GROUP BY 1, 2), ir AS (SELECT x.*, row_number() OVER (PARTITION BY x.query_id, x.doc_id ORDER BY price DESC, citation) AS n FROM x JOIN dr USING (query_id, doc_id) WHERE r <= 20), fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY price DESC, doc_id, citation) AS k FROM ir WHERE n <= 3)") + "SELECT query_id, doc_id, citation, round(price, 6) AS score FROM fr WHERE k <= 40")
def candidate_caps(spark, d):
    x = B.hits(spark, d).drop("score").join(B.edge(spark, d), "doc_id").groupBy("query_id", "doc_id", "citation").agg(F.max("price").alias("score"))
    return ranking.candidate_caps(x, 20, 3, 40).select("query_id", "doc_id", "citation", "score")


SWEEP = "lim AS (SELECT unnest([5, 10, 15, 20, 25, 30, 35, 40, 45]) AS lim), h AS (SELECT query_id, lim, count(*) AS np, count(g.citation) AS tp FROM ranked JOIN lim ON rank <= lim LEFT JOIN gold g USING (query_id, citation) GROUP BY 1, 2), sz AS (SELECT query_id, count(*) AS ng FROM gold GROUP BY 1), sw AS (SELECT lim, avg(CASE WHEN coalesce(np, 0) = 0 AND coalesce(ng, 0) = 0 THEN 1.0 WHEN coalesce(tp, 0) = 0 THEN 0.0 ELSE 2.0 * tp / (np + ng) END) AS f1 FROM qs CROSS JOIN lim LEFT JOIN h USING (query_id, lim) LEFT JOIN sz USING (query_id) GROUP BY 1)"


def _sweep(spark, d):
    return metrics.limit_sweep(_ranked(spark, d), B.gold(spark, d), B.queries_of(spark, d), list(range(5, 50, 5)))


@query(with_(HITS, EDGE, GOLD, SCORES, RANKED, QS, SWEEP) + "SELECT lim AS \"limit\", round(f1, 6) AS f1 FROM sw")
def limit_sweep(spark, d):
    return _sweep(spark, d)


@query(with_(HITS, EDGE, GOLD, SCORES, RANKED, QS, SWEEP) + "SELECT arg_max(lim, round(f1, 9) - lim * 1e-12) AS best, round(max(f1), 6) AS f1 FROM sw")
def limit_sweep_best(spark, d):
    return _sweep(spark, d).agg(F.max_by("limit", F.round("f1", 9) - F.col("limit") * 1e-12).alias("best"), F.max("f1").alias("f1"))


PERQ = "pq AS (SELECT query_id, count(*) AS np, count(g.citation) AS tp FROM (SELECT * FROM ranked WHERE rank <= 25) LEFT JOIN gold g USING (query_id, citation) GROUP BY 1), ng AS (SELECT query_id, count(*) AS ng FROM gold GROUP BY 1), pr AS (SELECT query_id, coalesce(np, 0) AS np, coalesce(ng, 0) AS ng, coalesce(tp, 0) AS tp FROM qs LEFT JOIN pq USING (query_id) LEFT JOIN ng USING (query_id)), ev AS (SELECT *, CASE WHEN np = 0 AND ng = 0 THEN 1.0 WHEN np = 0 OR ng = 0 THEN 0.0 ELSE tp / np END AS p, CASE WHEN np = 0 AND ng = 0 THEN 1.0 WHEN np = 0 THEN 0.0 WHEN ng = 0 THEN 1.0 ELSE tp / ng END AS r FROM pr), e1 AS (SELECT *, CASE WHEN np = 0 AND ng = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f FROM ev)"


def _per(spark, d):
    return metrics.per_query(ranking.top_n(B.scores(spark, d), 25), B.gold(spark, d), B.queries_of(spark, d))


@query(with_(HITS, EDGE, GOLD, SCORES, RANKED, QS, PERQ) + "SELECT query_id, np AS n_pred, ng AS n_gold, tp, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1 FROM e1")
def set_f1_per_query(spark, d):
    return _per(spark, d)


@query(with_(HITS, EDGE, GOLD, SCORES, RANKED, QS, PERQ) + "SELECT round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(f), 6) AS f1 FROM e1")
def macro_f1(spark, d):
    return metrics.macro(_per(spark, d))


@query(with_(HITS, EDGE, GOLD, SCORES, RANKED, QS, PERQ) + "SELECT round(sum(tp) / sum(np), 6) AS precision, round(sum(tp) / sum(ng), 6) AS recall, round(2 * (sum(tp) / sum(np)) * (sum(tp) / sum(ng)) / (sum(tp) / sum(np) + sum(tp) / sum(ng)), 6) AS f1 FROM e1")
def micro_f1(spark, d):
    return metrics.micro(_per(spark, d))


@query(with_(HITS, EDGE, GOLD, SCORES, RANKED, QS, PERQ, "m AS (SELECT avg(tp / ng) AS r, avg(CASE WHEN np = 0 THEN 0.0 ELSE tp / np END) AS p FROM pr WHERE ng > 0)") + "SELECT round(r, 6) AS recall, round(p, 6) AS precision, round(2 * r * p / (r + p), 6) AS f1_of_means FROM m")
def mean_recall_precision(spark, d):
    return metrics.mean_recall_precision(_ranked(spark, d), B.gold(spark, d), 25)


LAB = "lab AS (SELECT r.query_id, r.citation, r.rank, r.score, CASE WHEN g.citation IS NULL THEN 0 ELSE 1 END AS label FROM ranked r LEFT JOIN gold g USING (query_id, citation))"


def _labelled(spark, d):
    return features.labelled(_ranked(spark, d), B.gold(spark, d))


@query(with_(HITS, EDGE, GOLD, SCORES, RANKED, LAB, "i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY label DESC, rank) AS ideal FROM lab), z AS (SELECT query_id, sum(label) AS n, min(CASE WHEN label = 1 THEN rank END) AS first, sum(CASE WHEN rank <= 20 THEN label ELSE 0 END) AS h, sum(CASE WHEN rank <= 20 THEN label / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN ideal <= 20 THEN label / log2(ideal + 1) ELSE 0 END) AS best FROM i GROUP BY 1)") + "SELECT round(avg(1.0 / first), 6) AS mrr, round(avg(h / n), 6) AS recall_at_k, round(avg(dcg / best), 6) AS ndcg_at_k FROM z WHERE n > 0")
def mrr_ndcg_recall_at_k(spark, d):
    return metrics.ranking(_labelled(spark, d), 20)


@query(with_(HITS, EDGE, GOLD, SCORES, RANKED, LAB, "z AS (SELECT query_id, count(*) AS n, sum(CASE WHEN rank <= 25 THEN label ELSE 0 END) AS tp FROM lab GROUP BY 1), g AS (SELECT query_id, count(*) AS ng FROM gold GROUP BY 1)") + "SELECT round(avg(CASE WHEN tp = 0 THEN 0.0 ELSE 2 * (tp / least(25, n)) * (tp / ng) / (tp / least(25, n) + tp / ng) END), 6) AS f1_at_k FROM z JOIN g USING (query_id)")
def f1_at_k(spark, d):
    n = B.gold(spark, d).groupBy("query_id").agg(F.count("*").alias("n_gold"))
    return metrics.f1_at_k(_labelled(spark, d), n, 25)


@query(with_(HITS, EDGE, GOLD, SCORES, RANKED, LAB, "c AS (SELECT score, label, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS y FROM lab), k AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS m FROM c)") + "SELECT round((sum(m * label) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))::DOUBLE), 6) AS auc, round(avg(CASE WHEN y = label THEN 1.0 ELSE 0 END), 6) AS accuracy FROM k")
def auc_rank_sum(spark, d):
    return metrics.auc(_labelled(spark, d).select("score", "label"))


@query(with_(HITS, EDGE, GOLD, SCORES, RANKED, LAB, "s AS (SELECT *, sum(label) OVER (PARTITION BY query_id ORDER BY rank) / rank AS p FROM lab), a AS (SELECT query_id, avg(CASE WHEN label = 1 THEN p END) AS ap FROM s GROUP BY 1)") + "SELECT round(avg(ap), 6) AS map FROM a")
def mean_average_precision(spark, d):
    return metrics.average_precision(_labelled(spark, d))


@query(with_(HITS, EDGE, GOLD, "p AS (SELECT h.query_id, h.doc_id, max(CASE WHEN g.citation IS NULL THEN 0 ELSE 1 END) AS has FROM hits h JOIN edge USING (doc_id) LEFT JOIN gold g ON g.query_id = h.query_id AND g.citation = edge.citation GROUP BY 1, 2), q AS (SELECT query_id, sum(has) AS s, count(*) AS n FROM p GROUP BY 1)") + "SELECT CAST(sum(s) AS BIGINT) AS with_gold, CAST(sum(n) AS BIGINT) AS pairs, CAST(sum(CASE WHEN s > 0 THEN 1 ELSE 0 END) AS BIGINT) AS queries_with_gold FROM q")
def gold_coverage(spark, d):
    return metrics.gold_coverage(B.hits(spark, d).join(B.edge(spark, d), "doc_id").select("query_id", "doc_id", "citation"), B.gold(spark, d))


OCC = "hr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hits), occ AS (SELECT query_id, citation, price AS score, rank, pos + 1 AS pos FROM hr JOIN edge USING (doc_id))"


def _occurrences(spark, d):
    from ..operators.fusion import with_rank

    return with_rank(B.hits(spark, d)).drop("score").join(B.edge(spark, d), "doc_id").select("query_id", "citation", F.col("price").alias("score"), "rank", (F.col("pos") + 1).alias("pos"))


_PICK = ", ".join(f"coalesce(max(CASE WHEN n = {i} THEN score END), 0) AS a{i}, coalesce(max(CASE WHEN n = {i} THEN pos END), 999) AS pos_{i}, coalesce(max(CASE WHEN n = {i} THEN rank END), 999) AS rank_{i}" for i in range(1, 6))


@query(with_(HITS, EDGE, OCC, f"o AS (SELECT *, row_number() OVER (PARTITION BY query_id, citation ORDER BY score DESC, rank, pos) AS n, max(score) OVER (PARTITION BY query_id, citation) AS top, max(score) OVER (PARTITION BY query_id) AS best FROM occ), g AS (SELECT query_id, citation, count(*) AS n_occurrences, max(score) AS m1, avg(score) AS m2, sum(score) AS m3, stddev_pop(score) AS m4, min(rank) AS rank_min, avg(rank) AS m5, CAST(sum(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS BIGINT) AS rank_top10, min(pos) AS pos_min, avg(pos) AS m6, avg(1.0 / pos) AS m7, max(1.0 / pos) AS m8, max(top) + ln(sum(exp(score - top))) AS m9, avg(score / (best + 1e-8)) AS m10, max(score / (best + 1e-8)) AS m11, {_PICK} FROM o GROUP BY 1, 2)") + "SELECT query_id, citation, n_occurrences, round(m1, 6) AS score_max, round(m2, 6) AS score_mean, round(m3, 6) AS score_sum, round(m4, 6) AS score_std, rank_min, round(m5, 6) AS rank_mean, rank_top10, pos_min, round(m6, 6) AS pos_mean, round(m7, 6) AS inv_pos_mean, round(m8, 6) AS inv_pos_max, round(m9, 6) AS score_lse, round(m10, 6) AS rel_mean, round(m11, 6) AS rel_max, " + ", ".join(f"round(a{i}, 6) AS score_{i}, pos_{i}, rank_{i}" for i in range(1, 6)) + " FROM g")
def features_occurrence30(spark, d):
    return features.occurrence(_occurrences(spark, d))


SRC = "src AS (SELECT query_id, doc_id, 'rerank' AS source, score FROM hits UNION ALL SELECT query_id, doc_id, 'dense', (doc_id * 7919 % 1009) / 1009.0 FROM hits UNION ALL SELECT query_id, doc_id, 'sparse', (doc_id * 104729 % 2003) / 2003.0 FROM hits WHERE (doc_id * 104729 % 2003) / 2003.0 >= 0.33), sr AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) - 1 AS rank FROM src)"


def _sources(spark, d):
    h = B.hits(spark, d)
    a = h.select("query_id", "doc_id", F.lit("rerank").alias("source"), "score")
    b = h.select("query_id", "doc_id", F.lit("dense").alias("source"), ((F.col("doc_id") * 7919 % 1009) / 1009.0).alias("score"))
    c = h.select("query_id", "doc_id", F.lit("sparse").alias("source"), ((F.col("doc_id") * 104729 % 2003) / 2003.0).alias("score")).where("score >= 0.33")
    from pyspark.sql import Window

    return a.unionByName(b).unionByName(c).withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "doc_id")) - 1)


_G3 = {"rank_min": "min(rank)", "mean": "avg(s)", "top3": "sum(CASE WHEN n <= 3 THEN s ELSE 0 END) / (1 + count(*))", "inv": "avg(1.0 / (1 + rank))", "log": "avg(1 / ln(2 + rank))", "at_best": "avg(CASE WHEN rank = low THEN s END)", "s_inv": "avg(s / (1 + rank))", "s_log": "avg(s / ln(2 + rank))"}


@query(with_(HITS, EDGE, SRC, f"ss AS (SELECT query_id, doc_id, source, rank, {MM.format('score')} AS s FROM sr WINDOW q AS (PARTITION BY query_id, source)), j AS (SELECT query_id, citation, source, rank, s, row_number() OVER (PARTITION BY query_id, citation, source ORDER BY s DESC, rank) AS n, min(rank) OVER (PARTITION BY query_id, citation, source) AS low FROM ss JOIN (SELECT DISTINCT doc_id, citation FROM edge) USING (doc_id)), g AS (SELECT query_id, citation, source, {', '.join(f'{v} AS {k}' for k, v in _G3.items())} FROM j GROUP BY 1, 2, 3)") + "SELECT query_id, citation, " + ", ".join(f"round(coalesce(max(CASE WHEN source = '{s}' THEN {k} END), {99999 if k == 'rank_min' else 0}), 6) AS {s}_{k}" if k != "rank_min" else f"coalesce(max(CASE WHEN source = '{s}' THEN {k} END), 99999) AS {s}_{k}" for s in ("dense", "sparse", "rerank") for k in _G3) + " FROM g GROUP BY 1, 2")
def features_gen3_pivot(spark, d):
    out = features.by_source(_sources(spark, d), B.edge(spark, d))
    for c in out.columns:
        if c.endswith("rank_min"):
            out = out.withColumn(c, F.col(c).cast("long"))
    return out


@query(with_(HITS, EDGE, "w AS (SELECT h.query_id, h.doc_id, h.score AS rerank, (doc_id * 7919 % 1009) / 1009.0 AS dense, (doc_id * 104729 % 2003) / 2003.0 AS sparse, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM hits h), e AS (SELECT doc_id, citation, min(pos) AS pos, count(*) AS tf FROM edge GROUP BY 1, 2)") + "SELECT query_id, citation, round(sum(rerank / ln(2 + rank)), 6) AS rerank_log, round(sum(rerank / (1 + rank)), 6) AS rerank_inv, round(sum(dense / ln(2 + rank)), 6) AS dense_log, round(sum(sparse / ln(2 + rank)), 6) AS sparse_log, round(sum(CASE WHEN rank < 10 THEN rerank ELSE 0 END), 6) AS top10_bonus, round(max(rerank), 6) AS rerank_max, round(sum(rerank * rerank / ln(2 + rank)), 6) AS rerank_sq, min(rank) AS rank_min, max(rank) AS rank_max, round(avg(rank), 6) AS rank_mean, round(sum(dense), 6) AS dense_sum, round(sum(sparse), 6) AS sparse_sum, round(sum(dense) / (sum(sparse) + 1e-9), 5) AS dense_sparse_ratio, count(DISTINCT doc_id) AS n_docs, round(sum(tf * rerank), 6) AS weighted_coverage, round(avg(pos), 6) AS pos_mean FROM w JOIN e USING (doc_id) GROUP BY 1, 2")
def features_gen2(spark, d):
    from ..operators.fusion import with_rank

    h = with_rank(B.hits(spark, d)).select("query_id", "doc_id", F.col("score").alias("rerank"), ((F.col("doc_id") * 7919 % 1009) / 1009.0).alias("dense"), ((F.col("doc_id") * 104729 % 2003) / 2003.0).alias("sparse"), (F.col("rank") - 1).alias("rank"))
    return features.hits_features(h, B.edge(spark, d)).withColumn("dense_sparse_ratio", F.round("dense_sparse_ratio", 5))


G5 = "f AS (SELECT query_id, citation, count(*) AS freq, min(pos) AS pos, max(score) AS rerank, max((doc_id * 7919 % 1009) / 1009.0) AS dense, max((doc_id * 104729 % 2003) / 2003.0) AS sparse FROM hits JOIN edge USING (doc_id) GROUP BY 1, 2)"


def _gen5(spark, d):
    rows = B.hits(spark, d).join(B.edge(spark, d), "doc_id").groupBy("query_id", "citation").agg(F.count("*").alias("freq"), F.min("pos").alias("pos"), F.max("score").alias("rerank"), F.max((F.col("doc_id") * 7919 % 1009) / 1009.0).alias("dense"), F.max((F.col("doc_id") * 104729 % 2003) / 2003.0).alias("sparse"))
    return rows.withColumn("n_sentences", F.lit(7))


@query(with_(HITS, EDGE, G5) + "SELECT query_id, citation, freq, pos, 7 AS n_sentences, round(rerank, 6) AS rerank, round(dense, 6) AS dense, round(sparse, 6) AS sparse, round(dense + sparse + rerank, 6) AS sum_scores, round(dense * sparse, 6) AS dense_x_sparse, round(rerank * dense, 6) AS rerank_x_dense, round(rerank * sparse, 6) AS rerank_x_sparse, round(greatest(dense, sparse, rerank), 6) AS max_score, round(least(dense, sparse, rerank), 6) AS min_score, round(greatest(dense, sparse, rerank) - least(dense, sparse, rerank), 6) AS score_gap, round(ln(1 + freq), 6) AS log_freq, round(rerank * ln(1 + freq), 6) AS rerank_x_freq, round(pos / 7, 6) AS rel_pos, round(1 / (1.0 + pos), 6) AS inv_pos, round(freq / 7, 6) AS density FROM f")
def features_gen5_core(spark, d):
    return features.combos(_gen5(spark, d))


@query(with_(HITS, EDGE, G5) + "SELECT query_id, citation, round(dense, 6) AS prob, round(pos / 7, 6) AS rel_pos, round(ln(1 + freq), 6) AS log_freq, round(dense, 6) AS dense, round(sparse, 6) AS sparse, round(rerank, 6) AS rerank, round(1 / (61 - dense) + 1 / (61 - sparse) + 1 / (61 - rerank), 6) AS fused FROM f")
def features_two_stage(spark, d):
    return features.two_stage(_gen5(spark, d).withColumn("prob", F.col("dense")))


@query(with_(HITS, EDGE) + "SELECT query_id, doc_id, round(max(price), 6) AS prob_max, round(avg(price), 6) AS prob_mean, CAST(sum(CASE WHEN price >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS n_predicted, count(*) AS n FROM hits JOIN edge USING (doc_id) GROUP BY 1, 2")
def features_doc_probabilities(spark, d):
    return features.doc_probabilities(B.hits(spark, d).drop("score").join(B.edge(spark, d), "doc_id").withColumnRenamed("price", "prob"))


@query(with_(HITS, EDGE, GOLD, "gf AS (SELECT citation, count(*) AS f FROM gold GROUP BY 1), gs AS (SELECT query_id, count(*) AS e FROM gold GROUP BY 1), m AS (SELECT h.query_id, h.doc_id, count(DISTINCT g.citation) AS k, sum(CASE WHEN f IS NULL THEN 0 ELSE least(1.0, ln(1 + f) / ln(201)) END) AS s FROM hits h JOIN (SELECT DISTINCT doc_id, citation FROM edge) e USING (doc_id) LEFT JOIN gold g ON g.query_id = h.query_id AND g.citation = e.citation LEFT JOIN gf ON gf.citation = g.citation GROUP BY 1, 2)") + "SELECT query_id, doc_id, round(CASE WHEN k = 0 THEN 0.05 ELSE greatest(0.05, least(0.95, 0.5 + 0.45 * (k / e) * (s / k))) END, 6) AS label FROM m JOIN gs USING (query_id)")
def soft_label(spark, d):
    g = B.gold(spark, d)
    freq = g.groupBy("citation").agg(F.count("*").alias("f"))
    size = g.groupBy("query_id").agg(F.count("*").alias("expected"))
    cited = B.hits(spark, d).select("query_id", "doc_id").join(B.edge(spark, d).select("doc_id", "citation").distinct(), "doc_id")
    m = cited.join(g.join(freq, "citation"), ["query_id", "citation"], "left").groupBy("query_id", "doc_id").agg(F.count("f").alias("matched"), F.collect_list("f").alias("fs")).join(size, "query_id")
    return m.select("query_id", "doc_id", S.soft_label(F.col("matched"), F.col("expected"), F.col("fs")).alias("label"))


def _md5(seed: int) -> str:
    return f"md5(concat('{seed}', '|', query_id, '|', citation))"


@query(with_(HITS, EDGE, GOLD, SCORES, RANKED, LAB, f"s AS (SELECT *, sum(label) OVER (PARTITION BY query_id) AS p, row_number() OVER (PARTITION BY query_id, label ORDER BY {_md5(42)}, citation) AS n FROM lab)") + "SELECT query_id, citation, rank, score, label FROM s WHERE label = 1 OR n <= 3 * p")
def neg_sample_hash(spark, d):
    return sampling.downsample(_labelled(spark, d), 3).select("query_id", "citation", "rank", "score", "label")


@query(with_(HITS, EDGE, GOLD, SCORES, RANKED, LAB, f"h AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, citation) AS hn FROM lab), k AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY CASE WHEN hn <= 20 THEN '' ELSE {_md5(42)} END, hn) AS n FROM h)") + "SELECT query_id, citation, label FROM k WHERE label = 1 OR n <= 40")
def hard_neg_first(spark, d):
    return sampling.hard_first(_labelled(spark, d), 20, 40).select("query_id", "citation", "label")


@query(with_(HITS, EDGE, GOLD, SCORES, RANKED, LAB, "f AS (SELECT *, min(CASE WHEN label = 1 THEN rank END) OVER (PARTITION BY query_id) AS fp FROM lab)") + "SELECT query_id, citation, rank FROM f WHERE label = 0 AND rank < fp")
def neg_before_pos(spark, d):
    return sampling.before_first_positive(_labelled(spark, d)).select("query_id", "citation", "rank")


@query(with_(HITS, EDGE, GOLD, SCORES, RANKED, LAB, "f AS (SELECT *, max(label) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM lab)") + "SELECT query_id, citation, rank, label FROM f WHERE near = 1")
def neighbor_window_neg(spark, d):
    return sampling.near_positives(_labelled(spark, d), 2).select("query_id", "citation", "rank", "label")


@query()
def pairwise_mining(spark, d):
    rows = B.hits(spark, d).join(B.edge(spark, d), "doc_id").select("query_id", "doc_id", "citation", "pos", "score")
    return sampling.pairwise(rows, B.gold(spark, d))


@query()
def cross_query_negatives(spark, d):
    return sampling.cross_query_negatives(B.gold(spark, d))


@query()
def grouped_samples(spark, d):
    return sampling.groups_of(_labelled(spark, d), 4)


@query()
def split_by_query(spark, d):
    return sampling.group_folds(sampling.split_by_query(B.scores(spark, d))).groupBy("query_id").agg(F.countDistinct("split").alias("splits"), F.min("split").alias("split"), F.min("fold").alias("fold"), F.count("*").alias("n"))


@query(with_(HITS, EDGE, SCORES) + "SELECT query_id, count(*) AS n FROM scores GROUP BY 1")
def group_sizes(spark, d):
    return sampling.group_sizes(B.scores(spark, d))


@query(with_(HITS, EDGE, "r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hits), j AS (SELECT query_id, citation % 7 AS id, score, (rank * 10 + pos) * 100000 + citation AS o, citation AS v FROM r JOIN edge USING (doc_id)), m AS (SELECT *, CASE WHEN lag(id) OVER w IS DISTINCT FROM id THEN 1 ELSE 0 END AS nw FROM j WINDOW w AS (PARTITION BY query_id ORDER BY o)), k AS (SELECT *, sum(nw) OVER (PARTITION BY query_id ORDER BY o) AS run FROM m)") + "SELECT query_id, id, arg_max(v, struct_pack(a := score, b := -o)) AS v, round(max(score), 6) AS score, min(o) AS o FROM k GROUP BY query_id, run, id")
def run_length_max(spark, d):
    from ..operators.fusion import with_rank

    j = with_rank(B.hits(spark, d)).join(B.edge(spark, d), "doc_id").select("query_id", (F.col("citation") % 7).alias("id"), "score", ((F.col("rank").cast("long") * 10 + F.col("pos")) * 100000 + F.col("citation")).alias("o"), F.col("citation").alias("v"))
    return citations.run_max(j, "o", "id", "score", "v")


@query()
def learning_to_rank(spark, d):
    """Trained on four folds of queries, evaluated on the fifth."""
    from ..operators import ml

    rows = sampling.group_folds(features.labelled(features.combos(_gen5(spark, d)), B.gold(spark, d)))
    names = ["freq", "pos", "rerank", "dense", "sparse", "sum_scores", "log_freq"]
    model = ml.fit_gbt(sampling.downsample(rows.where("fold != 0")), names, rounds=5, depth=3)
    scored = ml.predicted(model, rows.where("fold = 0")).withColumn("score", F.round("prob", 6))
    return metrics.ranking(ranking.top_n(scored.select("query_id", "citation", "score", "label"), 1 << 30), 20)


@query()
def lambda_rank(spark, d):
    """Boosted on three folds of queries, stopped on the second, judged on the first, which no tree has seen."""
    from ..operators import lambdarank

    rows = sampling.group_folds(features.labelled(features.combos(_gen5(spark, d)), B.gold(spark, d))).withColumnRenamed("citation", "id")
    names = ["freq", "pos", "rerank", "dense", "sparse", "sum_scores", "rel_pos"]
    model = lambdarank.fit(rows.where("fold > 1"), rows.where("fold = 1"), names, rounds=12, patience=4, depth=3, rate=0.3)
    scored = model.scored(rows.where("fold = 0")).select("query_id", F.col("id").alias("citation"), F.round("score", 6).alias("score"), "label")
    return metrics.ranking(ranking.top_n(scored, 1 << 30), 20)


@query()
def lambda_rank_search(spark, d):
    """Thirty trials on all queries of three folds, compared on the second; the best one's model is judged on the first, which no
    trial has seen."""
    from ..operators import lambdarank, trials

    rows = sampling.group_folds(features.labelled(features.combos(_gen5(spark, d)), B.gold(spark, d))).withColumnRenamed("citation", "id")
    rows = shared.written(rows, "rows")
    names = ["freq", "pos", "rerank", "dense", "sparse", "sum_scores", "rel_pos"]
    model, records = trials.search(rows.where("fold > 1"), rows.where("fold = 1"), names, trials.drawn(30), whole=True)
    unseen = rows.where("fold = 0")
    held_out = lambdarank.ndcg(model.scored(unseen), lambdarank.ideal(unseen, 20), 20)
    order = ["rung", "parts", "trial", "rate", "depth", "least", "l2", "top", "share", "ndcg", "kept"]
    listed = spark.createDataFrame([tuple(r[k] for k in order) for r in records], "rung int, parts int, trial int, rate double, depth int, least int, l2 double, top int, share double, ndcg double, kept boolean")
    last = max(r["rung"] for r in records)
    return listed.withColumn("held_out", F.when(F.col("kept") & (F.col("rung") == last), F.lit(held_out)))


@query()
def balanced_classifier(spark, d):
    from ..operators import ml

    names = ["freq", "pos", "rerank", "dense", "sparse"]
    # Fitting reads its rows several times; joined again each time, they would be shuffled again.
    rows = shared.written(features.labelled(_gen5(spark, d), B.gold(spark, d)).select("label", *names), "rows")
    return metrics.auc(ml.predicted(ml.fit_logistic(rows, names), rows).select(F.round("prob", 6).alias("score"), "label"))
