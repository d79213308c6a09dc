"""The operN queries over whole tables, with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, common, decontam, digest, idfile, jaccard, mtree, packing, periodic, quality, substring, suffix, toxicity, tokens


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_words(common.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


def op2_idfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_dir(spark)}/idfile-{uuid.uuid4().hex[:12]}"
    idfile.write_ids(common.table(spark, sf_dir, "documents").select("doc_id", "text"), path, vocabulary("word_bpe_49k.json"), end_id=2)
    return idfile.read_documents(spark, path)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.fingerprints(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_bytes(common.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


def op6_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(common.table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("word_bpe_49k.json"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.fit(docs, common.table(spark, sf_dir, "labels")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"), end_id=2)


def op11_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")
    return decontam.digested(decontam.contamination(docs.select("doc_id", "text"), items.select("item_id", "text")))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digested(periodic.find_runs(periodic.repeating(common.table(spark, sf_dir, "documents").select("doc_id", "text"))))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(docs, tokens.read_file(vocabulary("byte_bpe_50k.json")), tokens.read_bytes(vocabulary("piece_bpe_32k.model")))


QUERIES = {f.__name__: f for f in (op1_substring, op2_idfile, op3_jaccard, op4_digest, op5_suffix, op6_mtree, op7_bpe, op8_quality, op9_toxicity, op10_packing, op11_decontam, op12_periodic, op13_alignment)}
_WORDS = "list_filter(string_split_regex(coalesce({0}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_ALNUM = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: crc32 of a string of digits, bit by bit.
_CRC32 = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))))"

#: SQL for what SQL can express on unique doc_ids; ids of tokenizers, digests, bytes within characters and models are beyond it.
ORACLES: dict[str, str] = {
    "op1_substring": f"""WITH w AS MATERIALIZED (SELECT doc_id, unnest(s) AS word, generate_subscripts(s, 1) AS i, len(s) AS n FROM (SELECT doc_id, {_WORDS.format("text")} AS s FROM documents)),
 win AS MATERIALIZED (SELECT *, CASE WHEN i + 19 <= n THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) END AS win FROM w),
 dup AS MATERIALIZED (SELECT *, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM win),
 cov AS MATERIALIZED (SELECT *, max(again::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS gone FROM dup),
 got AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM cov GROUP BY doc_id)
 SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM documents d LEFT JOIN got USING (doc_id)""",
    "op3_jaccard": f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS.format(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS s FROM documents),
 each AS MATERIALIZED (SELECT doc_id, unnest(s) AS word, generate_subscripts(s, 1) AS i, len(s) AS n FROM w),
 grams AS MATERIALIZED (SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS g FROM each),
 sets AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM grams WHERE i + 3 <= n OR (n < 4 AND i = 1)),
 sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
 common AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 links AS MATERIALIZED (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)),
 ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
 reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a)
 SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)""",
    "op6_mtree": """WITH v AS MATERIALIZED (SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
 SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op11_decontam": f"""WITH d AS MATERIALIZED (SELECT doc_id, {_ALNUM} AS w FROM documents), b AS MATERIALIZED (SELECT item_id, {_ALNUM} AS w FROM benchmark),
 win AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
 grams AS MATERIALIZED (SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win FROM (SELECT d.*, size, unnest(range(1, len(w) - size + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT size FROM win))),
 met AS MATERIALIZED (SELECT doc_id, item_id, g.size, i FROM grams g JOIN win USING (size, win)),
 hit AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS i FROM (SELECT DISTINCT doc_id, size, i FROM met)) GROUP BY doc_id),
 ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met) GROUP BY doc_id)
 SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)""",
    "op12_periodic": f"""WITH h AS MATERIALIZED (SELECT doc_id, {_WORDS.format("text")} AS w, {_CRC32.format("doc_id::VARCHAR")} AS h FROM documents),
 g AS MATERIALIZED (SELECT *, h // 10 AS g, len(w) AS n FROM h),
 a AS MATERIALIZED (SELECT *, h % 10 = 0 AND n > 0 AS edit, g % greatest(n, 1) AS a FROM g),
 p AS MATERIALIZED (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
 e AS MATERIALIZED (SELECT doc_id, i - 1 AS i, CASE WHEN edit AND i - 1 >= a THEN w[a + (i - 1 - a) % p + 1] ELSE w[i] END AS word FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM p)),
 often AS MATERIALIZED (SELECT * FROM e QUALIFY count(*) OVER (PARTITION BY doc_id, word) >= 4),
 part AS MATERIALIZED (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS part FROM often),
 again AS MATERIALIZED (SELECT * FROM part QUALIFY count(*) OVER (PARTITION BY doc_id, part, word) >= 4),
 pair AS MATERIALIZED (SELECT x.doc_id, y.i - x.i AS q, x.i FROM again x JOIN again y ON x.doc_id = y.doc_id AND x.part = y.part AND x.word = y.word AND x.i < y.i),
 island AS MATERIALIZED (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pair) GROUP BY doc_id, q, k),
 long AS MATERIALIZED (SELECT * FROM island WHERE length >= greatest(6, 4 * q)),
 runs AS MATERIALIZED (SELECT doc_id, start, length, q AS period FROM long x WHERE NOT EXISTS (SELECT 1 FROM long y WHERE y.doc_id = x.doc_id AND y.q < x.q AND y.start <= x.start AND y.start + y.length >= x.start + x.length)),
 gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
 kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS t FROM e LEFT JOIN gone ON gone.doc_id = e.doc_id AND gone.i = e.i WHERE gone.i IS NULL GROUP BY e.doc_id),
 said AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM runs GROUP BY doc_id),
 best AS (SELECT r.* FROM runs r WHERE NOT EXISTS (SELECT 1 FROM runs o WHERE o.doc_id = r.doc_id AND (o.length * r.period > r.length * o.period OR (o.length * r.period = r.length * o.period AND (o.start < r.start OR (o.start = r.start AND o.period < r.period))))))
 SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(s.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
 FROM documents d LEFT JOIN said s USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept k USING (doc_id)""",
}
