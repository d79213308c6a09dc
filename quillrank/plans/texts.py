"""Text and citation-extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import text as T
from ..operators import citations, features, sections
from . import base as B
from .base import LEGAL, query, table, with_

#: Written out here, so that the library's own patterns are checked against them.
_RX = {
    "art": r"Art\.?\s+\d+[a-z]?\s+(?:Abs\.?\s*\d+\s+)*(?:[A-Z][a-zA-ZäöüÄÖÜß0-9]*)",
    "sr": r"SR\s*\d{3}(?:\.\d+)?(?:\s+Art\.?\s*\d+[a-z]?)?",
    "bge": r"BGE\s+\d{1,3}\s+[IVX]+[a-z]?\s+\d+(?:\s+E\.\s*\d+[a-z]?)?",
}
_STRICT = _RX | {"art": r"Art\.?\s+\d+[a-z]?\s+(?:Abs\.?\s*\d+\s+)?[A-Z]{2,}"}
FOUND = "fd AS (SELECT doc_id, text, list_sort(list_distinct(list_concat(" + ", ".join(f"regexp_extract_all(text, '{_RX[f]}', 0, 'i')" for f in C.FAMILIES) + "))) AS found FROM legal)"
STRICT = FOUND.replace(_RX["art"], _STRICT["art"])
LONGEST = "list_transform(list_sort([{{'n': -length(c), 'c': c}} FOR c IN {0}]), lambda x: x.c)"
SENT = "list_filter([trim(x, E' \\n\\t\\r') FOR x IN string_split(regexp_replace(trim({0}, E' \\n\\t\\r'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))], lambda x: x <> '')"
TOK = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"
WORDS = "list_filter(string_split_regex({0}, '[ \\n\\t\\r\\f\\v]+'), lambda x: x <> '')"


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _legal(spark, d):
    return B.legal(spark, d)


@query("SELECT doc_id, i - 1 AS no, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, " + SENT.format("text") + " AS s FROM documents))")
def sentence_split(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("no", "sentence"))


@query("WITH t AS (SELECT doc_id, " + TOK.format("text") + " AS t, greatest(1, CAST(ceil((len(t) - 64) / 48.0) AS INT) + 1) AS k FROM documents), z AS (SELECT *, unnest(range(0, k)) AS i FROM t WHERE len(t) > 0), c AS (SELECT doc_id, i, CASE WHEN len(t) > 64 AND (len(t) - 64) % 48 <> 0 AND i = k - 2 THEN array_to_string(t[i * 48 + 1:], ' ') ELSE array_to_string(t[i * 48 + 1:i * 48 + 64], ' ') END AS chunk, len(t) > 64 AND (len(t) - 64) % 48 <> 0 AND i = k - 1 AS cut FROM z) SELECT doc_id, i AS no, chunk FROM c WHERE NOT cut")
def chunk_windows(spark, d):
    t = _docs(spark, d).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.posexplode(T.chunks(F.col("t"), 64, 16)).alias("no", "chunk"))


@query("WITH s AS (SELECT doc_id, " + SENT.format("text") + " AS s FROM documents), k AS (SELECT *, CASE WHEN len(s) <= 4 THEN 1 ELSE (len(s) - 4) // 2 + 1 END AS k FROM s WHERE len(s) > 0), w AS (SELECT *, unnest(range(0, k)) AS i FROM k) SELECT doc_id, i AS no, CASE WHEN i = k - 1 THEN array_to_string(list_concat(s[i * 2 + 1:i * 2 + 4], list_filter(s[i * 2 + 5:], lambda x: NOT list_contains(s[i * 2 + 1:i * 2 + 4], x))), ' ') ELSE array_to_string(s[i * 2 + 1:i * 2 + 4], ' ') END AS \"window\" FROM w")
def sentence_windows_merge(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(T.sentence_windows(T.sentences(F.col("text")), 4, 2)).alias("no", "window"))


@query(with_(LEGAL, FOUND) + "SELECT doc_id, unnest(found) AS citation FROM fd")
def extract_citations(spark, d):
    return _legal(spark, d).select("doc_id", F.explode(C.extract(F.col("text"))).alias("citation"))


@query(with_(LEGAL) + " UNION ".join(f"SELECT doc_id, unnest(regexp_extract_all(text, '{_STRICT[f]}', 0, 'i')) AS citation, '{f}' AS type FROM legal" for f in C.FAMILIES))
def extract_typed(spark, d):
    return _legal(spark, d).select("doc_id", F.explode(C.extract_typed(F.col("text"))).alias("c")).select("doc_id", F.col("c.text").alias("citation"), "c.type")


@query(with_(LEGAL, STRICT, "o AS (SELECT doc_id, text, c, unnest(range(1, length(text) + 1)) AS i FROM (SELECT doc_id, text, unnest(found) AS c FROM fd))") + "SELECT DISTINCT doc_id, c AS citation, i - 1 AS start, i - 1 + length(c) AS end FROM o WHERE substr(text, i, length(c)) = c AND NOT regexp_matches(substr(text, i + length(c), 1), '[0-9a-z]')")
def extract_spans(spark, d):
    return _legal(spark, d).select("doc_id", F.explode(C.extract_spans(F.col("text"))).alias("c")).select("doc_id", F.col("c.text").alias("citation"), "c.start", "c.end")


@query(with_(LEGAL, FOUND, "c AS (SELECT DISTINCT unnest(found) AS citation FROM fd), p AS (SELECT citation, nullif(regexp_extract(citation, 'Art\\.?\\s*(\\d+[a-z]?)', 1, 'i'), '') AS art, nullif(regexp_extract(citation, 'Abs\\.?\\s*(\\d+)', 1, 'i'), '') AS abs, CASE WHEN citation LIKE 'SR %' THEN regexp_extract(citation, '^SR\\s*(\\d{3}(\\.\\d+)*)', 1) WHEN citation LIKE 'Art%' THEN nullif(regexp_extract(citation, '(?i)Art\\.?\\s*\\d+[a-z]?(?:\\s*Abs\\.?\\s*\\d+)?\\s*([A-Z]{2,})', 1), '') END AS law FROM c)") + "SELECT citation, CASE WHEN citation LIKE 'BGE%' THEN 'bge' WHEN law IS NOT NULL THEN 'law' END AS kind, CASE WHEN citation LIKE 'BGE%' OR law IS NULL THEN NULL ELSE art END AS art, CASE WHEN citation LIKE 'BGE%' OR law IS NULL THEN NULL ELSE abs END AS abs, law, CASE WHEN citation LIKE 'BGE%' THEN citation WHEN law IS NOT NULL THEN concat_ws(' ', 'Art. ' || art, 'Abs. ' || abs, law) END AS norm FROM p")
def parse_normalize(spark, d):
    c = _legal(spark, d).select(F.explode(C.extract(F.col("text"))).alias("citation")).distinct().withColumn("p", C.parse(F.col("citation")))
    return c.select("citation", "p.kind", "p.art", "p.abs", "p.law", C.normal(F.col("p")).alias("norm"))


@query(with_(LEGAL) + "SELECT doc_id, regexp_replace(text, 'SR 220 Art\\. (\\d+)', 'Art. \\1 220', 'g') AS text FROM legal")
def normalize_sr(spark, d):
    return _legal(spark, d).select("doc_id", C.normalise_sr(F.col("text")).alias("text"))


@query(with_(LEGAL, FOUND) + f"SELECT doc_id, list_reduce(list_concat([text], {LONGEST.format('found')}), lambda a, c: replace(a, c, '')) AS text FROM fd")
def remove_citations(spark, d):
    return _legal(spark, d).select("doc_id", C.without_citations(F.col("text")).alias("text"))


HIDDEN = f"hid AS (SELECT doc_id, found, list_reduce(list_concat([text], {LONGEST.format('found')}), lambda a, c: replace(a, c, replace(c, ' ', chr(2)))) AS t FROM fd), ps AS (SELECT doc_id, found, [replace(x, chr(2), ' ') FOR x IN {SENT.format('t')}] AS s FROM hid), one AS (SELECT doc_id, found, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS no FROM ps)"


@query(with_(LEGAL, FOUND, HIDDEN) + "SELECT doc_id, no, sentence FROM one")
def protected_sentences(spark, d):
    return _legal(spark, d).select("doc_id", F.posexplode(T.protected_sentences(F.col("text"), C.extract(F.col("text")))).alias("no", "sentence"))


@query()
def abbreviation_sentences(spark, d):
    return _legal(spark, d).select("doc_id", F.posexplode(T.abbreviation_sentences(F.col("text"))).alias("no", "sentence"))


@query(with_(LEGAL, FOUND, HIDDEN) + "SELECT doc_id, citation, no AS pos FROM (SELECT doc_id, no, sentence, unnest(found) AS citation FROM one) WHERE contains(sentence, citation)")
def citation_edges_all(spark, d):
    return citations.edges(_legal(spark, d))


PARSED = "pc AS (SELECT *, regexp_extract(citation, 'Art\\. (\\d+)', 1) AS art, regexp_extract(citation, 'Abs\\. (\\d+)', 1) AS abs, CASE WHEN citation LIKE 'BGE%' THEN '' WHEN citation LIKE 'SR %' THEN substr(citation, 4, 3) ELSE regexp_extract(citation, ' ([A-Za-z]+)$', 1) END AS law FROM cs), pn AS (SELECT *, CASE WHEN law = '' THEN citation ELSE concat('Art. ', art, CASE WHEN abs <> '' THEN ' Abs. ' || abs ELSE '' END, ' ', law) END AS norm, CASE WHEN abs <> '' THEN 2 ELSE 0 END AS gran FROM pc)"


@query(with_(LEGAL, STRICT, "cs AS (SELECT DISTINCT doc_id % 200 AS query_id, unnest(found) AS citation FROM fd)", PARSED) + "SELECT DISTINCT query_id, norm AS citation FROM pn WHERE law = '' UNION SELECT query_id, norm FROM (SELECT *, max(gran) OVER (PARTITION BY query_id, law, art) AS top FROM pn WHERE law <> '') WHERE gran = top")
def dedup_citations(spark, d):
    c = _legal(spark, d).select((F.col("doc_id") % 200).alias("query_id"), F.explode(C.extract(F.col("text"), "strict")).alias("citation"))
    return citations.dedup(c)


@query(with_(LEGAL, STRICT, "cs AS (SELECT doc_id % 200 AS query_id, unnest(found) AS citation, 1.0::DOUBLE / generate_subscripts(found, 1) AS score, doc_id * 100 + generate_subscripts(found, 1) - 1 AS pos FROM fd)", PARSED, "k AS (SELECT *, CASE WHEN law = '' THEN norm ELSE law || '|' || art END AS key FROM pn)") + "SELECT query_id, arg_max({'n': norm, 's': score}, {'g': gran, 'p': -pos}).n AS citation, round(arg_max({'n': norm, 's': score}, {'g': gran, 'p': -pos}).s, 6) AS score, min(pos) AS pos FROM k GROUP BY query_id, key")
def dedup_citations_scored(spark, d):
    c = _legal(spark, d).select((F.col("doc_id") % 200).alias("query_id"), "doc_id", F.posexplode(C.extract(F.col("text"), "strict")).alias("i", "citation"))
    return citations.dedup_scored(c.select("query_id", "citation", (1.0 / (1 + F.col("i"))).alias("score"), (F.col("doc_id") * 100 + F.col("i")).alias("pos")))


@query(with_(LEGAL, FOUND, "c AS (SELECT DISTINCT doc_id % 200 AS query_id, unnest(found) AS citation FROM fd), p AS (SELECT *, lower(regexp_extract(citation, '^Art\\.? (\\d+)', 1)) AS art, upper(regexp_extract(citation, '\\s([A-ZÄÖÜ]\\pL+)$', 1)) AS law, contains(citation, 'Abs.') AS fine FROM c)") + "SELECT query_id, citation FROM p a WHERE NOT (art <> '' AND law <> '' AND NOT fine AND EXISTS (SELECT 1 FROM p b WHERE b.query_id = a.query_id AND b.art = a.art AND b.law = a.law AND b.fine))")
def shadow_filter(spark, d):
    c = _legal(spark, d).select((F.col("doc_id") % 200).alias("query_id"), F.explode(C.extract(F.col("text"))).alias("citation")).distinct()
    return citations.without_shadowed(c)


@query("WITH s AS (SELECT doc_id, " + SENT.format("text") + " AS s FROM documents), p AS (SELECT doc_id, s, unnest(range(0, len(s))) AS i FROM s) SELECT doc_id, i AS no, array_to_string(s[greatest(i - 2, 0) + 1:i + 3], ' ') AS evidence FROM p")
def evidence_window(spark, d):
    s = _docs(spark, d).select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", "s", F.explode(F.sequence(F.lit(0), F.greatest(F.size("s") - 1, F.lit(0)))).alias("no")).where(F.size("s") > 0).select("doc_id", "no", T.around(F.col("s"), F.col("no"), 2).alias("evidence"))


@query("WITH s AS (SELECT doc_id, " + SENT.format("text") + " AS s FROM documents), p AS (SELECT doc_id, s, unnest(range(0, len(s))) AS i FROM s) SELECT doc_id, i AS no, array_to_string(s[greatest(i - 1, 0) + 1:i], ' ') AS before, array_to_string(s[i + 2:i + 2], ' ') AS after FROM p")
def pre_post_context(spark, d):
    s = _docs(spark, d).select("doc_id", T.sentences(F.col("text")).alias("s"))
    b, a = T.before_and_after(F.col("s"), F.col("no"), 1)
    return s.where(F.size("s") > 0).select("doc_id", "s", F.explode(F.sequence(F.lit(0), F.size("s") - 1)).alias("no")).select("doc_id", "no", b.alias("before"), a.alias("after"))


_PIECES = "regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]+|[^\\s]')"


@query(
    with_(LEGAL, FOUND, f"tk AS (SELECT doc_id, {_PIECES.format('text')} AS t, unnest(found) AS citation FROM fd)", f"tc AS (SELECT *, {_PIECES.format('citation')} AS c FROM tk)", "ta AS (SELECT *, list_min(list_filter(range(1, len(t) - len(c) + 2), lambda i: t[i:i + len(c) - 1] = c)) AS p FROM tc)")
    + "SELECT DISTINCT doc_id, citation, size, array_to_string(t[greatest(p - size // 2, 1):p + len(c) - 1 + size // 2], ' ') AS \"window\" FROM ta CROSS JOIN (VALUES (8), (16)) v(size)"
)
def token_window(spark, d):
    toks = lambda c: F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+|[^\s]"), F.lit(0))
    # A text is cut and joined once, not for each citation and size. Its citations are distinct, and so are the rows.
    c = _legal(spark, d).select("doc_id", T.searched(toks(F.col("text"))).alias("t"), C.extract(F.col("text")).alias("c")).select("doc_id", "t", F.explode("c").alias("citation"))
    w = c.select("doc_id", "citation", F.posexplode(T.windows_in(F.col("t"), toks(F.col("citation")), (8, 16))).alias("i", "window"))
    return w.select("doc_id", "citation", F.when(F.col("i") == 0, 8).otherwise(16).alias("size"), "window")


BG = "(CASE WHEN length({0}) < 2 THEN [] ELSE list_distinct([substr(lower({0}), i, 2) FOR i IN range(1, length({0}))]) END)"


@query("WITH p AS (SELECT c1.c_custkey AS id, " + BG.format("c1.c_name") + " AS a, " + BG.format("n_name") + " AS b FROM customer c1 JOIN nation ON c_nationkey = n_nationkey) SELECT id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END, 6) AS jaccard FROM p")
def char_bigram_jaccard(spark, d):
    p = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return p.select(F.col("c_custkey").alias("id"), T.jaccard(T.bigrams(F.col("c_name")), T.bigrams(F.col("n_name"))).alias("jaccard"))


@query("WITH p AS (SELECT conv_id, turn, lower(text) AS a, lower(lead(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS b FROM conversations), w AS (SELECT conv_id, turn, list_distinct(" + WORDS.format("a") + ") AS a, " + WORDS.format("b") + " AS b FROM p WHERE b IS NOT NULL) SELECT conv_id, turn, round(CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, list_distinct(b))) / len(a) END, 6) AS coverage FROM w")
def term_coverage(spark, d):
    from pyspark.sql import Window

    p = table(spark, d, "conversations").withColumn("b", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b is not null")
    return p.select("conv_id", "turn", T.coverage(F.col("text"), F.col("b")).alias("coverage"))


@query("SELECT item_id AS query_id, len(" + WORDS.format("text") + ") AS n_tokens, length(text) AS n_chars, CAST(len(" + WORDS.format("text") + ") < 10 AS BIGINT) AS is_short, CAST(len(" + WORDS.format("text") + ") > 40 AS BIGINT) AS is_long, CAST(contains(text, '?') AS BIGINT) AS has_question, length(text) - length(replace(text, ',', '')) AS n_commas, length(text) - length(replace(text, '\"', '')) AS n_quotes, CAST(regexp_matches(text, 'Art\\.?\\s*\\d', 'i') AS BIGINT) AS has_art, CAST(regexp_matches(text, 'BGE\\s+\\d', 'i') AS BIGINT) AS has_bge, CAST(regexp_matches(text, '\\d') AS BIGINT) AS has_digit FROM benchmark")
def query_features(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), *[c.alias(k) for k, c in T.query_features(F.col("text")).items()])


@query("SELECT doc_id, " + " + ".join(f"CAST(contains(lower(text), '{k}') AS BIGINT)" for k in ["gemäss", "nach", "laut", "gestützt auf", "in anwendung von", "im sinne von", "aufgrund von"]) + " AS n FROM documents")
def keyword_features(spark, d):
    return _docs(spark, d).select("doc_id", T.keyword_count(F.col("text"), features.KEYWORDS["pos_strong"]).alias("n"))


def _count(words: str) -> str:
    return "(" + " + ".join(f"contains(lower(sentence), '{w}')::INT" for w in words.split("|")) + ")"


_STRONG, _CONCLUDING = "gemäss|nach|laut|gestützt auf|in anwendung von|im sinne von|aufgrund von", "entscheidend ist|massgebend ist|ist zu prüfen|ist zu entscheiden|ergibt sich aus|folgt aus"
_FACT = "macht geltend|stellte fest|wird ausgeführt|laut den angaben"
RULES = f"""ss AS (SELECT doc_id, len(s) AS n_sentences, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS sentence_idx FROM (SELECT doc_id, {SENT.format("text")} AS s FROM legal)),
 sc AS (SELECT *, list_distinct(list_concat({", ".join(f"regexp_extract_all(sentence, '{_STRICT[f]}', 0, 'i')" for f in ("art", "sr", "bge"))})) AS cs FROM ss),
 se AS (SELECT *, len(cs) AS n, unnest(cs) AS citation FROM sc)"""


@query(with_(LEGAL, RULES) + f"SELECT doc_id, sentence_idx, citation, 2 * {_count(_STRONG)} + {_count('vgl.|vgl. auch|siehe|siehe auch')} + 3 * {_count(_CONCLUDING)} AS pos_keyword_score, 3 * {_count('kann offen bleiben|nicht entscheidend|braucht nicht entschieden')} + 2 * {_count(_FACT)} + {_count('unter anderem|beispielsweise|z.b.|insbesondere')} AS neg_keyword_score, ({_count(_CONCLUDING)} > 0)::BIGINT AS is_conclusion_sentence, ({_count(_FACT)} > 0)::BIGINT AS is_fact_sentence, ({_count(_STRONG)} > 0)::BIGINT AS has_strong_positive, round(sentence_idx / n_sentences, 6) AS pos_norm, round((strpos(sentence, citation) - 1) / length(sentence), 6) AS char_pos_norm, 0 AS is_prep_object, 0 AS is_subject, n AS num_citations_in_sentence, (n = 1)::BIGINT AS is_single_citation, length(sentence) AS sentence_len FROM se")
def rule_based_features(spark, d):
    s = _legal(spark, d).select("doc_id", T.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").alias("n_sentences"), F.posexplode("s").alias("sentence_idx", "sentence"))
    found = s.withColumn("c", C.extract_spans(F.col("sentence"))).withColumn("n_citations", F.size("c"))
    rows = features.rule_based(found.select("*", F.explode("c").alias("one")).select("*", F.col("one.text").alias("citation"), F.col("one.start").alias("start")))
    return rows.drop("n_sentences", "sentence", "c", "one", "start", "n_citations")


@query()
def section_split(spark, d):
    return sections.sections(_docs(spark, d)).withColumn("notes", F.array_join("notes", "; "))


@query(with_(LEGAL) + "SELECT doc_id, CASE WHEN regexp_matches(text, 'Sachverhalt|Tatbestand|A\\.\\s', 'i') THEN 0.7 WHEN regexp_matches(text, 'Erwägung|E\\.\\s', 'i') THEN 0.6 WHEN regexp_matches(text, 'Dispositiv|Demnach|erkennt', 'i') THEN 0.9 WHEN regexp_matches(text, 'Rechtsmittel|Beschwerde', 'i') THEN 0.35 WHEN regexp_matches(text, '\\d{1,2}\\.\\s\\w+\\s\\d{4}|Im Namen', 'i') THEN 0.15 ELSE 1.0 END::DOUBLE AS weight FROM legal")
def section_weight(spark, d):
    return _legal(spark, d).select("doc_id", sections.section_type(F.col("text")).alias("weight"))


#: Judgments from legal texts: some with a header of their own, some with a phrase, some with an end, some with neither.
JUDGED = "judged AS (SELECT doc_id, concat(CASE doc_id % 4 WHEN 0 THEN E'Erwägungen:\n' WHEN 1 THEN 'Nach den Erwägungen ' WHEN 2 THEN E'Aus den Erwägungen\n' ELSE '' END, text, CASE WHEN doc_id % 3 = 0 THEN E'\nDemnach erkennt das Gericht' WHEN doc_id % 3 = 1 THEN E'\nDispositiv' ELSE '' END) AS text FROM legal)"


def _judged(spark, d):
    i = F.col("doc_id")
    head = F.when(i % 4 == 0, "Erwägungen:\n").when(i % 4 == 1, "Nach den Erwägungen ").when(i % 4 == 2, "Aus den Erwägungen\n").otherwise("")
    tail = F.when(i % 3 == 0, "\nDemnach erkennt das Gericht").when(i % 3 == 1, "\nDispositiv").otherwise("")
    return _legal(spark, d).select("doc_id", F.concat(head, F.col("text"), tail).alias("text"))


SPANNED = "spanned AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 8 WHEN 2 THEN 5 END AS start_pattern, CASE WHEN doc_id % 4 = 3 THEN NULL WHEN doc_id % 3 = 0 THEN 3 WHEN doc_id % 3 = 1 THEN 0 END AS end_pattern, CASE WHEN doc_id % 4 <> 3 THEN trim(text) END AS body FROM legal)"


@query(with_(LEGAL, SPANNED) + "SELECT doc_id, coalesce(start_pattern, -1) AS start_pattern, coalesce(end_pattern, -1) AS end_pattern, CASE WHEN length(body) >= 80 THEN body END AS text FROM spanned")
def section_extract(spark, d):
    s = _judged(spark, d).select("doc_id", sections.considerations(F.col("text")).alias("s"))
    return s.select("doc_id", "s.text", *[F.coalesce(f"s.{c}", F.lit(-1)).alias(c) for c in ("start_pattern", "end_pattern")])


@query(with_(LEGAL, SPANNED) + "SELECT coalesce(CASE WHEN length(body) >= 80 THEN start_pattern END, -1) AS start_pattern, count(*) AS n FROM spanned GROUP BY 1")
def pattern_histogram(spark, d):
    return sections.pattern_histogram(_judged(spark, d)).na.fill(-1)


@query("WITH s AS (SELECT doc_id, " + SENT.format("text") + " AS s FROM documents) SELECT doc_id, len(list_filter(s, lambda x: length(x) > 30)) AS long_sentences FROM s")
def long_sentences(spark, d):
    return _docs(spark, d).select("doc_id", F.size(T.long_sentences(F.col("text"))).alias("long_sentences"))


@query()
def packed_sentences(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(T.packed(T.sentences(F.col("text")))).alias("no", "chunk"))


@query(with_(LEGAL, "s AS (SELECT doc_id, " + SENT.format("text") + " AS s FROM legal), m AS (SELECT doc_id, s, [regexp_matches(x, 'Art\\.?\\s*\\d|SR\\s*\\d|BGE\\s+\\d', 'i') FOR x IN s] AS h FROM s), a AS (SELECT *, list_position(h, true) AS p FROM m)") + "SELECT doc_id, coalesce(nullif(array_to_string(CASE WHEN p > 0 THEN s[1:p - 1] ELSE s END, ' '), ''), 'none') AS facts FROM a")
def leading_facts(spark, d):
    s = _legal(spark, d).select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", T.leading_facts(F.col("s"), F.transform("s", lambda x: x.rlike(r"(?i)Art\.?\s*\d|SR\s*\d|BGE\s+\d"))).alias("facts"))


SYNONYMS = [("the", "a"), ("the", "this"), ("and", "plus"), ("is", "are"), ("and", "also")]


@query("WITH sy(term, synonym) AS (VALUES ('the', 'a'), ('the', 'this'), ('and', 'plus'), ('is', 'are'), ('and', 'also')), w AS MATERIALIZED (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: length(x) > 1) AS t FROM conversations), m AS (SELECT conv_id, turn, synonym, min(list_position(t, term)) AS p FROM w, sy WHERE list_contains(t, term) AND NOT list_contains(t, synonym) GROUP BY ALL), more AS (SELECT conv_id, turn, list(synonym ORDER BY p, synonym) AS more FROM m GROUP BY ALL) SELECT conv_id, turn, array_to_string(list_concat(t, t, coalesce(more, [])), ' ') AS text FROM w LEFT JOIN more USING (conv_id, turn)")
def synonym_expand(spark, d):
    """Synonyms that occur in the conversations."""
    from ..operators.rerank import synonym_expansion

    q = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("query_id"), "text")
    return synonym_expansion(q, spark.createDataFrame(SYNONYMS, "term string, synonym string")).select("query_id.conv_id", "query_id.turn", "text")
