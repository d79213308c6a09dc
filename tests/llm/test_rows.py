"""Rows of the training-data operators that were once left out or counted twice."""

import re

import numpy as np

import corpus_pipeline
from quillrank.llm import bpe, packing, quality, tokens, toxicity
from quillrank.llm.queries import vocabulary


def test_a_feature_counts_once_in_a_text():
    weights = np.zeros((toxicity.BUCKETS, 3))
    weights[toxicity.features("loser")] = 0.7
    weights[toxicity.features("vile")] = 0.2
    used = np.flatnonzero(weights.any(axis=1))
    p = toxicity.scorer(used, weights[used], np.full(3, -2.0), np.zeros((3, 3)), 4)
    texts = ["loser", "Loser loser, (loser) loser-loser LOSER! loser.", "a loser is vile", "Vile, vile loser: a vile- loser!", "", "clean"]
    present = [{f for u in t.split() for f in toxicity.features(u)} for t in texts]
    assert np.allclose(p(texts), [1 / (1 + np.exp(2.0 - weights[sorted(fs)].sum(axis=0))) for fs in present])


def test_near_copies_go_by_row(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, a), (2, a), (2, b), (None, c), (None, c), (3, d), (3, d), (4, ""), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert sorted([(r["doc_id"], r["text"]) for r in out.collect()], key=repr) == sorted([(1, a), (2, b), (None, c), (3, d), (4, ""), (4, None)], key=repr)


def test_lexicon_counts_documents_that_are_not_plain(spark):
    file = tokens.read_file(vocabulary("word_bpe_49k.json"))
    docs = spark.createDataFrame([(1, "the \u201cquick\u201d fox"), (2, "the\tfox \u2014 the \u4e2d end"), (3, "the end")], "doc_id long, text string")
    lexicon, merges = bpe.Lexicon(bpe.build_lexicon(docs, file)), bpe.Merges(file)
    assert all(lexicon.ids(w) == merges.ids(w) for w in ("the", "fox", "quick", "end"))
    alone = bpe.Lexicon(bpe.build_lexicon(docs.where("doc_id < 3"), file, 2))
    assert alone.ids("the") == merges.ids("the") and alone.ids("fox") == merges.ids("fox")


def test_full_pieces_keep_to_the_cost(spark):
    docs = spark.createDataFrame([(i, "word " * n) for i, n in enumerate((500, 99, 100, 40, 7, 1))], "doc_id long, text string")
    file = vocabulary("byte_bpe_50k.json")
    out = packing.pack_documents(docs, file, 2, capacity=100, max_cost=2600).toPandas()
    cost = (out.length**2).groupby(out.sequence_id).sum()
    assert cost.max() <= 2600 and out.length.groupby(out.sequence_id).sum().max() <= 100
    assert out.length.sum() == packing.pack_documents(docs, file, 2, capacity=100).toPandas().length.sum()


def test_a_long_text_costs_itself_only(spark):
    """Of fifty labelled texts the first by hash is longer than all characters of the sample."""
    from pyspark.sql import functions as F

    ids = spark.range(1, 200).where(F.crc32(F.col("id").cast("string")) % 5 != 0).orderBy(F.xxhash64(F.col("id"), F.lit(11))).limit(50)
    order = [r["id"] for r in ids.collect()]
    docs = spark.createDataFrame([(i, "long " * 2000 if i == order[0] else f"text {i}") for i in order], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in order], "doc_id long, quality int")
    for per_class in (False, True):
        texts, _ = quality.sample(docs, labels, "quality", 100, chars=8000, per_class=per_class)
        assert sorted(texts) == sorted(f"text {i}" for i in order[1:])


def test_pieces_by_given_characters():
    words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:_|[^\s\w])+")
    spaced = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:_|[^\s\w])+|\s+(?!\S)|\s+")
    chars = [chr(c) for c in tokens._SAFE]
    texts = ["".join(chars), "it's we'll 'tis ''ve x'd\n\n a_b 12  3\n"] + [a + b + c for a in "a' 1_\n" for b in chars for c in "sl ."]
    for t in texts:
        assert tokens._SPACED.findall(t) == spaced.findall(t)
        assert tokens._WORDS.findall(t.lower()) == words.findall(t.lower())


def test_frequent_pieces_are_made_once():
    e, made = tokens.Encoder(tokens.read_file(vocabulary("word_bpe_49k.json")), 10, 10), []
    piece = e.plain.make
    e.plain.make = lambda p: made.append(p) or piece(p)
    for i in range(50):
        assert e.ids(f"often w{'x' * i}") == np.array(e.cut.tokenizer.encode(f"often w{'x' * i}", add_special_tokens=False).ids, "<u4").tobytes()
    assert made.count("often") == 1 and len(e.plain) + len(e.plain.before) <= 20
