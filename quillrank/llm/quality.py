"""Quality classifier: supervised subword embeddings.

A word's vector is the mean of the learned vectors of its hash and of its character n-grams' hashes; a document's
is the mean over its words, over one mark for each word that repeats the one before it, and over one mark that
every document has. A softmax follows. Training is stochastic gradient descent in numpy on a bounded sample of
labelled rows. As softmax of two classes is linear in the mean, a trained model scores a word by one number.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import Remembered

#: Marks that no white-space word equals.
EVERY, SAME = " every", " same"


def features(word: str, buckets: int, grams: tuple[int, int] = (3, 4)) -> list[int]:
    """Buckets of a word and of its character n-grams, between < and >."""
    data = word.encode("utf-8", "surrogatepass")
    out = [zlib.crc32(data) % buckets]
    if word in (EVERY, SAME):
        return out
    framed = f"<{word}>"
    for n in range(grams[0], grams[1] + 1):
        out += [zlib.crc32(framed[i : i + n].encode("utf-8", "surrogatepass"), n) % buckets for i in range(len(framed) - n + 1)]
    return out


def words_of(text: str) -> list[str]:
    words = text.split()
    return words + [SAME] * sum(map(operator.eq, words, words[1:])) + [EVERY]


def train(texts: list[str], labels: list[int], buckets: int = 1 << 17, dim: int = 8, epochs: int = 6, rate: float = 0.4, batch: int = 32, seed: int = 7) -> np.ndarray:
    """The learned log-odds of label 1 for each bucket (the embeddings times the difference of the outputs)."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim))
    out = np.zeros((2, dim))
    number: dict[str, int] = {}
    docs = []
    for t in texts:
        count = Counter(words_of(t))
        docs.append((np.array([number.setdefault(w, len(number)) for w in count]), np.array([*count.values()], np.float64)))
    feats = [np.array(features(w, buckets), np.int32) for w in number]
    size = np.array([len(f) for f in feats])
    y = np.array(labels)
    steps, done = epochs * -(-len(docs) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            lr = rate * batch * (1 - done / steps)
            done += 1
            words, inverse = np.unique(np.concatenate([docs[i][0] for i in some]), return_inverse=True)
            weight = np.concatenate([docs[i][1] / docs[i][1].sum() for i in some])
            owner = np.repeat(np.arange(len(some)), [len(docs[i][0]) for i in some])
            flat = np.concatenate([feats[w] for w in words])
            sizes = size[words]
            starts = np.cumsum(sizes) - sizes
            word_vec = np.add.reduceat(vectors[flat], starts, axis=0) / sizes[:, None]
            first = np.searchsorted(owner, np.arange(len(some)))
            doc_vec = np.add.reduceat(word_vec[inverse] * weight[:, None], first, axis=0)
            z = doc_vec @ out.T
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p /= len(some)
            to_doc = p @ out
            out -= lr * p.T @ doc_vec
            to_words = to_doc[owner] * weight[:, None]
            spread = np.repeat(np.stack([np.bincount(inverse, to_words[:, k], len(words)) for k in range(dim)], axis=1) / sizes[:, None], sizes, axis=0)
            for k in range(dim):
                vectors[:, k] -= lr * np.bincount(flat, spread[:, k], buckets)
    return vectors @ (out[1] - out[0])


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, chars: int = 40_000_000, held_out: bool = True, per_class: bool = False) -> tuple[list[str], list[int]]:
    """A bounded training sample: of the labelled documents in order of a hash of doc_id (of each class, if per_class) the
    first ``rows``, of ``chars`` characters together at most. A text of more than a twentieth of the characters takes no part,
    so that no text costs others their place and there are twenty at least, if so many are labelled. Null labels, and documents whose labels differ, give
    none; rows whose crc32(doc_id as text) mod 5 is 0 are left out with held_out."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("label is not null and doc_id is not null")
    own = own.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    if held_out:
        own = own.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Twice as many as needed, without their texts; then the texts of these alone.
    key = F.xxhash64(F.col("doc_id"), F.lit(11))
    classes = [F.col("label") == 1, F.col("label") != 1] if per_class else [F.lit(True)]
    chosen = None
    for c in classes:
        some = own.where(c).orderBy(key, "doc_id").limit(2 * rows // len(classes))
        chosen = some if chosen is None else chosen.unionByName(some)
    got = texts.where(F.length("text") <= chars // len(classes) // 20).join(F.broadcast(chosen), "doc_id")
    got = got.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    parts = []
    for c in classes:
        some = got.where(c).orderBy(key, "doc_id").limit(rows // len(classes)).withColumn("key", key)
        sized = some.withColumn("so_far", F.sum(F.length("text")).over(Window.orderBy("key", "doc_id")))  # at most ``rows`` rows
        parts += sized.where(F.col("so_far") <= chars // len(classes)).select("text", "label").collect()
    unlike: dict[str, int] = {}  # copies count once, with the label of the first
    for r in parts:
        unlike.setdefault(r["text"], int(r["label"] == 1))
    return [*unlike], [*unlike.values()]


def score(docs: DataFrame, weights: np.ndarray, cut: float = 0.3) -> DataFrame:
    """docs (doc_id, text; a null text is empty) -> doc_id, held_out, score, predicted. Whole texts are read; repeated
    rows are scored once each; a null doc_id isn't held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scored(rows, weights, cut).drop("text")


def scored(docs: DataFrame, weights: np.ndarray, cut: float = 0.3) -> DataFrame:
    """docs, which has no columns of these names, with held_out, score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # as many numbers as buckets

    def make():
        score_of = scorer(shared.value)

        def step(ids, texts):
            held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 0 for d in ids]
            scores = [score_of(t or "") for t in texts]
            return held, scores, [int(s >= cut) for s in scores]

        return step

    return common.with_columns(docs, ["doc_id", "text"], make, "held_out boolean, score double, predicted int")


def scorer(weights: np.ndarray, remembered: int = 150_000):
    w, buckets = weights.tolist(), len(weights)

    def of_word(word: str) -> float:
        f = features(word, buckets)
        return sum([w[i] for i in f]) / len(f)

    known = Remembered(of_word, remembered)
    same, every = of_word(SAME), of_word(EVERY)

    def of_text(text: str) -> float:
        words = text.split()
        repeats = sum(map(operator.eq, words, words[1:]))
        z = (sum(map(known.__getitem__, words)) + repeats * same + every) / (len(words) + repeats + 1)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return of_text


def fit(docs: DataFrame, labels: DataFrame, rows: int = 3000) -> np.ndarray:
    """Trains on at most ``rows`` labelled documents. Without any labelled row every score is 0.5."""
    texts, y = sample(docs, labels, "quality", rows)
    model = train(texts, y) if texts else np.zeros(1 << 17)
    common.release()
    return model
