"""Toxicity: a classifier chain of linear models over hashed words.

Categories are predicted one after the other, and each later model also gets the probabilities of the earlier
ones. In training these are out-of-fold predictions, so that a later model sees what it will see on new texts.
The labels name no categories but the last; the two before it are learned: toxic training texts fall into two kinds by
the words that tell them from clean ones. A model is a logistic regression on the presence of words and of their first
letters, whatever the length of the text.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .quality import sample
from .tokens import Remembered

CATEGORIES = ("kind_1", "kind_2", "toxic")
BUCKETS = 1 << 18
_LETTERS = re.compile(r"[^\W\d_]+")


def features(unit: str) -> list[int]:
    """Buckets of a white-space word: its runs of letters in lower case, whole and by their first four and five."""
    out = []
    for w in _LETTERS.findall(unit.lower()):
        out += [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in {w, f"{w[:4]}-", f"{w[:5]}-"}]
    return out


def _fit(x: tuple, extra: np.ndarray, y: np.ndarray, rows: np.ndarray, steps: int = 150, l1: float = 1e-3) -> tuple:
    """Logistic regression on some rows, by AdaGrad with a proximal step. Words only add evidence: their weights are not
    negative, so that clean words can't outweigh a toxic one in a long text. x: row and feature of each entry."""
    owner, feature, n_features = x
    member = np.full(len(y), -1)
    member[rows] = np.arange(len(rows))
    some = member[owner] >= 0
    owner, feature, n = member[owner[some]], feature[some], max(len(rows), 1)
    e, t = extra[rows], y[rows].astype(float)
    w, b, a = np.zeros(n_features), 0.0, np.zeros(e.shape[1])
    gw, gb, ga = np.full(n_features, 1e-8), 1e-8, np.full(e.shape[1], 1e-8)
    for _ in range(steps):
        g = (_sigmoid(np.bincount(owner, w[feature], len(rows)) + b + e @ a) - t) / n
        d = np.bincount(feature, g[owner], n_features)
        gw += d * d
        w = np.maximum(w - 0.5 / np.sqrt(gw) * (d + l1), 0)
        gb += g.sum() ** 2
        b -= 0.5 * g.sum() / np.sqrt(gb)
        if len(a):
            da = e.T @ g
            ga += da * da
            a -= 0.5 * da / np.sqrt(ga)
    return w, b, a


def _logits(x: tuple, extra: np.ndarray, model: tuple) -> np.ndarray:
    owner, feature, _ = x
    w, b, a = model
    return np.bincount(owner, w[feature], len(extra)) + b + extra @ a


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def kinds(x: tuple, y: np.ndarray, words: int = 300, rounds: int = 20) -> np.ndarray:
    """0 or 1 for each toxic text, -1 for others: two means on the unit vectors of the features that are most typical of
    toxic texts, started from the two texts that are least alike."""
    owner, feature, n_features = x
    out = np.full(len(y), -1)
    rows = np.flatnonzero(y)
    toxic = y[owner]
    inside, outside = np.bincount(feature[toxic], minlength=n_features), np.bincount(feature[~toxic], minlength=n_features)
    odds = np.log((inside + 0.5) / (len(rows) + 1)) - np.log((outside + 0.5) / (len(y) - len(rows) + 1))
    odds[inside < 2] = 0
    top = np.argsort(-odds, kind="stable")[:words]
    column = np.full(n_features, -1)
    column[top] = np.arange(len(top))
    place = np.full(len(y), -1)
    place[rows] = np.arange(len(rows))
    m = np.zeros((len(rows), len(top)))
    some = toxic & (column[feature] >= 0)
    m[place[owner[some]], column[feature[some]]] = np.maximum(odds[feature[some]], 0)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    if not len(rows):
        return out
    first = int(m.sum(axis=1).argmax())
    centres = np.stack([m[first], m[int((m @ m[first]).argmin())]])
    own = np.zeros(len(rows), np.int64)
    for _ in range(rounds):
        own = (m @ centres.T).argmax(axis=1)
        for c in range(2):
            if (own == c).any():
                centres[c] = m[own == c].mean(axis=0)
    out[rows] = own
    return out


def train(texts: list[str], labels: list[int], folds: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """-> word weights (bucket, category), biases, chain weights (category, earlier category)."""
    known = Remembered(features, 100_000)
    rows = [np.array([f for u in set(t.split()) for f in known[u]], np.int64) for t in texts]
    owner, flat = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([*rows, np.zeros(0, np.int64)])
    pairs = np.unique(owner * BUCKETS + flat)
    often = np.bincount(pairs % BUCKETS, minlength=BUCKETS) >= min(5, len(texts))
    used, feature = np.unique(pairs[often[pairs % BUCKETS]] % BUCKETS, return_inverse=True)
    x = (pairs[often[pairs % BUCKETS]] // BUCKETS, feature, len(used))
    n, k, toxic = len(texts), len(CATEGORIES), np.array(labels, bool)
    kind = kinds(x, toxic)
    targets = [kind == 0, kind == 1, toxic]
    weights, bias, chain = np.zeros((BUCKETS, k)), np.full(k, -5.0), np.zeros((k, k))
    if not n:
        return weights, bias, chain
    extra, everyone = np.zeros((n, 0)), np.arange(n)
    for c, y in enumerate(targets):
        w, b, a = _fit(x, extra, y, everyone)
        weights[used, c], bias[c], chain[c, : len(a)] = w, b, a
        if c + 1 < k:
            out = np.zeros(n)
            for f in range(folds):
                part = _fit(x, extra, y, everyone[everyone % folds != f])
                out[everyone % folds == f] = _sigmoid(_logits(x, extra, part))[everyone % folds == f]
            extra = np.column_stack([extra, out])
    return weights, bias, chain


def fit(docs: DataFrame, labels: DataFrame, rows: int = 3000) -> tuple:
    """Trains on at most ``rows`` labelled documents, half of each class, none with crc32(doc_id) mod 5 = 0. Without
    any labelled row nothing is toxic."""
    model = train(*sample(docs, labels, "toxic", rows, per_class=True))
    common.release()
    return model


def score(docs: DataFrame, model: tuple, cut: float = 0.6) -> DataFrame:
    """docs (doc_id, text; a null text is empty and gets the bias alone) -> doc_id, p_kind_1, p_kind_2, score,
    predicted. Whole texts are read; repeated rows are scored once each."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scored(rows, model, cut).drop("text")


def scored(docs: DataFrame, model: tuple, cut: float = 0.6) -> DataFrame:
    """docs, which has no columns of these names, with p_kind_1, p_kind_2, score and predicted."""
    weights, bias, chain = model
    used = np.flatnonzero(np.abs(weights).max(axis=1) > 0)
    shared = docs.sparkSession.sparkContext.broadcast((used, weights[used], bias, chain))  # at most BUCKETS rows

    def make():
        probabilities = scorer(*shared.value)

        def step(texts):
            p = probabilities([t or "" for t in texts])
            return p[:, 0], p[:, 1], p[:, 2], (p[:, 2] >= cut).astype(np.int32)

        return step

    return common.with_columns(docs, ["text"], make, "p_kind_1 double, p_kind_2 double, score double, predicted int")


def scorer(used: np.ndarray, values: np.ndarray, bias: np.ndarray, chain: np.ndarray, remembered: int = 150_000):
    at = {f: i for i, f in enumerate(used.tolist())}

    def weighted(unit: str) -> tuple[int, ...]:
        return tuple({at[f] for f in features(unit) if f in at})

    known = Remembered(weighted, remembered)

    def of_texts(texts: list[str]) -> np.ndarray:
        z = np.zeros((len(texts), len(bias)))
        for i, t in enumerate(texts):
            # A feature counts once in a text, as in training, however many units have it.
            if present := set().union(*map(known.__getitem__, set(t.split()))):
                z[i] = values[sorted(present)].sum(axis=0)
        p = np.empty_like(z)
        for c in range(len(bias)):
            p[:, c] = _sigmoid(z[:, c] + bias[c] + p[:, :c] @ chain[c, :c])
        return p

    return of_texts
