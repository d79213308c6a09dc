"""Exact top-k inner products by best-first search in M-trees.

Inner products become distances: with the greatest squared norm as radius, a vector gets one more coordinate that
brings all to one norm, a query gets 0 there, and the nearer of two vectors is the one of greater product. Each
task builds a tree over a page of vectors: leaves hold vectors with their distances to the leaf's pivot, inner
nodes hold children with covering radii and distances to the parent's pivot. A query takes nodes in the order of
their least possible distance. Stored parent distances and the triangle inequality rule entries out before their
own distance is computed. Each query's best of all trees are merged.

Components are integers, so products are exact; bounds carry a slack for the rounding of distances.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

_SLACK = 1e-6


class Tree:
    """An M-tree over the rows of ``vectors`` (integers; equal norms after the added coordinate); ids: (id, row) of each."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, top_norm: float | None = None, leaf: int = 64, fan: int = 16, seed: int = 3):
        self.vectors, self.ids = vectors, ids
        norms = (vectors.astype(np.float64) ** 2).sum(axis=1)
        self.top = float(norms.max()) if top_norm is None and len(norms) else float(top_norm or 0)
        self.points = np.column_stack([vectors.astype(np.float64), np.sqrt(np.maximum(self.top - norms, 0))])
        self.rng = np.random.default_rng(seed)
        self.leaf, self.fan = leaf, fan
        #: (pivot, children, their radii, their parent distances) or (pivot, None, rows, their parent distances)
        self.nodes: list[tuple] = []
        self.computed = 0
        self.root = self._build(np.arange(len(vectors)), None) if len(vectors) else None

    def _build(self, rows: np.ndarray, pivot: np.ndarray | None) -> int:
        if pivot is None:
            pivot = self.points[rows].mean(axis=0)
        if len(rows) <= self.leaf:
            away = np.linalg.norm(self.points[rows] - pivot, axis=1)
            order = np.argsort(away)
            self.nodes.append((pivot, None, rows[order], away[order]))
            return len(self.nodes) - 1
        # Pivots far from each other, then each row to its nearest.
        chosen = [int(self.rng.integers(len(rows)))]
        near = np.linalg.norm(self.points[rows] - self.points[rows[chosen[0]]], axis=1)
        owner = np.zeros(len(rows), np.int64)
        while len(chosen) < self.fan:
            k = int(near.argmax())
            if near[k] <= 0:
                break
            d = np.linalg.norm(self.points[rows] - self.points[rows[k]], axis=1)
            owner[d < near] = len(chosen)
            near = np.minimum(near, d)
            chosen.append(k)
        if len(chosen) == 1:  # all equal: halves
            owner = np.arange(len(rows)) % 2
            chosen = [chosen[0], chosen[0]]
        kids, radii, apart = [], [], []
        for i, k in enumerate(chosen):
            part = rows[owner == i]
            if not len(part):
                continue
            p = self.points[rows[k]]
            kids.append(self._build(part, p))
            radii.append(float(np.linalg.norm(self.points[part] - p, axis=1).max()))
            apart.append(float(np.linalg.norm(p - pivot)))
        self.nodes.append((pivot, np.array(kids), np.array(radii), np.array(apart)))
        return len(self.nodes) - 1

    def search(self, query: np.ndarray, k: int, but: int | None = None) -> list[tuple[int, int, int]]:
        """The k best (score, id, row) of a query by falling score, ties to the smaller id, then row; row ``but`` takes no
        part."""
        if self.root is None:
            return []
        q = np.append(query.astype(np.float64), 0.0)
        whole = query.astype(np.int64)
        base = float(q @ q) + self.top
        best: list[tuple[int, int, int]] = []  # a heap of (score, -id, -row)

        def limit() -> float:
            # The distance of the k-th best so far.
            return math.inf if len(best) < k else math.sqrt(max(base - 2 * best[0][0], 0)) + _SLACK * (1 + math.sqrt(base))

        pivot = self.nodes[self.root][0]
        queue = [(0.0, self.root, float(np.linalg.norm(q - pivot)))]
        while queue:
            least, at, away = heapq.heappop(queue)
            reach = limit()
            if least > reach:
                break
            pivot, kids, a, b = self.nodes[at]
            if kids is None:
                rows = a[np.abs(away - b) <= reach]
                self.computed += len(rows)
                scores = self.vectors[rows].astype(np.int64) @ whole
                if len(best) == k:
                    rows, scores = rows[scores >= best[0][0]], scores[scores >= best[0][0]]
                for s, (i, u) in zip(scores.tolist(), self.ids[rows].tolist(), strict=True):
                    if u == but:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (s, -i, -u))
                    elif (s, -i, -u) > best[0]:
                        heapq.heapreplace(best, (s, -i, -u))
                continue
            live = np.flatnonzero(np.abs(away - b) - a <= reach)  # from stored distances alone
            if len(live):
                self.computed += len(live)
                d = np.linalg.norm(np.array([self.nodes[c][0] for c in kids[live]]) - q, axis=1)
                low = np.maximum(d - a[live], 0)
                for bound, c, dist in zip(low.tolist(), kids[live].tolist(), d.tolist(), strict=True):
                    if bound <= reach:
                        heapq.heappush(queue, (bound, c, dist))
        return [(s, -i, -u) for s, i, u in sorted(best, reverse=True)]


def _built(page: int):
    """Trees over pages of at most ``page`` vectors of one length: (uid, vec_id, v) -> (length, tree)."""

    def make():
        held: dict[int, tuple[list, list]] = {}

        def trees(least: int):
            full = [n for n, (ids, _) in held.items() if len(ids) >= least]
            out: list[list] = [[], []]
            for n in full:
                rows, vectors = held.pop(n)
                out[0].append(n)
                out[1].append(pickle.dumps(Tree(np.array(vectors, np.int64), np.array(rows, np.int64).reshape(-1, 2))))
            return out if full else None

        def step(uids, ids, vectors):
            for u, i, v in zip(uids, ids, vectors, strict=True):
                rows, some = held.setdefault(len(v), ([], []))
                rows.append((i, u))
                some.append(v)
            return trees(page)

        step.rest = lambda: trees(1)
        return step

    return make


def _searched(shared, k: int):
    def step(lengths, trees):
        out: list[list] = [[], [], [], [], []]
        for n, body in zip(lengths, trees, strict=True):
            if not shared.value.get(n):
                continue
            tree = pickle.loads(body)
            for uid, qid, q in shared.value[n]:
                for s, i, u in tree.search(q, k, uid):
                    for c, x in zip(out, (uid, qid, i, s, u), strict=True):
                        c.append(x)
        return out if out[0] else None

    return lambda: step


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as a double. Vectors that are null or hold a null or
    non-finite component, and those without a vec_id, take no part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).cast("array<long>").alias("v"))


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, block: int = 4096, page: int = 8192) -> DataFrame:
    """The k greatest inner products of each query, a row whose vec_id is divisible by ``every``, with every other row:
    query_id, rank, vec_id, score; ties to the smaller vec_id. Repeated rows of a vec_id are rows of their own: each is a
    candidate, also for the others, and each asks if the vec_id does. A vector meets those of its own length; an empty one
    takes no part.

    The trees are built once and kept as a table of pages. Queries go to it in blocks of ``block``, so what is broadcast
    has a bound.
    """
    spark = vectors.sparkSession
    rows = common.saved(quantised(vectors).where(F.size("v") > 0).withColumn("uid", F.monotonically_increasing_id()), "vectors").select("uid", "vec_id", "v")
    pages = common.saved(common.map_batches(rows, _built(page), "length int, tree binary", rows=4096), "pages")
    asked = rows.where(F.col("vec_id") % every == 0).orderBy("uid")
    found, after = None, -1
    while True:
        part = asked.where(F.col("uid") > after).limit(block).collect()
        if part:
            after = part[-1]["uid"]
            by_length: dict[int, list] = {}
            for r in part:
                by_length.setdefault(len(r["v"]), []).append((r["uid"], r["vec_id"], np.array(r["v"], np.int64)))
            some = common.map_batches(pages, _searched(spark.sparkContext.broadcast(by_length), k), "query long, query_id long, vec_id long, score long, uid long", rows=1)
            some = common.saved(some, "found")
            found = some if found is None else found.unionByName(some)
        if len(part) < block:
            break
    if found is None:
        found = spark.createDataFrame([], "query long, query_id long, vec_id long, score long, uid long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
