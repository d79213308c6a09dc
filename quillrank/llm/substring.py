"""Substring dedup over token k-mers, a compacted De Bruijn graph.

Every window of k words is an edge from its first k - 1 words to its last k - 1. Edges that follow one another in a
document and share a minimizer are kept as one row, a run (see ``spans``), and runs meet by minimizer, so that equal edges
always meet. Runs that differ under one minimizer branch there: they meet with their words, and where they agree without a
branch their single edges become one. What is left is a graph of edges that occur more than once, each with the
coordinates of its source, the first occurrence.

Spark joins compact it: a node with one edge in and one out is no branch, so its two edges are steps of one path, and
pointers along such steps are doubled by joining the edges with themselves until each points to the head of its path.
Occurrences become stretches of paths, which make the spans of each document. When the texts are read to remove
them, the words at every occurrence's coordinates and at its source's are compared by a 128-bit digest of the words
themselves; should edges be equal by hash only, the query ends with an error and not with a wrong result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, spans
from .spans import CONTENT, FOUND, HOT, SOURCE


def _second_map(window: int):
    """Candidates: the words that a run covers, one row a run; of hot minimizers the single edges. (doc, body, first, count,
    anchor, hot) -> spans.ROW and content."""

    def make():
        text_of, words_of = spans.unpacker(), spans.by_words()
        got = common.Collector(lambda *c: spans.set_aside(*c, True, 0))
        held: list[tuple] = []

        def out(force: bool):
            rows = got.out(force)
            columns = [x.tolist() for x in rows] if rows else [[] for _ in range(8)]
            columns.append([None] * len(columns[0]))
            for r in held:
                for c, x in zip(columns, r, strict=True):
                    c.append(x)
            held.clear()
            return columns if columns[0] else None

        def step(docs, bodies, firsts, counts, anchors, kinds):
            for doc, body, first, count, anchor, kind in zip(docs, bodies, firsts, counts, anchors, kinds, strict=True):
                seq = words_of(text_of(body))
                if hot := [i for i in range(len(first)) if kind[i] == HOT]:
                    for a, b, pos in seq.windows(np.array([first[i] for i in hot], np.int64), np.array([count[i] for i in hot], np.int64), window):
                        got.add(a, b, np.full(len(pos), doc, np.int64), pos, np.ones(len(pos), np.int32))
                for f, c, a, k in zip(first, count, anchor, kind, strict=True):
                    if k != HOT:
                        held.append((a, a, 0, doc, f, c, False, CONTENT, b" ".join(seq.words[f : f + c + window - 1])))
            return out(False)

        step.rest = lambda: out(True)
        return step

    return make


def local_edges(doc, pos, m, content, words_of, window: int):
    """Columns of spans.FLAG for the repeated edges among runs of whole minimizers, given with their words. Windows that all
    occurrences have next to each other, and no other beside them, are one edge: nonbranching paths within a minimizer
    are compacted here, before any join."""
    seq = words_of(b" ".join(content))
    counts = m.astype(np.int64)
    begin = np.cumsum(counts + window - 1) - (counts + window - 1)
    step = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    at, run = np.repeat(begin, counts) + step, np.repeat(np.arange(len(counts)), counts)
    d, p = np.repeat(doc, counts), np.repeat(pos, counts) + step
    h1, h2 = seq.grams(0, seq.n - window + 1, window)[at], seq.seconds(at, window)
    order, starts, group = spans._grouped(h1, h2, d, p)
    ident = np.empty(len(at), np.int64)
    ident[order] = group
    lead = order[starts][ident]  # the first occurrence of each window's string
    again = (d != d[lead]) | (p != p[lead])
    repeated = np.zeros(len(starts), bool)
    repeated[ident[again]] = True
    many = repeated[ident]
    beside = np.zeros(len(at), bool)  # whether the next row is the next window of the run, and repeats too
    beside[:-1] = (run[1:] == run[:-1]) & many[1:] & many[:-1]
    after, before = np.full(len(at), -1), np.full(len(at), -1)
    after[:-1][beside[:-1]] = ident[1:][beside[:-1]]
    before[1:][beside[:-1]] = ident[:-1][beside[:-1]]

    def alike(x: np.ndarray) -> np.ndarray:
        low, high = (f.reduceat(x[order], starts) for f in (np.minimum, np.maximum))
        return low == high

    one_after, one_before = alike(after), alike(before)
    goes_on = np.zeros(len(at), bool)
    goes_on[:-1] = beside[:-1] & one_after[ident[:-1]] & one_before[ident[1:]]
    first = np.flatnonzero(many & ~np.concatenate([[False], goes_on[:-1]]))
    ends = np.flatnonzero(~goes_on)
    size = ends[np.searchsorted(ends, first)] - first + 1
    name = spans.both(spans.both(h1[first], h2[first]), size.astype(np.uint64))
    kind = np.where(again[first], FOUND, SOURCE).astype(np.int8)
    return d[first], p[first], size.astype(np.int32), kind, np.zeros(len(first), np.int64), common.signed(name)


def _second_meet(window: int, most: int = 1 << 18):
    """Rows sorted by route: single edges meet by their hash, runs by minimizer, in parts of about ``most`` bytes."""

    def make():
        words_of = spans.by_raw_words()

        def flush(_, a, b, doc, pos, m, many, kind, content):
            plain, whole = kind != CONTENT, np.flatnonzero(kind == CONTENT)
            parts = [spans.met(*(x[plain] for x in (a, b, doc, pos, m, many, kind)), True)]
            whole = whole[np.argsort(a[whole], kind="stable")]
            ends, anchors = np.cumsum([len(content[i]) for i in whole]), a[whole]
            at = 0
            while at < len(whole):
                end = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most)), at + 1)
                end = int(np.searchsorted(anchors, anchors[end - 1], side="right"))  # whole minimizers
                some = whole[at:end]
                parts.append(local_edges(doc[some], pos[some], m[some], content[some].tolist(), words_of, window))
                at = end
            return [np.concatenate(c) for c in zip(*parts, strict=True)]

        return common.by_key(flush, (*spans._TYPES, object), weigh=8)

    return make


def repeated_edges(rows: DataFrame, window: int, gram: int = 4, hot: int = 256) -> DataFrame:
    """rows (row, text) -> the graph's edges at all their occurrences: (doc, pos, m, kind, a, edge), kind SOURCE for the
    first one of each and FOUND for the others, m windows from pos on. A saved table."""
    flags = spans.met_runs(rows, spans.by_words, window, gram, True, hot)
    second = common.map_batches(spans.candidates(rows, flags), _second_map(window), f"{spans.ROW}, content binary", rows=200)
    more = common.map_batches(common.routed(second, "route").select(*spans.COLUMNS, "content"), _second_meet(window), spans.FLAG)
    return common.saved(flags.unionByName(more).where(F.col("kind").isin(FOUND, SOURCE)), "edges")


def _nodes(window: int):
    """The nodes that an edge leaves and enters: hashes of window - 1 words at its source."""

    def make():
        text_of, words = spans.unpacker(), spans.by_words()

        def step(bodies, firsts, counts, edges):
            out: list[list[np.ndarray]] = [[], [], [], []]
            for body, first, count, edge in zip(bodies, firsts, counts, edges, strict=True):
                seq, (at, m) = words(text_of(body)), spans.runs_of(first, count)
                for c, x in zip(out, (np.array(edge, np.int64), m, seq.seconds(at, window - 1), seq.seconds(at + m, window - 1)), strict=True):
                    c.append(common.signed(x))
            return [np.concatenate(c) for c in out] if bodies else None

        return step

    return make


def compacted(pieces: DataFrame) -> DataFrame:
    """pieces (edge, m, tail, head): edges of m windows from node tail to node head -> (edge, path, at): the path that it
    lies on, named by its first edge, and the windows of the path before it.

    Pointers to an edge ``at`` windows before are joined with themselves, so rounds grow with the logarithm of the longest
    path. Edges that never reach a head lie on a cycle without branches; each is a path of its own."""
    ends = pieces.select(F.col("tail").alias("node"), "edge", "m", F.lit(1).alias("out")).unionByName(pieces.select(F.col("head").alias("node"), "edge", "m", F.lit(0).alias("out")))
    leaves = F.col("out") == 1
    nodes = ends.groupBy("node").agg(F.sum("out").alias("outs"), F.count("*").alias("all"), F.max(F.when(leaves, F.col("edge"))).alias("edge"), F.max(F.when(~leaves, F.struct("edge", "m"))).alias("before"))
    steps = nodes.where("outs = 1 and all = 2 and edge != before.edge").select("edge", F.col("before.edge").alias("up"), F.col("before.m").cast("long").alias("at"))
    state = common.saved(steps, "steps")
    heads = pieces.select("edge").join(state.select("edge"), "edge", "left_anti").select("edge", F.col("edge").alias("path"), F.lit(0).cast("long").alias("at"))
    left = None
    while True:
        further = state.select(F.col("edge").alias("up"), F.col("up").alias("far"), F.col("at").alias("more"))
        moved = state.select("edge", "up", "at").join(further, "up", "left")
        state = common.saved(moved.select("edge", F.coalesce("far", "up").alias("up"), (F.col("at") + F.coalesce("more", F.lit(0))).alias("at"), F.col("far").isNull().alias("ended")), "steps")
        now = state.where("not ended").count()
        if now == 0 or now == left:  # what never ends is on a cycle
            own = F.col("ended")
            return heads.unionByName(state.select("edge", F.when(own, F.col("up")).otherwise(F.col("edge")).alias("path"), F.when(own, F.col("at")).otherwise(0).alias("at")))
        left = now


def repeated_paths(rows: DataFrame, edges: DataFrame, window: int) -> DataFrame:
    """(edge, path, at) of repeated_edges' edges."""
    each = {"pos": "first", "m": "count", "edge": "edge"}
    at = edges.where(F.col("kind") == SOURCE).groupBy("doc").agg(*[F.collect_list(c).alias(n) for c, n in each.items()])
    texts = spans.packed(rows.select(F.col("row").alias("doc"), "text")).join(at, "doc").select("body", *each.values())
    pieces = common.saved(common.map_batches(texts, _nodes(window), "edge long, m int, tail long, head long"), "pieces")
    # Of edges with several rows, as when two rows of one document are given, one counts.
    return compacted(pieces.groupBy("edge").agg(F.max("m").alias("m"), F.max("tail").alias("tail"), F.max("head").alias("head")))


def _kept(window: int):
    def make():
        text_of, words_of = spans.unpacker(), spans.by_words()

        def step(docs, bodies, firsts, counts, stretches, sources):
            n, removed, digest, kept_texts, edges, seen = [], [], [], [], [], []
            for body, first, count, own, its in zip(bodies, firsts, counts, stretches, sources, strict=True):
                seq = words_of(text_of(body))
                words = seq.words
                gone = seq.covered(*spans.runs_of(first, count), window)
                kept = b" ".join([words[i] for i in np.flatnonzero(~gone)] if gone.any() else words)
                n.append(seq.n)
                removed.append(int(gone.sum()))
                digest.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept.decode("utf-8", "replace"))
                some = [*(own or []), *(its or [])]
                edges.append([s["edge"] for s in some])
                seen.append([hashlib.blake2b(b" ".join(words[s["pos"] : s["pos"] + s["m"] + window - 1]), digest_size=16).digest() for s in some])
            return docs, n, removed, kept_texts, digest, edges, seen

        return step

    return make


def _spans_of(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """(doc, first, count, own): the spans that go, stretches of one path joined, and the occurrences they come from."""
    again = edges.where(F.col("kind") == FOUND).select("doc", "pos", "m", "edge")
    found = common.spread_join(again, paths, "edge", common.hot_values(again, "edge"))
    # Occurrences of a path that follow its steps lie on one diagonal of document and path.
    stretch = found.groupBy("doc", "path", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.array_sort(F.collect_list(F.struct("pos", "m", "edge"))).alias("own"))
    own, before, after = F.col("own"), lambda i: F.get("own", i - 1), lambda i: F.get("own", i + 1)
    first = F.filter(own, lambda x, i: (i == 0) | (before(i)["pos"] + before(i)["m"] < x["pos"]))
    last = F.filter(own, lambda x, i: (i == F.size("own") - 1) | (x["pos"] + x["m"] < after(i)["pos"]))
    stretch = stretch.withColumn("spans", F.zip_with(first, last, lambda x, y: F.struct(x["pos"].alias("pos"), (y["pos"] + y["m"] - x["pos"]).alias("m"))))
    return stretch.groupBy("doc").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("own")).alias("own")).select("doc", F.col("spans.pos").alias("first"), F.col("spans.m").alias("count"), "own")


def _read(rows: DataFrame, edges: DataFrame, found: DataFrame, window: int) -> DataFrame:
    its = edges.where(F.col("kind") == SOURCE).groupBy("doc").agg(F.collect_list(F.struct("pos", "m", "edge")).alias("its"))
    texts = spans.packed(rows.select("row", "doc_id", "text")).join(found.withColumnRenamed("doc", "row"), "row", "left").join(its.withColumnRenamed("doc", "row"), "row", "left")
    made = common.map_batches(texts.select("doc_id", "body", "first", "count", "own", "its"), _kept(window), "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string, edges array<long>, digests array<binary>")
    return common.saved(made, "kept")


def dedup_words(docs: DataFrame, window: int = 20, gram: int = 4, hot: int = 256) -> DataFrame:
    """Removes each word that a window of ``window`` words covers whose words also start earlier: in a smaller doc_id,
    or earlier in the same document. Windows are judged on the input. docs (doc_id, text) -> doc_id, n_words,
    n_removed, kept (the words that stay, joined by one blank), kept_sha256.

    A null or empty text has no words. A text of fewer words than a window stays. Repeated rows, null doc_ids
    and doc_ids that come with several texts are documents of their own, in the order of ``spans.numbered``; other
    columns of docs take no part.
    """
    if not 1 < gram < window:
        raise ValueError("gram must be in 2..window-1")
    rows = spans.numbered(docs)
    edges = repeated_edges(rows, window, gram, hot)
    made = _read(rows, edges, _spans_of(edges, repeated_paths(rows, edges, window)), window)
    pairs = made.select(F.explode(F.arrays_zip("edges", "digests")).alias("x")).select(F.col("x.edges").alias("edge"), F.col("x.digests").alias("digest"))
    unlike = pairs.groupBy("edge").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low != high").limit(1).count()
    if unlike:
        raise ArithmeticError("two different windows have equal 128-bit hashes; choose another gram")
    return made.drop("edges", "digests")
