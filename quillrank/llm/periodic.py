"""Periodic runs of words: stretches in which a block of words follows itself at least some number of times.

The method of Gusfield and Stoye for tandem repeats: the Lempel-Ziv blocks of a string give pairs that cover the leftmost
occurrence of every square; the pairs' ends are marked in a suffix tree; walks along suffix links from the marks find
the other rotations, until the vocabulary of squares is complete. The leaves below a mark are a square's occurrences,
and those that follow one another with one period are a run.

Texts are independent of each other, so Spark deals them to tasks and nothing is shuffled. Within a task, words that can't lie
in a run go first: a run holds each of its words as often as its block occurs, so a text is cut at rarer words, and the pieces
again, until none is left. The pieces of many texts are laid end to end, with separators that occur once, and have one tree.
The tree is made from a suffix array by doubling, whose ranks also give the longest common extensions.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Words that a task holds at once, but for a text that is longer by itself.
HELD = 300_000


class Ranks:
    """Ranks of the strings of 1, 2, 4 ... units at each place of a string of numbers. Equal ranks at two places mean equal
    strings that both end within the string."""

    def __init__(self, units: np.ndarray):
        self.n = n = len(units)
        _, rank = np.unique(units, return_inverse=True)
        self.levels = [rank.astype(np.int32)]
        order = np.argsort(rank, kind="stable")
        while n and int(rank[order[-1]]) < n - 1:
            step = 1 << (len(self.levels) - 1)
            key = rank.astype(np.int64) * (n + 1)
            key[: max(n - step, 0)] += rank[step:] + 1
            order = np.argsort(key, kind="stable")
            ahead = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(ahead[1:] != ahead[:-1])])
            self.levels.append(rank.astype(np.int32))
        self.order = order  # the suffix array

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at i and j, i other than j; 0 where one is the end."""
        i, j = i.copy(), j.copy()
        begin = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            same = (i < self.n) & (j < self.n)
            same[same] = level[i[same]] == level[j[same]]
            i[same] += 1 << k
            j[same] += 1 << k
        return i - begin

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common suffix of the prefixes that end with i and j; 0 where one is -1."""
        i, j = i.copy(), j.copy()
        begin = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level, back = self.levels[k], (1 << k) - 1
            same = (i >= back) & (j >= back)
            same[same] = level[i[same] - back] == level[j[same] - back]
            i[same] -= 1 << k
            j[same] -= 1 << k
        return begin - i


def blocks(ranks: Ranks) -> np.ndarray:
    """Where the Lempel-Ziv blocks start: each is the longest string that also starts earlier, or one new unit."""
    n, order = ranks.n, ranks.order.tolist()
    before, after, open_ = [-1] * n, [-1] * n, []
    for p in order:  # the nearest smaller places to both sides in the suffix array
        while open_ and open_[-1] > p:
            after[open_.pop()] = p
        before[p] = open_[-1] if open_ else -1
        open_.append(p)
    longest = np.zeros(n, np.int64)
    places = np.arange(n)
    for near in (np.array(before), np.array(after)):
        has = near >= 0
        longest[has] = np.maximum(longest[has], ranks.forward(places[has], near[has]))
    starts, at, longest = [], 0, longest.tolist()
    while at < n:
        starts.append(at)
        at += max(1, longest[at])
    return np.array(starts, np.int64)


def covering(ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of squares with primitive blocks, of which one reaches the leftmost occurrence of each such square by
    moving right within a run. The centre of a square lies in a block; its right end is in that block or the next."""
    starts = blocks(ranks)
    if len(starts) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.diff(np.append(starts, ranks.n))
    following = np.append(size[1:], 0)

    def each(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block numbers and 1, 2 ... up to each block's count."""
        block = np.repeat(np.arange(len(counts)), counts)
        return block, np.arange(len(block)) - np.repeat(np.cumsum(counts) - counts, counts) + 1

    found = []
    # Right end in the next block.
    block, k = each(np.where(following > 0, size, 0))
    edge = starts[block] + size[block]
    back = edge - k
    ahead, behind = ranks.forward(edge, back), ranks.backward(edge - 1, back - 1)
    good = (ahead + behind >= k) & (ahead > 0)
    found.append((np.maximum(back - behind, back - k + 1)[good], k[good]))
    # Left end before the block.
    block, k = each(size + following)
    edge = starts[block]
    there = edge + k < ranks.n
    block, k, edge = block[there], k[there], edge[there]
    ahead, behind = ranks.forward(edge, edge + k), ranks.backward(edge - 1, edge + k - 1)
    start = np.maximum(edge - behind, edge - k + 1)
    good = (ahead + behind >= k) & (ahead > 0) & (behind > 0) & (start + k <= edge + size[block])
    found.append((start[good], k[good]))
    start, period = np.unique(np.concatenate([np.column_stack(x) for x in found]), axis=0).T
    return primitive(ranks, start, period)


def primitive(ranks: Ranks, start: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those squares whose block isn't itself a repetition of a shorter one: no prime part of the period is a period."""
    good, rest = np.ones(len(period), bool), period.copy()

    def drop(some: np.ndarray, prime: np.ndarray) -> None:
        short = period[some] // prime
        good[some] &= ranks.forward(start[some], start[some] + short) < 2 * period[some] - short

    prime = 2
    while len(rest) and prime * prime <= int(rest.max()):
        some = np.flatnonzero(rest % prime == 0)
        if len(some):
            drop(some, np.full(len(some), prime))
            while (divides := (rest % prime == 0) & (rest > 1)).any():
                rest[divides] //= prime
        prime += 1
    some = np.flatnonzero(rest > 1)
    drop(some, rest[some])
    return start[good], period[good]


class Tree:
    """A suffix tree: leaves 0 .. n - 1 by rank, then inner nodes, each after those below it; the root is last."""

    def __init__(self, units: np.ndarray, ranks: Ranks):
        n = ranks.n
        order = ranks.order
        common_ = ranks.forward(order[:-1], order[1:]).tolist() if n > 1 else []
        self.units, self.order = units.tolist(), order.tolist()
        depth, parent, left, right = [n - p for p in self.order], [-1] * n, list(range(n)), list(range(n))
        open_: list[tuple[int, int, list[int]]] = [(0, 0, [])]  # depth, left end, nodes below
        for rank in range(n):
            last = rank
            here = common_[rank] if rank < n - 1 else -1
            while open_ and open_[-1][0] > here:
                d, low, below = open_.pop()
                below.append(last)
                last = len(depth)
                for x in below:
                    parent[x] = last
                depth.append(d)
                parent.append(-1)
                left.append(low)
                right.append(rank)
            if here >= 0:
                if open_[-1][0] < here:
                    open_.append((here, left[last], [last]))
                else:
                    open_[-1][2].append(last)
        self.depth, self.parent, self.left, self.right, self.root = depth, parent, left, right, len(depth) - 1
        self._places(ranks)
        self._links(ranks)

    def _places(self, ranks: Ranks) -> None:
        """The leftmost place below each node, and the way down from a node by a unit."""
        self.first = list(self.order) + [ranks.n] * (len(self.depth) - ranks.n)
        self.down: dict[tuple[int, int], int] = {}
        for v in range(self.root):
            u, p = self.parent[v], self.first[v]
            if p < self.first[u]:
                self.first[u] = p
            self.down[u, self.units[p + self.depth[u]]] = v

    def _links(self, ranks: Ranks) -> None:
        """The suffix link of an inner node: the node of its string without the first unit."""
        inner = np.arange(ranks.n, self.root)
        self.link = {self.root: self.root}
        if not len(inner):
            return
        place, depth = np.array(self.first)[inner], np.array(self.depth)[inner]

        def names(at: np.ndarray, size: np.ndarray) -> list[tuple[int, int, int]]:
            k = np.frexp(size.astype(np.float64))[1] - 1
            a, b = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
            for level in np.unique(k).tolist():
                some = k == level
                a[some], b[some] = ranks.levels[level][at[some]], ranks.levels[level][at[some] + size[some] - (1 << level)]
            return list(zip(a.tolist(), b.tolist(), size.tolist(), strict=True))

        named = dict(zip(names(place, depth), inner.tolist(), strict=True))
        deep = depth > 1
        self.link |= dict.fromkeys(inner[~deep].tolist(), self.root)
        self.link |= zip(inner[deep].tolist(), map(named.__getitem__, names(place[deep] + 1, depth[deep] - 1)), strict=True)

    def marks(self, start: np.ndarray, period: np.ndarray) -> list[tuple[int, int]]:
        """(node, length) of the squares at their leftmost places: as far up from the leaf as it is the leftmost below."""
        leaf = np.empty(len(self.order), np.int64)
        leaf[self.order] = np.arange(len(self.order))
        out, by_start = [], np.lexsort((-period, start))
        place, v = -1, -1
        for i in by_start.tolist():
            p, size = int(start[i]), 2 * int(period[i])
            if p != place:
                place, v = p, int(leaf[p])
            while v >= 0 and self.depth[self.parent[v]] >= size:
                v = self.parent[v]
                if self.first[v] != p:
                    v = -1
            if v >= 0:
                out.append((v, size))
        return out

    def rotated(self, v: int, size: int) -> tuple[int, int] | None:
        """From a square, the mark of that without its first unit and with it at the end; None if it doesn't occur."""
        units, depth, place = self.units, self.depth, self.first[v]
        w = self.link[self.parent[v]]
        x = w
        while depth[x] < size - 1:
            x = self.down[x, units[place + 1 + depth[x]]]
        if depth[x] == size - 1:
            x = self.down.get((x, units[place]), -1)
            return None if x < 0 else (x, size)
        return (x, size) if units[self.first[x] + size - 1] == units[place] else None

    def vocabulary(self, marks: list[tuple[int, int]]) -> set[tuple[int, int]]:
        """All squares that occur, from those at marks, by walks along suffix links."""
        known = set(marks)
        for mark in marks:
            while (mark := self.rotated(*mark)) is not None and mark not in known:
                known.add(mark)
        return known


def runs(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all maximal stretches of at least twice their smallest period, by period and start."""
    none = np.zeros(0, np.int64)
    if len(units) < 2:
        return none, none, none
    units = np.append(units, units.max() + 1)  # an end that occurs once, so that each suffix has a leaf
    ranks = Ranks(units)
    start, period = covering(ranks)
    if not len(start):
        return none, none, none
    tree = Tree(units, ranks)
    found = np.array(sorted(tree.vocabulary(tree.marks(start, period))), np.int64)
    low, high = np.array(tree.left)[found[:, 0]], np.array(tree.right)[found[:, 0]] + 1
    many = high - low
    at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
    place, period = ranks.order[at], np.repeat(found[:, 1] // 2, many)
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    new = np.flatnonzero(np.concatenate([[True], (period[1:] != period[:-1]) | (place[1:] != place[:-1] + 1)]))
    length = np.diff(np.append(new, len(place))) - 1 + 2 * period[new]
    return place[new], length, period[new]


def crowded(text: np.ndarray, unit: np.ndarray, times: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, piece) of the words that may lie in a run of a block ``times`` times over: pieces of at least ``least``
    successive words of one text, in which each word occurs so often. text, unit: the text and the word at each index."""
    index, piece = np.arange(len(text)), text
    while len(index):
        _, which, n = np.unique(piece * (int(unit.max()) + 1) + unit[index], return_inverse=True, return_counts=True)
        stays = n[which] >= times
        index, piece, changed = index[stays], piece[stays], not stays.all()
        new = np.concatenate([[True], (index[1:] != index[:-1] + 1) | (piece[1:] != piece[:-1])]) if len(index) else np.zeros(0, bool)
        piece = np.cumsum(new) - 1
        if len(index):
            stays = np.bincount(piece)[piece] >= least
            index, piece, changed = index[stays], piece[stays], changed or not stays.all()
        if not changed:
            break
    return index, piece


def runs_of_texts(text: np.ndarray, unit: np.ndarray, exponent: int, least: int) -> tuple[np.ndarray, ...]:
    """(index of the first word, length, period) of the runs of at least ``exponent`` periods and ``least`` words."""
    index, piece = crowded(text, unit, exponent, least)
    if not len(index):
        return index, index, index
    last = np.append(np.flatnonzero(piece[1:] != piece[:-1]), len(piece) - 1)
    # After each piece a unit that occurs once.
    laid = np.insert(unit[index], last + 1, int(unit.max()) + 1 + np.arange(len(last)))
    of = np.insert(index, last + 1, -1)
    start, length, period = runs(laid)
    good = length >= np.maximum(exponent * period, least)
    return of[start[good]], length[good], period[good]


def _found(exponent: int, least: int) -> Callable:
    """Within a task: (doc_id, text) -> (doc_id, n_words, starts, lengths, periods, collapsed)."""

    def make():
        numbers: defaultdict = defaultdict(count().__next__)

        def solve(held: list[list[bytes]], out: tuple[list, ...]) -> None:
            size = np.array([len(w) for w in held], np.int64)
            begin = np.cumsum(size) - size
            unit = np.concatenate([np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in held])
            first, length, period = runs_of_texts(np.repeat(np.arange(len(held)), size), unit, exponent, least)
            whose = np.searchsorted(begin, first, side="right") - 1 if len(first) else first
            whose = whose.astype(np.int64)
            order = np.lexsort((period, first))
            each: dict[int, list] = defaultdict(list)
            for i in order.tolist():
                d = int(whose[i])
                each[d].append((int(first[i] - begin[d]), int(length[i]), int(period[i])))
            for d, words in enumerate(held):
                got = each.get(d, [])
                if got:
                    stays = np.ones(len(words), bool)
                    for s, n, p in got:
                        stays[s + p : s + n] = False
                    words = [words[i] for i in np.flatnonzero(stays).tolist()]
                for column, x in zip(out, (int(size[d]), *map(list, zip(*got, strict=True))) if got else (int(size[d]), [], [], []), strict=False):
                    column.append(x)
                out[4].append(b" ".join(words).decode("utf-8", "surrogatepass"))
            if len(numbers) > HELD:
                numbers.clear()

        def step(ids, texts):
            out, held, n = ([], [], [], [], []), [], 0
            for text in texts:
                held.append((text or "").encode("utf-8", "surrogatepass").split())
                n += len(held[-1])
                if n >= HELD:
                    solve(held, out)
                    held, n = [], 0
            if held:
                solve(held, out)
            return ids, *out

        return step

    return make


def find_runs(docs: DataFrame, exponent: int = 4, least: int = 6) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, starts, lengths, periods (of the runs, by start and period), collapsed.

    Words are [^\\x20\\x09-\\x0D]+, numbered from 0; a null or empty text has none. A run is a maximal stretch of words
    with a smallest period, of at least ``exponent`` (2 or more) periods and ``least`` words. collapsed is the text without
    the words that lie in a run after its first period, joined by one space. Each row is a document of its own, whatever
    its doc_id; other columns take no part.
    """
    if exponent < 2:
        raise ValueError("a run has at least two periods")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.map_batches(rows, _found(exponent, least), "doc_id long, n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed string")


def repeating(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in which every tenth document goes on in a block of its own words: with h the crc32 of the
    decimal doc_id, g = floor(h / 10) and n words, where h % 10 = 0 and n > 0 each word i >= a becomes word a + (i - a) % p, a =
    g % n, p = 1 + floor((n - a) / (3 + g % 8)). Words of such a text are joined by one space. A row without doc_id stays."""

    def make():
        def one(doc, text):
            if doc is None or not text or (h := zlib.crc32(str(doc).encode())) % 10:
                return text
            words, g = text.encode("utf-8", "surrogatepass").split(), h // 10
            if not words:
                return text
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            block = words[a : a + p]
            whole = words[:a] + block * ((len(words) - a) // p) + block[: (len(words) - a) % p]
            return b" ".join(whole).decode("utf-8", "surrogatepass")

        return lambda ids, texts: (ids, [one(d, t) for d, t in zip(ids, texts, strict=True)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.map_batches(rows, make, "doc_id long, text string")


def _stronger(a: Column, b: Column) -> Column:
    """Whether run a has more periods than run b; of equals the earlier start, then the shorter period."""
    x, y = a["length"] * b["period"], b["length"] * a["period"]
    return (x > y) | ((x == y) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))))


def digested(found: DataFrame) -> DataFrame:
    """find_runs' rows -> doc_id, n_runs, the strongest run (start, length, period, exponent_milli; nulls for none),
    runs_sha256 of the lines start,length,period and collapsed_sha256."""
    run = F.transform(F.sequence(F.lit(0), F.size("starts") - 1), lambda i: F.struct(F.get("starts", i).alias("start"), F.get("lengths", i).alias("length"), F.get("periods", i).alias("period")))
    rows = found.withColumn("run", F.when(F.size("starts") > 0, run))
    line = F.transform("run", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.when(F.size("starts") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    rows = rows.withColumn("best", F.when(F.size("starts") > 0, F.aggregate("run", F.get("run", F.lit(0)), lambda held, r: F.when(_stronger(r, held), r).otherwise(held))))
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    return rows.select("doc_id", F.size("starts").cast("long").alias("n_runs"), *best, F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
