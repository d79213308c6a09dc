"""Passages of a benchmark in documents, by a prefix-filtered join of shingle sets.

Each window of an item's words has the shingles (short word strings) at its offsets. A document contains a window at some place
if enough of them stand at the same offsets from there. Shingles are ordered by how often all documents have them, and
of each window the rarest few are its prefix: as many that one at least must be there. Documents meet windows by prefix
shingles alone; the offset of the shingle says where the window would start (positional bound), and it has to end within
the document (length bound). What is left is verified at every offset and then, where all must agree, word by word.

Items are a stated set and taken in blocks of bounded size; each block is broadcast and all documents pass it where they are,
so that no text is shuffled and no key gathers rows. More blocks mean more passes, whose finds are joined by row.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import pairwise

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, spans
from .tokens import Remembered

#: Pairs of a window and an item in a block: some 15 megabytes.
BLOCK = 1 << 17
#: Words of documents handled at once, but for a longer document.
HELD = 200_000
#: Pairs of a place and a window that are verified at once.
PAIRS = 500_000
_BITS = 22
#: A-Z become a-z; what is neither a digit, a letter nor beyond ASCII separates words.
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def hasher() -> Callable[[list[bytes]], np.ndarray]:
    """Within a task: words -> their hashes, which it remembers; of long words it doesn't."""
    known = Remembered(xxhash.xxh3_64_digest, spans.WORDS)
    one = lambda w: known[w] if len(w) <= 64 else xxhash.xxh3_64_digest(w)
    return lambda some: np.frombuffer(b"".join(map(one, some)), "<u8")


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the strings of ``size`` words."""
    n = max(len(hashes) - size + 1, 0)
    out = spans.mix(hashes[:n] ^ np.uint64(size))
    for i in range(1, size):
        out = spans.both(out, hashes[i : i + n])
    return out


def windows(items: DataFrame, window: int) -> DataFrame:
    """items (item_id, text) -> (words, item): each window of an item once. An item of fewer words than ``window``, but not
    none, is one window. Items without an id have windows, with a null item."""

    def make():
        def step(ids, texts):
            found, of = [], []
            for item, text in zip(ids, texts, strict=True):
                w = words(text)
                some = {b" ".join(w[i : i + window]) for i in range(max(1, len(w) - window + 1))} - {b""}
                found += some
                of += [item] * len(some)
            return [x.decode("utf-8", "surrogatepass") for x in found], of

        return step

    rows = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return common.map_batches(rows, make, "words string, item string", rows=200).distinct()


class Block:
    """Some windows with their items, and what finds them: for each size of shingles the prefix shingles' keys, with the
    windows and offsets at which each stands."""

    def __init__(self, texts: list[bytes], items: list[str | None], shingle: int, share: float):
        self.share = share
        number = {t: i for i, t in enumerate(dict.fromkeys(texts))}
        self.texts = list(number)
        self.items: list[list[str]] = [[] for _ in number]
        for t, item in zip(texts, items, strict=True):
            if item is not None:
                self.items[number[t]].append(item)
        split, hashed = [t.split() for t in self.texts], hasher()
        self.length = np.array([len(w) for w in split], np.int64)
        size = np.minimum(self.length, shingle)
        self.offsets = self.length - size + 1
        self.need = np.array([math.ceil(share * m - 1e-9) for m in self.offsets.tolist()], np.int64).clip(1)
        self.grams = np.zeros((len(split), int(self.offsets.max(initial=1))), np.uint64)
        for i, w in enumerate(split):
            self.grams[i, : self.offsets[i]] = grams(hashed(w), int(size[i]))
        self.sizes = {k: np.flatnonzero(size == k) for k in np.unique(size).tolist()}
        self.index: dict[int, tuple] = {}

    def keys(self) -> dict[int, np.ndarray]:
        """The distinct shingles of each size."""
        return {k: np.unique(self.grams[some][np.arange(self.grams.shape[1]) < self.offsets[some][:, None]]) for k, some in self.sizes.items()}

    def order(self, counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """Chooses the prefixes. counts: for each size of shingles keys, ascending, and how often documents have them."""
        for k, some in self.sizes.items():
            keys, n = counts[k]
            there = np.arange(self.grams.shape[1]) < self.offsets[some][:, None]
            often = np.zeros(there.shape, np.int64)
            if len(keys):
                at = np.searchsorted(keys, self.grams[some]).clip(max=len(keys) - 1)
                often = np.where(keys[at] == self.grams[some], n[at], 0)
            often[~there] = np.iinfo(np.int64).max
            rarest = np.lexsort((self.grams[some], often), axis=1)  # by count, then by shingle
            row, nth = np.nonzero(np.arange(there.shape[1]) < (self.offsets[some] - self.need[some] + 1)[:, None])
            offset = rarest[row, nth]
            key = self.grams[some][row, offset]
            by_key = np.argsort(key, kind="stable")
            distinct, first = np.unique(key[by_key], return_index=True)
            self.index[k] = (distinct, np.append(first, len(key)), some[row[by_key]], offset[by_key])


def _bits(keys: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << _BITS, bool)
    table[keys >> np.uint64(64 - _BITS)] = True
    return table


def _present(g: np.ndarray, keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in g, numbers among keys) of the hashes that are keys."""
    at = np.flatnonzero(table[g >> np.uint64(64 - _BITS)])
    which = np.searchsorted(keys, g[at]).clip(max=len(keys) - 1)
    good = keys[which] == g[at] if len(keys) else np.zeros(0, bool)
    return at[good], which[good]


def batches(texts: list[str | None]):
    """Texts as lists of words, together HELD words or a little more."""
    held, n = [], 0
    for text in texts:
        held.append(words(text))
        n += len(held[-1])
        if n >= HELD:
            yield held
            held, n = [], 0
    if held:
        yield held


def _laid(held: list[list[bytes]], k: int, hashes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of shingles at each place; those that go beyond their document are made 0."""
    g = np.zeros(len(hashes), np.uint64)
    whole = grams(hashes, k)
    g[: len(whole)] = whole
    g[np.arange(len(g)) + k > end] = 0
    return g


def counts(docs: DataFrame, block: Block) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """How often the shingles of a block occur in all documents, for Block.order. There are at most as many as the block's."""
    keys = block.keys()
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def make():
        hashed, mine = hasher(), shared.value
        tables = {k: _bits(x) for k, x in mine.items()}
        sums = {k: np.zeros(len(x), np.int64) for k, x in mine.items()}

        def step(texts):
            for held in batches(texts):
                size = np.array([len(w) for w in held], np.int64)
                h = hashed([x for w in held for x in w])
                end = np.repeat(np.cumsum(size), size)
                for k, x in mine.items():
                    _, which = _present(_laid(held, k, h, end), x, tables[k])
                    sums[k] += np.bincount(which, minlength=len(x))

        def rest():
            some = [(np.full(int((s > 0).sum()), k, np.int32), np.flatnonzero(s), s[s > 0]) for k, s in sums.items()]
            return [np.concatenate(c) for c in zip(*some, strict=True)] if some else None

        step.rest = rest
        return step

    found = common.map_batches(docs.select("text"), make, "size int, number long, n long").groupBy("size", "number").agg(F.sum("n").alias("n")).toArrow()
    size, number, n = (found.column(c).to_numpy() for c in ("size", "number", "n"))
    out = {}
    for k, x in keys.items():
        sums = np.zeros(len(x), np.int64)
        sums[number[size == k]] = n[size == k]
        out[k] = (x, sums)
    shared.unpersist()
    return out


def matches(block: Block, held: list[list[bytes]], hashed: Callable, tables: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(place among all words of held, window) of the windows that documents contain."""
    size = np.array([len(w) for w in held], np.int64)
    flat = [x for w in held for x in w]
    ends = np.cumsum(size)
    begin, end = np.repeat(ends - size, size), np.repeat(ends, size)
    h = hashed(flat)
    out = []
    for k, (keys, first, window, offset) in block.index.items():
        g = _laid(held, k, h, end)
        at, which = _present(g, keys, tables[k])
        many = first[which + 1] - first[which]
        parts = [*np.searchsorted(np.cumsum(many), np.arange(0, int(many.sum()), PAIRS) + 1).tolist(), len(at)]
        for a, b in pairwise(parts):
            some = many[a:b]
            entry = np.repeat(first[which[a:b]] - np.cumsum(some) + some, some) + np.arange(int(some.sum()))
            w = window[entry]
            place = np.repeat(at[a:b], some)
            start = place - offset[entry]
            good = (start >= begin[place]) & (start + block.length[w] <= end[place])  # positional and length bounds
            pair = np.unique(start[good] * len(block.texts) + w[good])
            start, w = pair // len(block.texts), pair % len(block.texts)
            across = np.arange(block.grams.shape[1])
            here = g[np.minimum(start[:, None] + across, len(g) - 1)] == block.grams[w]
            here &= across < block.offsets[w][:, None]
            good = here.sum(axis=1) >= block.need[w]
            out.append((start[good], w[good]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, w = (np.concatenate(c) for c in zip(*out, strict=True))
    if block.share == 1:
        exact = [b" ".join(flat[s : s + n]) == block.texts[i] for s, n, i in zip(start.tolist(), block.length[w].tolist(), w.tolist(), strict=True)]
        start, w = start[exact], w[exact]
    return start, w


def merged(starts: np.ndarray, lengths: np.ndarray) -> tuple[list[int], list[int]]:
    """Overlapping and adjoining stretches become one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate((starts + lengths)[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]])) if len(starts) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(starts))[: len(new)] - 1
    return starts[new].tolist(), (ends[last] - starts[new]).tolist()


def _matched(shared) -> Callable:
    """Within a task: (row, doc_id, text) -> (row, doc_id, n_words, starts, lengths, items)."""

    def make():
        block, hashed = shared.value, hasher()
        tables = {k: _bits(x[0]) for k, x in block.index.items()}

        def step(rows, ids, texts):
            out = ([], [], [], [])
            for held in batches(texts):
                start, w = matches(block, held, hashed, tables)
                size = np.array([len(x) for x in held], np.int64)
                begin = np.cumsum(size) - size
                whose = np.searchsorted(begin + size, start, side="right")
                order = np.argsort(whose, kind="stable")
                start, w, whose = start[order], w[order], whose[order]
                cut = np.searchsorted(whose, np.arange(len(held) + 1))
                for d in range(len(held)):
                    a, b = cut[d], cut[d + 1]
                    found = w[a:b]
                    for column, x in zip(out, (int(size[d]), *(merged(start[a:b] - begin[d], block.length[found]) if b > a else ([], [])), sorted({i for x in set(found.tolist()) for i in block.items[x]})), strict=True):
                        column.append(x)
            return rows, ids, *out

        return step

    return make


def _joined():
    """Within a task: what several blocks found in one document -> (row, starts, lengths, items)."""

    def step(rows, starts, lengths, items):
        out = [merged(np.array([x for s in a for x in s], np.int64), np.array([x for s in b for x in s], np.int64)) for a, b in zip(starts, lengths, strict=True)]
        return rows, [a for a, _ in out], [b for _, b in out], [sorted({i for x in some for i in x}) for some in items]

    return step


FOUND = "row long, doc_id long, n_words long, starts array<long>, lengths array<long>, items array<string>"


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3, share: float = 1.0, block: int = BLOCK) -> DataFrame:
    """docs (doc_id, text) and items (item_id, text) -> doc_id, n_words, starts and lengths (of the stretches of words hit)
    and items (ids as strings, ascending) of every document.

    A-Z are lower-cased; words are runs of digits, letters and characters beyond ASCII. A window is ``window`` successive words
    of an item, or all of a shorter item that has any. Where a document has at least ``share`` of a window's shingles (of
    ``shingle`` words) at the window's offsets, the words there are hit; with share 1 it has the window word by word. A null or
    empty text has no words. Each row of docs is a document of its own; rows of one item_id are one item; an
    item without id hits words but isn't listed. Without items nothing is hit. Other columns take no part.
    """
    if not 0 < share <= 1:
        raise ValueError("share is over 0 and at most 1")
    spark = docs.sparkSession
    pairs = common.saved(windows(items, window), "windows")
    blocks = max(1, -(-pairs.count() // block))
    if blocks == 1:
        rows = docs.select(F.lit(0).cast("long").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    else:
        rows = spans.numbered(docs)
    found = []
    for b in range(blocks):
        got = pairs.where(F.pmod(F.xxhash64("words", "item"), F.lit(blocks)) == b).toArrow()
        some = Block([x.encode("utf-8", "surrogatepass") for x in got.column("words").to_pylist()], got.column("item").to_pylist(), shingle, share)
        some.order(counts(rows, some))
        all_rows = common.map_batches(rows, _matched(spark.sparkContext.broadcast(some)), FOUND)
        if blocks == 1:
            return all_rows.drop("row")
        found.append(common.saved(all_rows if b == 0 else all_rows.where("size(starts) > 0"), "matched"))
    each = reduce(DataFrame.unionByName, [x.where("size(starts) > 0").select("row", "starts", "lengths", "items") for x in found])
    grouped = each.groupBy("row").agg(*[F.collect_list(c).alias(c) for c in ("starts", "lengths", "items")])
    hit = common.map_batches(grouped, _joined, "row long, starts array<long>, lengths array<long>, items array<string>")
    empty = {"starts": "array<long>", "lengths": "array<long>", "items": "array<string>"}
    return found[0].select("row", "doc_id", "n_words").join(hit, "row", "left").select("doc_id", "n_words", *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in empty.items()])


def digested(found: DataFrame) -> DataFrame:
    """contamination's rows -> doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"))
