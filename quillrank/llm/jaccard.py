"""Near-duplicate groups by an n-gram Jaccard join with token-combination prefixes.

A document is the set of its shingles' hashes; equal sets are one node. Two nodes link when their Jaccard
similarity reaches ``percent``. Shingles are put in one order everywhere: rare ones by hash, then the corpus's
frequent ones by frequency. Linked sets of o or more common shingles share at least two in the first
size - o + 2 of each, the extended prefix; so they share a rare shingle there, which is indexed singly, or two
frequent ones, which are indexed as a pair. A set with many frequent shingles in its prefix, as in a large group
of near copies, would have too many pairs; it indexes them singly, and the others probe those entries.

An entry also says how large a partner may be: what stands before its place in a set is not common to both, and a pair's
size is bounded by what can be common. Partners are looked for among entries of one key and of fitting classes of size.
Parity bitmaps then bound the symmetric difference of two sets from below, before whole sets are compared.

Only components are asked for, so candidates are verified in two rounds. First each node against the one hub that it
shares most keys with; a key's hub is its most typical node. Then, of each key, nodes outside the component that most of
its nodes have by now against the others, unless both were compared with the same hub and the triangle inequality of
Jaccard distances rules a link out. So a group of copies is never paired with itself.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, spans

#: Keys of an index entry: a rare shingle; a frequent shingle of a set with few; of one with many; a pair.
RARE, FEW, MANY, PAIR = range(4)
#: A set with more frequent shingles than this in its prefix has no pairs.
FEW_MOST = 6


#: Least bits of a parity bitmap.
BITS = 512


def shingler(n: int):
    """Within a task: text -> sorted distinct hashes of the n-word shingles in A-Z lower-cased text; of the whole if it has
    fewer words."""
    words = spans.by_words(lower=True)

    def of_text(text: str | None) -> np.ndarray:
        seq = words(text)
        if not seq.n:
            return np.zeros(0, np.uint64)
        if seq.n < n:
            return spans.both(seq.grams(0, 1, seq.n), np.full(1, seq.n, np.uint64))
        found = [seq.grams(a, b, n) for a, b in seq.chunks(n)]
        s = np.sort(found[0] if len(found) == 1 else np.concatenate(found))
        return s[np.concatenate([[True], s[1:] != s[:-1]])]

    return of_text


def parity(s: np.ndarray) -> bytes:
    """A bitmap of twice to four times as many bits as s has elements: each bit is the parity of how many fall on it, so that
    two bitmaps of one length differ in at most as many bits as the sets do in elements. A half of one xor the other is
    the bitmap of half the length."""
    n = max(BITS, 1 << (2 * len(s) - 1).bit_length())
    flips = np.bincount((s >> np.uint64(32)).astype(np.int64) & (n - 1), minlength=n) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the elements that only one of two sets has."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def node_of(s: np.ndarray) -> int:
    """A set's number: 63 bits of a hash of it."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) >> 1


def _sets(n: int, least: int):
    """Rows of two kinds: (row, size, node, bitmap) of each text, and counts (token, n) of shingles that a task sees in
    ``least`` different sets."""
    columns = 4

    def make():
        of_text = shingler(n)
        seen: set[int] = set()

        def counted(tokens):
            values, counts = np.unique(tokens, return_counts=True)
            often = counts >= least
            return values[often].view(np.int64), counts[often].astype(np.int64)

        got = common.Collector(counted, 2_000_000)

        def out(rows, force):
            extra = got.out(force)
            k = len(extra[0]) if extra else 0
            if not rows and not k:
                return None
            filled = [list(c) + [None] * k for c in (zip(*rows) if rows else [[]] * columns)]
            return [*filled, [None] * len(rows) + (extra[0].tolist() if k else []), [None] * len(rows) + (extra[1].tolist() if k else [])]

        def step(numbers, texts):
            rows = []
            for i, t in zip(numbers, texts, strict=True):
                s = of_text(t)
                node = node_of(s) if len(s) else None
                rows.append((i, len(s), node, parity(s) if len(s) else None))
                if node is not None and node not in seen:
                    seen.add(node)
                    got.add(s)
            if len(seen) > 100_000:
                seen.clear()
            return out(rows, False)

        step.rest = lambda: out([], True)
        return step

    return make


_SETS = "row long, size int, node long, bits binary, token long, n long"


def frequent(sets: DataFrame, most: int = 1 << 17, least: int = 64) -> np.ndarray:
    """The most frequent shingles over all documents, rarest first: at most ``most``, each in ``least`` documents. A
    shingle that a task sees in fewer than three documents adds nothing. The list only orders shingles; results
    don't depend on it."""
    counted = sets.where("token is not null").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.array([token for token, _ in common.most_frequent(counted, most)], np.int64).view(np.uint64)[::-1]


def entries(s: np.ndarray, percent: int, heavy: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, kind, size of the largest partner) of a set's index entries. heavy: frequent shingles, sorted; rank: their
    order. Entries that no partner can be large enough for are left out."""
    size = len(s)
    need = -(-percent * size // 100)
    if 100 * size < percent * (size + 1):  # not even a set with one more shingle is near enough
        return np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, np.int32)
    prefix = min(size, size - need + 2)
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
        is_heavy = heavy[at] == s
        light = s[~is_heavy][:prefix]
        often = s[is_heavy][np.argsort(rank[at[is_heavy]])][: prefix - len(light)]
    else:
        light, often = s[:prefix], s[:0]
    # What may be common when the first common shingle is this one, or the first two are these.
    keys, kinds, room = [light], [np.full(len(light), RARE, np.int8)], [size - np.arange(len(light))]
    single = len(often) > FEW_MOST or need < 2  # of one common shingle no pair can be made
    if len(often):
        place = len(light) + np.arange(len(often))
        keys.append(spans.mix(often ^ np.uint64(0xA5A5A5A5)))
        kinds.append(np.full(len(often), MANY if single else FEW, np.int8))
        room.append(size - place)
        if len(often) >= 2 and not single:
            i, j = np.triu_indices(len(often), 1)
            a, b = np.minimum(often[i], often[j]), np.maximum(often[i], often[j])
            keys.append(spans.mix(a * np.uint64(0x9E3779B97F4A7C15) + b))
            kinds.append(np.full(len(i), PAIR, np.int8))
            room.append(size - place[j] + 1)
    most = np.minimum(np.concatenate(room) * (100 + percent) // percent - size, 100 * size // percent)
    fit = most >= need
    return np.concatenate(keys)[fit], np.concatenate(kinds)[fit], most[fit].astype(np.int32)


def _index(n: int, percent: int, shared, hot: int = 512):
    def flush(key, node, size, most, kind):
        # Repeated entries of one task go; a key with many nodes here is spread, and marked under itself.
        order = np.lexsort((-most, node, key))
        key, node, size, most, kind = (x[order] for x in (key, node, size, most, kind))
        keep = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
        key, node, size, most, kind = (x[keep] for x in (key, node, size, most, kind))
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        counts = np.diff(np.append(new, len(key)))
        spread = np.repeat(counts > hot, counts)
        salt = np.where(spread, spans.mix(node.view(np.uint64) + np.uint64(1)) & np.uint64(63), 0)
        route = np.where(spread, spans.mix(key + salt + np.uint64(1)), key)
        marks = key[new[counts > hot]]
        none = np.zeros(len(marks), np.int64)
        return [np.concatenate(x) for x in zip((route.view(np.int64), key.view(np.int64), node, size, most, kind), (marks.view(np.int64), marks.view(np.int64), none - 1, none.astype(np.int32), none.astype(np.int32), none.astype(np.int8)), strict=True)]

    def make():
        of_text = shingler(n)
        tokens = shared.value
        order = np.argsort(tokens)
        heavy, rank = tokens[order], order
        got = common.Collector(flush, 700_000)

        def step(texts):
            for t in texts:
                s = of_text(t)
                if len(s):
                    key, kind, most = entries(s, percent, heavy, rank)
                    got.add(key, np.full(len(key), node_of(s), np.int64), np.full(len(key), len(s), np.int32), most, kind)
            return got.out()

        step.rest = lambda: got.out(True)
        return step

    return make


def _groups():
    """Entries of keys that several nodes have."""

    def flush(route, key, node, size, most, kind):
        marked = np.unique(key[node < 0])
        real = np.flatnonzero(node >= 0)
        order = real[np.lexsort((node[real], kind[real] == FEW, key[real], route[real]))]
        route, key, node, size, most, kind = (x[order] for x in (route, key, node, size, most, kind))
        if not len(key):
            return None
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (route[1:] != route[:-1])]))
        counts = np.diff(np.append(new, len(key)))
        differs = np.add.reduceat(node != np.repeat(node[new], counts), new) > 0
        able = kind[new] != FEW  # the first of a part; else no node of it has many frequent shingles
        spread = route != key
        keep = np.repeat(differs & able, counts) | spread | np.isin(key, marked)
        return key[keep], node[keep], size[keep], most[keep], kind[keep]

    return lambda: common.by_key(flush, (np.int64, np.int64, np.int64, np.int32, np.int32, np.int8))


def _set_bytes(n: int):
    def make():
        text_of, of_text = spans.unpacker(), shingler(n)
        return lambda nodes, bodies: (nodes, [of_text(text_of(b)).tobytes() for b in bodies])

    return make


def _verify(percent: int):
    def make():
        last: list = [None, None]  # rows come sorted by b

        def step(a, b, set_a, set_b):
            distance, link = [], []
            for y, x, other in zip(b, set_a, set_b, strict=True):
                if last[0] != y:
                    last[:] = y, np.frombuffer(other, np.uint64)
                own, theirs = np.frombuffer(x, np.uint64), last[1]
                at = np.minimum(np.searchsorted(theirs, own), len(theirs) - 1)
                inter = int((theirs[at] == own).sum())
                union = len(own) + len(theirs) - inter
                distance.append(1 - inter / union)
                link.append(100 * inter >= percent * union)
            return a, b, distance, link

        return step

    return make


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) -> (a, b, distance, link), by whole sets."""
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
    both = with_a.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
    return common.map_batches(both.select("a", "b", "set_a", "set_b"), _verify(percent), "a long, b long, distance double, link boolean", rows=200)


def _plausible(percent: int):
    def step(a, b, size_a, size_b, bits_a, bits_b):
        keep = []
        for i, total in enumerate(map(int.__add__, size_a, size_b)):
            common_least = -(-total * percent // (100 + percent))
            if least_difference(bits_a[i], bits_b[i]) <= total - 2 * common_least:
                keep.append(i)
        return [a[i] for i in keep], [b[i] for i in keep]

    return lambda: step


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The (a, b) whose bitmaps don't rule a link out. nodes: (node, size, bits)."""
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("size").alias(f"size_{s}"), F.col("bits").alias(f"bits_{s}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    return common.map_batches(rows.select("a", "b", "size_a", "size_b", "bits_a", "bits_b"), _plausible(percent), "a long, b long", rows=1000)


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, component) of the nodes of links (a, b): the least node that each can reach. Labels spread along links
    and jump to their own labels, so rounds grow with the logarithm of the longest path. Hubs are spread."""
    both = common.saved(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-links")
    hubs = common.hot_values(both, "b")
    labels = common.saved(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")), f"{name}-labels")
    while True:
        near = common.spread_join(both, labels.select(F.col("a").alias("b"), F.col("c").alias("near")), "b", hubs).groupBy("a").agg(F.min("near").alias("near"))
        step = common.saved(labels.join(near, "a").select("a", F.least("c", "near").alias("n"), F.col("c").alias("old")), f"{name}-steps")
        jump = labels.select(F.col("a").alias("n"), F.col("c").alias("far"))
        jumped = common.spread_join(step, jump, "n", common.hot_values(step, "n"), "left")
        new = common.saved(jumped.select("a", F.least("n", F.coalesce("far", "n")).alias("c"), "old"), f"{name}-labels")
        labels = new.select("a", "c")
        if not new.where("c != old").limit(1).count():
            return labels.toDF("node", "component")


def near_groups(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included).

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z. Documents with equal sets, copies among them, are linked.
    A null text or one without words has an empty set and is linked with nothing. Repeated rows are documents of
    their own with one doc_id; a null doc_id is a component of its own, or takes the smallest one that it reaches.
    """
    rows = spans.numbered(docs)
    ids = common.saved(row_groups(rows, n, percent).join(rows.select("row", "doc_id"), "row"), "ids")
    least = ids.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return common.spread_join(ids, least, "group", common.hot_values(ids, "group"), "left").select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def row_groups(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """rows (row, doc_id, text) of spans.numbered -> row, size, group (the same for all rows that links reach; null for an
    empty set)."""
    spark = rows.sparkSession
    made = common.saved(common.map_batches(rows.select("row", "text"), _sets(n, 3), _SETS), "sets")
    sets = made.where("row is not null").drop("token", "n")
    first_rows = sets.where("node is not null").groupBy("node").agg(F.min("row").alias("row"))
    nodes = common.saved(first_rows.join(sets.drop("node"), "row"), "nodes")
    shared = spark.sparkContext.broadcast(frequent(made))  # at most 2**17 numbers
    index = common.map_batches(rows.select("text"), _index(n, percent, shared), "route long, key long, node long, size int, most int, kind byte")
    entry = "key long, node long, size int, most int, kind byte"
    groups = common.saved(common.map_batches(common.routed(index, "route"), _groups(), entry), "groups")
    groups = common.saved(groups.groupBy("key", "node", "size").agg(F.max("most").alias("most"), F.max("kind").alias("kind")), "entries")
    size = F.col("size")

    def ends(pairs: DataFrame) -> DataFrame:
        """The nodes of pairs, with the row of one document and the bitmap of each."""
        both = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        return both.join(nodes, "node")

    def bodies(pairs: DataFrame, name: str) -> DataFrame:
        """The sets of the nodes of pairs, from the text of one document of each."""
        wanted = common.saved(ends(pairs).select("row", "node"), "wanted")
        texts = spans.texts_of(rows, wanted).select("node", "body")
        return common.saved(common.map_batches(texts, _set_bytes(n), "node long, shingles binary"), name, compression="none")

    # The hub of a key is its most typical node: the one of whose shingles the greatest share is in other sets too, as in
    # the text that near copies come from. That copies are linked with it and not always with each other then doesn't
    # leave them apart.
    single = groups.where(F.col("kind") != PAIR)
    typical = single.groupBy("node", "size").agg((F.count("*") / size).alias("share"))
    hubs = single.join(typical.select("node", "share"), "node").groupBy("key").agg(F.max_by(F.struct(F.col("node").alias("hub"), F.col("size").alias("hub_size"), F.col("most").alias("hub_most")), F.struct("share", "node")).alias("h"))
    stars = single.join(hubs.select("key", "h.*"), "key").where((F.col("node") != F.col("hub")) & (F.col("hub_size") <= F.col("most")) & (size <= F.col("hub_most")))
    stars = stars.groupBy("node", "hub").agg(F.count("*").alias("n")).groupBy("node").agg(F.max_by("hub", F.struct("n", "hub")).alias("b")).withColumnRenamed("node", "a")
    stars = common.saved(stars, "stars")
    stars = common.saved(plausible(stars, ends(stars), percent), "stars")
    first = common.saved(compared(stars, bodies(stars, "bodies"), percent), "first")
    known = components(first.where("link"), "first")

    # Nodes that share a key across components.
    own = groups.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    own = own.join(first.select(F.col("a").alias("node"), F.col("b").alias("hub"), "distance"), "node", "left")
    own = common.saved(own.withColumn("hub", F.coalesce("hub", "node")).withColumn("distance", F.coalesce("distance", F.lit(0.0))), "open")
    held = own.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("kinds"), F.max_by("component", F.struct("n", "component")).alias("major"))
    own = own.join(held.where("kinds > 1").select("key", "major"), "key")
    side = lambda df, s: df.select("key", "class", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "size", "most", "kind", "component", "hub", "distance")), *([F.col("major")] if s == "x" else []))
    level = lambda c: F.floor(F.log(c.cast("double")) / math.log(1.03)).cast("int")
    x = side(own.where("component != major").withColumn("class", F.explode(F.sequence(level(F.ceil(size * percent / 100)), level(F.col("most"))))), "x")
    y = side(own.withColumn("class", level(size)), "y")
    fit = (F.col("size_y") <= F.col("most_x")) & (F.col("size_x") <= F.col("most_y")) & (F.col("component_x") != F.col("component_y"))
    once = (F.col("component_y") == F.col("major")) | (F.col("node_x") < F.col("node_y"))
    few = (F.col("kind_x") == FEW) & (F.col("kind_y") == FEW)
    apart = (F.col("hub_x") == F.col("hub_y")) & (F.abs(F.col("distance_x") - F.col("distance_y")) > 1 - percent / 100 + 1e-9)
    # A star that failed isn't compared again.
    again = (F.col("hub_x") == F.col("node_y")) | (F.col("hub_y") == F.col("node_x"))
    pairs = x.join(y, ["key", "class"]).where(fit & once & ~few & ~apart & ~again)
    pairs = common.saved(pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct(), "pairs")
    pairs = common.saved(plausible(pairs, ends(pairs), percent), "pairs")
    second = compared(pairs, bodies(pairs, "more-bodies"), percent).where("link")
    groups_of = components(first.where("link").select("a", "b").unionByName(second.select("a", "b")), "all")
    grouped = common.spread_join(sets.select("row", "size", "node"), groups_of, "node", common.hot_values(sets, "node"), "left")
    return grouped.select("row", "size", F.coalesce("component", "node").alias("group"))
