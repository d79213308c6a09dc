"""Repeated windows of long sequences: partitioning on minimizers.

A document is a sequence of units (words or bytes), a window a fixed number of successive units. Every window has
an anchor: its gram of smallest hash, leftmost among equals, which depends on nothing but the window's content.
Successive windows with one anchor form a run, so equal windows always lie in runs with equal anchors. A run is named by
its anchor's hash and by a second hash, of other unit hashes, of all that its windows cover. Runs meet by anchor. Equal
runs repeat each other in full; a run that shares its anchor with a different one may share some windows with it and
becomes a candidate, which ``substring`` and ``suffix`` settle each in its own way.

Whatever one task knows to repeat is set aside before the shuffle, so a key never has more rows than there are
tasks; an anchor that has many different runs in one task is marked, and its runs are candidates without meeting.

Unit hashes are XXH3 of a word or the bytes themselves; they are combined by multiplication and mixing in turn at every
step, so that no arrangement of units makes hashes equal by algebra, as it does with polynomials modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common
from .tokens import Remembered

_R, _R2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_POS_BITS = np.uint64(20)
#: Units handled at once; a longer document is cut there into overlapping chunks.
CHUNK = 1 << 19
#: Words whose hashes a task remembers.
WORDS = 200_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """mix, in place."""
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def mix(x: np.ndarray) -> np.ndarray:
    return _mixed(x.copy())


def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in this order."""
    x = b >> np.uint64(29)
    x ^= b
    x *= _R2
    x += a * _R
    return _mixed(x)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` successive values."""
    n = len(x) - width + 1
    rows = np.full((-(-len(x) // width), width), ~np.uint64(0))
    rows.reshape(-1)[: len(x)] = x
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class Sequence:
    """One document of ``n`` units. A subclass has ``width``, the units of an atom, and gives the hashes of atoms."""

    n: int
    width: int

    def atoms(self, start: int, stop: int) -> np.ndarray:
        """First hashes of the atoms that start at units start..stop."""
        raise NotImplementedError

    def other(self, at: np.ndarray) -> np.ndarray:
        """Second hashes of the atoms at some units."""
        raise NotImplementedError

    def grams(self, start: int, stop: int, depth: int) -> np.ndarray:
        """Hashes of the strings of ``depth`` units that start at start..stop. Those of twice a depth come from two of
        it, the second at a later offset."""
        have = self.width
        out = self.atoms(start, stop + depth - have)
        while have < depth:
            later = min(have, depth - have)
            out = both(out[: len(out) - later], out[later:])
            have += later
        return out

    def seconds(self, at: np.ndarray, depth: int) -> np.ndarray:
        """Hashes of the strings of ``depth`` units at some places, by second hashes of atoms."""
        offsets = np.array(sorted({*range(0, depth - self.width, self.width), depth - self.width}))
        h = self.other(at + offsets[:, None])
        while len(h) > 1:  # neighbours are joined, an odd one goes on
            pairs = both(h[0 : len(h) - 1 : 2], h[1::2])
            h = np.concatenate([pairs, h[-1:]]) if len(h) % 2 else pairs
        return both(h[0], np.full(len(at), depth, np.uint64))

    def chunks(self, window: int):
        last = self.n - window + 1
        for a in range(0, max(last, 0), CHUNK):
            yield a, min(last, a + CHUNK)

    def runs(self, window: int, gram: int):
        """(anchor, content, first window, number of windows) of each run, as arrays."""
        for a, b in self.chunks(window):
            g = self.grams(a, b + window - gram, gram)
            keyed = (g >> _POS_BITS << _POS_BITS) | np.arange(len(g), dtype=np.uint64)
            least = sliding_min(keyed, window - gram + 1)
            first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
            end = np.append(first[1:], len(least))
            where = (least[first] & np.uint64((1 << 20) - 1)).astype(np.int64)
            # A run has fewer windows than a window has units, so its first and last one cover it.
            edges = self.seconds(np.concatenate([first, end - 1]) + a, window)
            content = both(edges[: len(first)], edges[len(first) :] + (end - first).astype(np.uint64))
            yield g[where], content, first + a, end - first

    def windows(self, first: np.ndarray, count: np.ndarray, window: int):
        """(hash, second hash, position) of the windows of some runs."""
        wanted = np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        for a, b in self.chunks(window):
            some = wanted[(wanted >= a) & (wanted < b)]
            if len(some):
                yield self.grams(a, b, window)[some - a], self.seconds(some, window), some

    def covered(self, first: np.ndarray, count: np.ndarray, window: int) -> np.ndarray:
        """Which units lie in a window of some runs."""
        edge = np.zeros(self.n + 1, np.int64)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + count + window - 1, -1)
        return np.cumsum(edge[:-1]) > 0


class Words(Sequence):
    """Words are [^\\x20\\x09-\\x0D]+. known: hashes of words, shared by the sequences of a task."""

    width = 1

    def __init__(self, data: bytes, known: dict):
        self.words = data.split()
        self.n = len(self.words)
        self.hashes = np.frombuffer(b"".join(map(known.__getitem__, self.words)), "<u8").reshape(-1, 2)

    def atoms(self, start: int, stop: int) -> np.ndarray:
        return self.hashes[start:stop, 0]

    def other(self, at: np.ndarray) -> np.ndarray:
        return self.hashes[at, 1]


class Bytes(Sequence):
    """Bytes; an atom is up to eight of them as they are, so it has no collisions."""

    def __init__(self, data: bytes, gram: int):
        self.data, self.n, self.width = data, len(data), min(8, gram)
        self.padded = data + bytes(8)

    def _raw(self, start: int, stop: int) -> np.ndarray:
        at = np.ndarray((max(stop - start, 0),), "<u8", self.padded, start, (1,))
        return at & np.uint64((1 << 8 * self.width) - 1)

    def atoms(self, start: int, stop: int) -> np.ndarray:
        return mix(self._raw(start, stop) ^ _R)

    def other(self, at: np.ndarray) -> np.ndarray:
        return np.ndarray((self.n + 1,), "<u8", self.padded, 0, (1,))[at] & np.uint64((1 << 8 * self.width) - 1)


def by_words(lower: bool = False) -> Callable[[str | None], Words]:
    """Within a task: text -> its words. lower: A-Z are lower-cased first."""
    known = Remembered(xxhash.xxh3_128_digest, WORDS)

    def of_text(text: str | None) -> Words:
        data = (text or "").encode("utf-8", "surrogatepass")
        return Words(data.lower() if lower else data, known)

    return of_text


def by_raw_words() -> Callable[[bytes], Words]:
    """The same for words that are bytes already."""
    known = Remembered(xxhash.xxh3_128_digest, WORDS)
    return lambda data: Words(data, known)


def by_bytes(gram: int) -> Callable[[], Callable[[str | None], Bytes]]:
    return lambda: lambda text: Bytes((text or "").encode("utf-8", "surrogatepass"), gram)


def packed(rows: DataFrame) -> DataFrame:
    """rows with body, the compressed text, in place of text: what has to be shuffled is less than half as long."""

    def make():
        import zstandard

        zip_one = zstandard.ZstdCompressor(level=1).compress
        return lambda texts: ([None if t is None else zip_one(t.encode("utf-8", "surrogatepass")) for t in texts],)

    return common.with_columns(rows, ["text"], make, "body binary").drop("text")


def unpacker():
    """Within a task: body -> text."""
    import zstandard

    unzip = zstandard.ZstdDecompressor().decompress
    return lambda body: body if body is None or isinstance(body, str) else unzip(body).decode("utf-8", "surrogatepass")


def texts_of(rows: DataFrame, wanted: DataFrame, most: int = 100_000) -> DataFrame:
    """rows (row, text) join wanted (row, one more number), a saved table, with body for text. Up to ``most`` wanted rows, a
    few megabytes, go to the texts, which then stay where they are; else the texts move, compressed."""
    if wanted.count() <= most:
        return rows.select("row", F.col("text").alias("body")).join(F.broadcast(wanted), "row")
    return packed(rows.select("row", "text")).join(wanted, "row")


#: What becomes of a row. When runs meet: KEY meets others by route; FOUND repeats for sure; MARK says that an anchor is
#: hot; HOT has a hot anchor and meets equal runs only; CONTENT is a run with what it covers. After it: FOUND; SOURCE, the
#: first of those that repeat it; CANDIDATE, or HOT if its anchor is.
KEY, FOUND, MARK, HOT, CANDIDATE, CONTENT, SOURCE = range(7)


def _grouped(a: np.ndarray, b: np.ndarray, doc: np.ndarray, pos: np.ndarray):
    """Order by (a, b, doc, pos), and for it: starts of groups of equal (a, b), group of each row."""
    order = np.lexsort((pos, doc, b, a))
    x, y = a[order], b[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.zeros(0, bool)
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def joined(doc: np.ndarray, pos: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that follow each other in one document become one."""
    if not len(doc):
        return doc, pos, m
    order = np.lexsort((pos, doc))
    doc, pos, m = doc[order], pos[order], m[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + m[:-1])]))
    return doc[new], pos[new], np.add.reduceat(m, new)


ROW = "route long, a long, b long, doc long, pos long, m int, many boolean, kind byte"
#: edge: the hash that names the run or window, where keep_first.
FLAG = "doc long, pos long, m int, kind byte, a long, edge long"


def set_aside(a, b, doc, pos, m, keep_first: bool, hot: int):
    """Within a task: columns of ROW. One row of each (a, b) goes on as KEY, with many = whether there were more; the
    others are FOUND, and without keep_first that one is FOUND too."""
    order, starts, group = _grouped(a, b, doc, pos)
    a, b, doc, pos, m = a[order], b[order], doc[order], pos[order], m[order]
    many = np.diff(np.append(starts, len(a))) > 1
    # The later of equal coordinates isn't earlier than itself: a repeated row of one document.
    found = many[group]
    if keep_first:
        found = found & ((doc != doc[starts][group]) | (pos != pos[starts][group]))
    kind = np.full(len(starts), KEY, np.int8)
    route = a[starts].copy()
    marks = np.zeros(0, np.uint64)
    if hot and len(starts):
        anchor_new = np.concatenate([[True], a[starts][1:] != a[starts][:-1]])
        kinds = np.diff(np.append(np.flatnonzero(anchor_new), len(starts)))
        is_hot = (kinds > hot)[np.cumsum(anchor_new) - 1]
        kind[is_hot] = HOT
        route[is_hot] = b[starts][is_hot]
        marks = a[starts][anchor_new][kinds > hot]
    if keep_first:  # they keep their names
        f_a, f_b, f_doc, f_pos, f_m = a[found], b[found], doc[found], pos[found], m[found]
    else:
        f_doc, f_pos, f_m = joined(doc[found], pos[found], m[found])
        f_a = f_b = np.zeros(len(f_doc), np.uint64)
    zero = np.zeros(len(marks), np.int64)
    parts = [
        (route, a[starts], b[starts], doc[starts], pos[starts], m[starts], many, kind),
        (mix(f_doc.astype(np.uint64)), f_a, f_b, f_doc, f_pos, f_m, np.ones(len(f_doc), bool), np.full(len(f_doc), FOUND, np.int8)),
        (marks, marks, marks, zero, zero, zero, np.zeros(len(marks), bool), np.full(len(marks), MARK, np.int8)),
    ]
    return [common.signed(np.concatenate(c)) for c in zip(*parts, strict=True)]


def first_map(unit: Callable, window: int, gram: int, keep_first: bool, hot: int):
    """Runs of texts, for common.map_batches: (doc, text) -> ROW."""

    def make():
        of_text = unit()
        got = common.Collector(lambda *c: set_aside(*c, keep_first, hot))

        def step(docs, texts):
            for doc, text in zip(docs, texts, strict=True):
                for anchor, content, first, m in of_text(text).runs(window, gram):
                    got.add(anchor, content, np.full(len(first), doc, np.int64), first, m.astype(np.int32))
            return got.out()

        step.rest = lambda: got.out(True)
        return step

    return make


def met(a, b, doc, pos, m, many, kind, keep_first: bool):
    """What repeats, and which runs are candidates: columns of FLAG for whole routes."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    marked = np.unique(a[kind == MARK])
    k = np.flatnonzero((kind == KEY) | (kind == HOT))
    order, starts, group = _grouped(a[k], b[k], doc[k], pos[k])
    k = k[order]
    size = np.diff(np.append(starts, len(k)))
    source = np.zeros(0, np.int64)
    if keep_first:
        found = (doc[k] != doc[k[starts]][group]) | (pos[k] != pos[k[starts]][group])
        if len(starts):
            source = k[starts[np.logical_or.reduceat(found | many[k], starts)]]
    else:
        found = (size > 1)[group] & ~many[k]  # many: its task has said so already
    lead = k[starts]
    new = np.concatenate([[True], a[lead][1:] != a[lead][:-1]]) if len(lead) else np.zeros(0, bool)
    kinds = np.diff(np.append(np.flatnonzero(new), len(lead)))
    is_hot = (kind[lead] == HOT) | np.isin(a[lead], marked)
    shared = (kinds > 1)[np.cumsum(new) - 1] | is_hot if len(lead) else new
    pick = lead[shared]
    label = np.where(is_hot[shared], HOT, CANDIDATE).astype(np.int8)
    again = np.concatenate([np.flatnonzero(kind == FOUND), k[found]])
    if keep_first:
        at = np.concatenate([again, source, pick])
        kinds_out = np.concatenate([np.full(len(again), FOUND, np.int8), np.full(len(source), SOURCE, np.int8), label])
        return doc[at], pos[at], m[at], kinds_out, common.signed(a[at]), common.signed(both(a[at], b[at]))
    f_doc, f_pos, f_m = joined(doc[again], pos[again], m[again])
    n = np.zeros(len(f_doc), np.int64)
    return np.concatenate([f_doc, doc[pick]]), np.concatenate([f_pos, pos[pick]]), np.concatenate([f_m, m[pick]]), np.concatenate([np.full(len(f_doc), FOUND, np.int8), label]), np.concatenate([n, common.signed(a[pick])]), np.zeros(len(n) + len(pick), np.int64)


_TYPES = (np.int64, np.int64, np.int64, np.int64, np.int64, np.int32, bool, np.int8)
COLUMNS = ["route", "a", "b", "doc", "pos", "m", "many", "kind"]


def meet(keep_first: bool):
    """For rows of ROW, sorted by route."""
    return lambda: common.by_key(lambda _, *c: met(*c, keep_first), _TYPES)


def numbered(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(row, doc_id, text, carried columns): row is doc_id where doc_ids are unique and not null, else a number in the order of
    (doc_id, text), nulls first, so that repeated rows are documents of their own."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    odd = rows.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count()
    if not odd:
        return rows.select(F.col("doc_id").alias("row"), *rows.columns)
    pairs = rows.sort("doc_id", "text").rdd.zipWithIndex().map(lambda x: (x[1], *x[0]))
    kind = StructType([StructField("row", LongType()), *rows.schema.fields])
    return common.saved(docs.sparkSession.createDataFrame(pairs, kind), "numbered")


def met_runs(rows: DataFrame, unit: Callable, window: int, gram: int, keep_first: bool, hot: int) -> DataFrame:
    """FLAG rows of the runs of rows (row, text) that repeat, that are repeated, or that are candidates, as a saved table."""
    runs = common.map_batches(rows.select("row", "text"), first_map(unit, window, gram, keep_first, hot), ROW)
    return common.saved(common.map_batches(common.routed(runs, "route").select(COLUMNS), meet(keep_first), FLAG), "runs")


def candidates(rows: DataFrame, flags: DataFrame) -> DataFrame:
    """(doc, body, first, count, anchor, hot): arrays of the candidate runs of each text."""
    each = {"pos": "first", "m": "count", "a": "anchor", "kind": "hot"}
    wanted = flags.where(F.col("kind").isin(CANDIDATE, HOT)).groupBy("doc").agg(*[F.collect_list(c).alias(n) for c, n in each.items()])
    return packed(rows.select(F.col("row").alias("doc"), "text")).join(wanted, "doc").select("doc", "body", *each.values())


def runs_of(first, count) -> tuple[np.ndarray, np.ndarray]:
    return np.array(first or [], np.int64), np.array(count or [], np.int64)
