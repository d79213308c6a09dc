"""Suffix dedup over bytes by bucket-pointer refinement.

Suffixes are sampled at anchors (see ``spans``), so that every window of ``length`` bytes has exactly one, and are put into
buckets by the q-gram there: this is the shuffle. A bucket is refined by a hash of all that the windows at a suffix cover;
suffixes that are equal in it repeat each other in full and one of each kind goes on. A bucket with a single kind is settled
and goes no further.

The bytes at the suffixes of the other buckets meet once more, and there refinement is exact: positions are first put into
buckets by the eight bytes that start there, and a bucket of depth d is refined to depth 2d by sorting on the bucket
number d bytes later, which the round before has made for another suffix. Rounds end at ``length``; positions that are alone
in a bucket keep their number and aren't sorted again. Equal numbers then mean equal strings.

Where a bucket holds too many kinds to meet in one task, its windows meet by 128-bit hashes instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, spans
from .spans import CONTENT, FOUND, HOT


def refined(data: bytes, depth: int) -> np.ndarray:
    """For each position of data that has ``depth`` bytes from it: its bucket. Two are equal where the strings are."""
    n = len(data) - depth + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    have = min(8, depth)
    raw = np.ndarray((len(data) - have + 1,), "<u8", data + bytes(8), 0, (1,)) & np.uint64((1 << 8 * have) - 1)
    bucket = np.unique(raw, return_inverse=True)[1].astype(np.int64)
    while have < depth:
        later = min(have, depth - have)
        here = len(bucket) - later
        alone = np.bincount(bucket)[bucket[:here]] == 1
        live = np.flatnonzero(~alone)
        pair = bucket[live] * len(bucket) + bucket[live + later]
        kinds, number = np.unique(pair, return_inverse=True)
        new = np.empty(here, np.int64)
        new[live] = number
        new[alone] = np.arange(len(kinds), len(kinds) + int(alone.sum()))
        bucket, have = new, have + later
    return bucket[:n]


def same_windows(anchor, doc, pos, m, content, length: int, most: int = 1 << 19):
    """Which windows of runs with equal anchors are equal: (doc, pos, m) of those that are not alone. Runs come in order of
    anchor and are taken in parts of about ``most`` bytes."""
    size = m.astype(np.int64) + length - 1
    ends = np.cumsum(size)
    at = 0
    while at < len(anchor):
        end = max(int(np.searchsorted(ends, ends[at] - size[at] + most)), at + 1)
        end = int(np.searchsorted(anchor, anchor[end - 1], side="right"))  # whole anchors
        part = slice(at, end)
        bucket = refined(b"".join(content[at:end]), length)
        counts = m[part].astype(np.int64)
        begin = np.cumsum(size[part]) - size[part]
        step = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        own = bucket[np.repeat(begin, counts) + step]
        many = np.bincount(own)[own] > 1
        yield spans.joined(np.repeat(doc[part], counts)[many], (np.repeat(pos[part], counts) + step)[many], np.ones(int(many.sum()), np.int32))
        at = end


def _second_map(length: int, gram: int):
    """Candidates: the bytes that a run covers, one row a run; of hot anchors the windows."""

    def make():
        text_of, in_bytes = spans.unpacker(), spans.by_bytes(gram)()
        got = common.Collector(lambda *c: spans.set_aside(*c, False, 0))
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
                seq = in_bytes(text_of(body))
                if hot := [i for i in range(len(first)) if kind[i] == HOT]:
                    for a, b, pos in seq.windows(np.array([first[i] for i in hot], np.int64), np.array([count[i] for i in hot], np.int64), length):
                        got.add(a, b, np.full(len(pos), doc, np.int64), pos, np.ones(len(pos), np.int32))
                for f, c, a, k in zip(first, count, anchor, kind, strict=True):
                    if k != HOT:
                        held.append((a, a, 0, doc, f, c, False, CONTENT, seq.data[f : f + c + length - 1]))
            return out(False)

        step.rest = lambda: out(True)
        return step

    return make


def _second_meet(length: int):
    def flush(_, a, b, doc, pos, m, many, kind, content):
        plain, whole = kind != CONTENT, np.flatnonzero(kind == CONTENT)
        parts = [spans.met(*(x[plain] for x in (a, b, doc, pos, m, many, kind)), False)[:3]]
        whole = whole[np.argsort(a[whole], kind="stable")]
        parts += same_windows(a[whole], doc[whole], pos[whole], m[whole], content[whole].tolist(), length)
        d, p, n = (np.concatenate(c) for c in zip(*parts, strict=True))
        return d, p, n, np.full(len(d), FOUND, np.int8), np.zeros(len(d), np.int64), np.zeros(len(d), np.int64)

    return lambda: common.by_key(flush, (*spans._TYPES, object), weigh=8)


def repeated_strings(rows: DataFrame, length: int, gram: int, hot: int = 256) -> DataFrame:
    """rows (row, text) -> (doc, first, count): runs of the windows of each text that occur anywhere else."""
    unit = spans.by_bytes(gram)
    flags = spans.met_runs(rows, unit, length, gram, False, hot)
    windows = common.map_batches(spans.candidates(rows, flags), _second_map(length, gram), f"{spans.ROW}, content binary", rows=200)
    more = common.map_batches(common.routed(windows, "route").select(*spans.COLUMNS, "content"), _second_meet(length), spans.FLAG)
    found = flags.unionByName(more).where(F.col("kind") == FOUND)
    return found.groupBy("doc").agg(F.collect_list("pos").alias("first"), F.collect_list("m").alias("count"))


def _kept(length: int, gram: int, as_text: bool):
    def make():
        text_of, in_bytes = spans.unpacker(), spans.by_bytes(gram)()

        def step(bodies, firsts, counts):
            n, removed, pieces, kept_texts, digest = [], [], [], [], []
            for body, first, count in zip(bodies, firsts, counts, strict=True):
                seq = in_bytes(text_of(body))
                gone = seq.covered(*spans.runs_of(first, count), length)
                kept = np.frombuffer(seq.data, np.uint8)[~gone].tobytes() if gone.any() else seq.data
                n.append(seq.n)
                removed.append(int(gone.sum()))
                pieces.append(int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(gone) else 0)
                digest.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept.decode("utf-8", "ignore") if as_text else kept)
            return n, removed, pieces, kept_texts, digest

        return step

    return make


def dedup_bytes(docs: DataFrame, length: int = 200, gram: int = 50, carry: tuple[str, ...] = (), hot: int = 256, as_text: bool = False) -> DataFrame:
    """Removes each byte that a string of ``length`` bytes covers which also starts anywhere else, in the same document
    or another; matches never cross documents. docs (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept
    (bytes; a cut may fall within a character; with as_text a string, without what cuts have left of characters),
    kept_sha256 (of the bytes) and the columns named in ``carry``, which may have any other name; those of the result are
    an error there.

    A null text is empty; a text of fewer than ``length`` bytes stays. Repeated rows are documents of their own
    and so repeat each other.
    """
    taken = {"doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"}
    if clash := taken & {c.lower() for c in carry}:
        raise ValueError(f"columns of the result can't be carried: {sorted(clash)}")
    if not 0 < gram < length:
        raise ValueError("gram must be in 1..length-1")
    rows = spans.numbered(docs.select("doc_id", "text", *[F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)]), tuple(f"carried_{i}" for i in range(len(carry))))
    found = repeated_strings(rows, length, gram, hot).toDF("row", "first_of", "count_of")
    texts = spans.packed(rows).join(found, "row", "left")
    out = common.with_columns(texts, ["body", "first_of", "count_of"], _kept(length, gram, as_text), f"n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}, kept_sha256 string")
    return out.select("doc_id", *[F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)], "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")
