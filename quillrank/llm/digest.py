"""Quartile bucket digests of whole texts.

Six byte triplets from every window of five bytes are hashed into 128 buckets; each bucket's count becomes two
bits, by the quartiles of all counts. A digest is 68 hexadecimal digits: a check byte, the logarithm of the
length, the 32 bytes of quartiles. Its difference to another is 0 for equal digests and bounded by ``BOUND``.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

BUCKETS = 128
#: Differences are cut here; unrelated texts come near it.
BOUND = 300
_CHUNK = 1 << 20
_TABLES = np.random.default_rng(20).integers(0, BUCKETS, (3, 256), np.uint8)
#: Offsets back from the newest byte, and a salt for each of the six triplets.
_TRIPLETS = ((0, 1, 2, 2), (0, 1, 3, 3), (0, 2, 3, 5), (0, 2, 4, 7), (0, 1, 4, 11), (0, 3, 4, 13))


def bucket_counts(data: bytes) -> np.ndarray:
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(len(data) - 4, 0), _CHUNK):
        raw = np.frombuffer(data, np.uint8, min(_CHUNK + 4, len(data) - at), at)
        x, y, z = (t[raw] for t in _TABLES)
        n = len(raw) - 4
        counts += np.bincount(np.concatenate([x[4 - a : 4 - a + n] ^ y[4 - b : 4 - b + n] ^ z[4 - c : 4 - c + n] ^ np.uint8(salt) for a, b, c, salt in _TRIPLETS]), minlength=BUCKETS)
    return counts


def digest(text: str) -> str:
    data = text.encode("utf-8", "surrogatepass")
    counts = bucket_counts(data)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    level = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    code = (level.reshape(-1, 4) << np.array([6, 4, 2, 0], np.uint8)).sum(axis=1).astype(np.uint8)
    size = min(255, round(math.log(len(data) + 1) * 8))
    return f"{zlib.crc32(data) & 0xFF:02x}{size:02x}{code.tobytes().hex()}"


def difference(a: str, b: str) -> int:
    """0 (equal) to BOUND: differing check bytes count 1, a step of length 1, a step of a bucket's quartile 1 and
    three steps 6."""
    if a == b:
        return 0
    x, y = (np.frombuffer(bytes.fromhex(s), np.uint8) for s in (a, b))
    gap = abs(int(x[1]) - int(y[1]))
    levels = [(v[2:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3 for v in (x, y)]
    steps = np.abs(levels[0].astype(np.int64) - levels[1])
    return min(BOUND, int(x[0] != y[0]) + gap + int(np.where(steps == 3, 6, steps).sum()))


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b) / BOUND


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many of another text, or all that it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _row(doc, text: str, own: str, following: str, its: str) -> tuple:
    changed = edited(text, following)
    of_changed = digest(changed)
    return doc, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own, of_changed, likeness(own, of_changed), likeness(own, its)


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _neighbours():
    held: list = []  # the row before, which waits for the next one
    task = TaskContext.get().partitionId()

    def columns(rows: list[tuple]) -> list[list]:
        return [list(c) for c in zip(*rows)] if rows else None

    def step(docs, texts):
        rows = []
        for doc, text in zip(docs, texts, strict=True):
            text = text or ""
            own = digest(text)
            if held:
                d, t, o = held
                rows.append((*_row(d, t, o, text, own), None, None, None))
            else:
                rows.append((doc, None, None, own, None, None, None, "head", task, text))
            held[:] = doc, text, own
        return columns(rows)

    def rest():
        return columns([(held[0], None, None, held[2], None, None, None, "tail", task, held[1])]) if held else None

    step.rest = rest
    return step


def _last():
    def step(docs, texts, owns, followings, theirs):
        return [list(c) for c in zip(*[_row(*r) for r in zip(docs, texts, owns, followings, theirs, strict=True)])] or [[]] * 7

    return step


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Digests of docs (doc_id, text; a null text is empty) and of their edited texts, see ``edited``, with the next
    document in descending order of doc_id; null doc_ids come last, repeated ones in order of text, and after the
    last document comes the first. The texts move once, by ranges of doc_id; only the first and the last text of
    each range are looked at again.
    """
    spark = docs.sparkSession
    order = [F.desc_nulls_last("doc_id"), F.asc("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(parts or common.shuffle_parts(spark), order[0]).sortWithinPartitions(*order)
    made = common.saved(common.map_batches(dealt, _neighbours, f"{_OUT}, end string, task int, text string"), "digests")
    ends = made.where("end is not null").select("doc_id", "end", "task", "text", "fingerprint")
    # One head and one tail a task.
    heads = ends.where("end = 'head'").select(F.col("task").alias("t"), F.struct("text", "fingerprint").alias("next"))
    tails = ends.where("end = 'tail'")
    ring = Window.orderBy("t")
    heads = heads.withColumn("before", F.lag("t").over(ring)).withColumn("last", F.max("t").over(Window.partitionBy()))
    heads = heads.withColumn("task", F.coalesce("before", "last"))
    pairs = tails.join(heads.select("task", "next"), "task").select("doc_id", "text", "fingerprint", "next.text", F.col("next.fingerprint").alias("theirs"))
    return made.where("end is null").drop("end", "task", "text").unionByName(common.map_batches(pairs.toDF("doc_id", "text", "own", "following", "theirs"), _last, _OUT))
