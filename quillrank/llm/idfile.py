"""Token-id files: Simple-8b words with escapes, block offsets and a document table.

An image is one self-contained file body:

    magic "QS8B", version, number of documents, ids, blocks, ids of a block
    document ids (int64) and their numbers of ids (uint64)
    first word of each block (uint64, one more than blocks), words (uint64)

A word has a 4-bit selector and 60 bits of ids. Selectors 1 to 14 pack 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3,
2 or 1 ids of 60 // count bits each; selector 0 says that the next word is one id of more than 60 bits, plain.
Blocks start at a word of their own, so any block is decoded without the ones before it.

``write_ids`` stores images as rows of a Parquet table, through Spark's committer, so that a lost executor
leaves no half file and any store works; ``export_images`` writes the same bytes as plain files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

#: Fixed values of the format: ids in a word by selector (0: escape).
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([64, *(60 // c for c in COUNTS[1:])], np.int64)
MAGIC, VERSION = b"QS8B", 1
_HEAD = struct.Struct("<4sIQQQQ")
#: Document id that stands for null.
NULL_ID = -(1 << 63)


def pack(ids: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """ids (any unsigned integers below 2**64) -> (words, first word of each block and the end)."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint64)
    rows = -(-n // block)
    # Bits of each id, padded so that every block is a row; what lies past its end never fits.
    need = np.full((rows, block + 60), 99, np.uint8)
    wide = np.zeros(rows * block, np.uint8)
    wide[:n] = np.maximum(1, np.where(ids < (1 << 52), np.frexp((ids & np.uint64((1 << 52) - 1)).astype(np.float64))[1], 0))
    for i in np.flatnonzero(ids >= np.uint64(1 << 52)):
        wide[i] = int(ids[i]).bit_length()
    wide[n:] = 99
    need[:, :block] = wide.reshape(rows, block)
    choice = np.zeros((rows, block), np.uint8)  # the escape, where nothing fits
    most, width = need.copy(), 1  # the largest need among the next `width` ids
    for s in range(len(COUNTS) - 1, 0, -1):
        c = int(COUNTS[s])
        while width < c:
            step = min(width, c - width)
            most[:, : most.shape[1] - step] = np.maximum(most[:, : most.shape[1] - step], most[:, step:])
            width += step
        choice[most[:, :block] <= BITS[s]] = s
    # All blocks step from word to word together.
    take = np.where(COUNTS > 0, COUNTS, 1)
    ends = np.minimum(block, n - np.arange(rows) * block)
    at, live, starts = np.zeros(rows, np.int64), np.arange(rows), []
    while len(live):
        p = at[live]
        starts.append(live * block + p)
        at[live] = p + take[choice[live, p]]
        live = live[at[live] < ends[live]]
    first = np.sort(np.concatenate(starts))
    sel = choice.reshape(-1)[first]
    size = np.where(sel == 0, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s in range(1, len(COUNTS)):
        rows_s = np.flatnonzero(sel == s)
        if len(rows_s):
            got = ids[first[rows_s, None] + np.arange(COUNTS[s])]
            shifts = (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)
            words[place[rows_s]] = np.bitwise_or.reduce(got << shifts, axis=1) | np.uint64(s << 60)
    out = np.flatnonzero(sel == 0)
    words[place[out] + 1] = ids[first[out]]
    return words, np.append(place[np.searchsorted(first, np.arange(rows) * block)], len(words)).astype(np.uint64)


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of whole blocks."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(sel == 0):
        if not raw[i]:
            raw[i + 1] = True
    sel[raw] = 15
    count = np.append(COUNTS, 1)[sel]
    end = np.cumsum(count)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint64)
    begin = end - count
    for s in range(1, len(COUNTS)):
        rows = np.flatnonzero(sel == s)
        if len(rows):
            shifts = (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)
            out[begin[rows, None] + np.arange(COUNTS[s])] = (words[rows, None] >> shifts) & np.uint64((1 << int(BITS[s])) - 1)
    out[begin[raw]] = words[raw]
    return out


def image(doc_ids: list[int], counts: list[int], ids: np.ndarray, block: int = 4096) -> bytes:
    words, offsets = pack(ids, block)
    head = _HEAD.pack(MAGIC, VERSION, len(doc_ids), len(ids), len(offsets) - 1, block)
    return b"".join([head, np.array(doc_ids, "<i8").tobytes(), np.array(counts, "<u8").tobytes(), offsets.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


class Image:
    """Reads an image; ids(first, count) decodes only the blocks that it needs."""

    def __init__(self, body: bytes):
        magic, version, docs, self.n, blocks, self.block = _HEAD.unpack_from(body)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token-id image of this version")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(body, "<i8", docs, at)
        self.counts = np.frombuffer(body, "<u8", docs, at + 8 * docs).astype(np.int64)
        self.offsets = np.frombuffer(body, "<u8", blocks + 1, at + 16 * docs).astype(np.int64)
        self.words = np.frombuffer(body, "<u8", int(self.offsets[-1]), at + 16 * docs + 8 * (blocks + 1))

    def ids(self, first: int = 0, count: int | None = None) -> np.ndarray:
        last = self.n if count is None else first + count
        a, b = first // self.block, min(-(-last // self.block), len(self.offsets) - 1)
        if last <= first:
            return np.zeros(0, np.uint64)
        got = unpack(self.words[self.offsets[a] : self.offsets[b]])
        return got[first - a * self.block : last - a * self.block]


def _write(batches: Iterator, file: str, end_id: int, block: int, most: int):
    import pyarrow as pa

    encode = tokens.encoder(file).ids
    end, shard, part = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0
    docs, counts, held, n, before = [], [], [], 0, 0

    def flush():
        body = image(docs, counts, np.frombuffer(b"".join(held), "<u4"), block)
        return pa.RecordBatch.from_pydict({"shard": [shard], "part": [part], "before": [before], "n_ids": [n], "image": [body]}, schema=pa.schema({"shard": pa.int64(), "part": pa.int64(), "before": pa.int64(), "n_ids": pa.int64(), "image": pa.binary()}))

    for b in common.sliced(batches, 1000):
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids = encode(text) + end
            docs.append(NULL_ID if doc is None else doc)
            counts.append(len(ids) // 4)
            held.append(ids)
            n += len(ids) // 4
            if n >= most:
                yield flush()
                docs, counts, held, before, n, part = [], [], [], before + n, 0, part + 1
    if docs:
        yield flush()


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, parts: int | None = None, block: int = 4096, most: int = 1 << 19) -> None:
    """Encodes docs (doc_id, text), an end id after each, and writes images to path in ascending doc_id order
    (null first; repeated doc_ids by text). A null text is empty. Column shard rises with doc_id; an image has
    about ``most`` ids, a document lies in one image. tokenizer: path of a tokenizers file, read on the driver.
    """
    spark = docs.sparkSession
    file = tokens.read_file(tokenizer)
    parts = parts or common.shuffle_parts(spark)
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(partial(_write, file=file, end_id=end_id, block=block, most=most), "shard long, part long, before long, n_ids long, image binary").write.option("compression", "none").parquet(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """The images with the number of ids before each (base)."""
    images = spark.read.schema("shard long, part long, before long, n_ids long, image binary").parquet(path)
    # One row a shard, as many as the writer had tasks; the images of one shard are few.
    shards = images.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()
    before, total = {}, 0
    for r in sorted(shards, key=lambda r: r["shard"]):
        before[r["shard"]], total = total, total + r["n"]
    starts = spark.createDataFrame(list(before.items()) or [(-1, 0)], "shard long, shard_base long")
    # An image says how many ids of its shard stand before it; only the shards' own bases are broadcast.
    return images.join(F.broadcast(starts), "shard").withColumn("base", F.col("shard_base") + F.col("before"))


def _documents():
    def step(bases, bodies):
        docs, starts, counts, crcs = [], [], [], []
        for base, body in zip(bases, bodies, strict=True):
            im = Image(body)
            ids = im.ids().astype("<u4")
            ends = np.cumsum(im.counts)
            for d, c, e in zip(im.doc_ids.tolist(), im.counts.tolist(), ends.tolist(), strict=True):
                docs.append(None if d == NULL_ID else d)
                starts.append(base + e - c)
                counts.append(c)
                crcs.append(zlib.crc32(ids[e - c : e]))
        return docs, starts, counts, crcs

    return step


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""
    return common.map_batches(read_images(spark, path).select("base", "image"), _documents, "doc_id long, start long, n_tokens long, ids_crc32 long", rows=1)


def export_images(images: DataFrame, folder: str) -> int:
    """Writes images as plain files {shard}-{part}.qs8b to a folder that the driver sees; gives their number."""
    import os

    n = 0
    for r in images.select("shard", "part", "image").toLocalIterator():
        with open(os.path.join(folder, f"{r['shard']:06d}-{r['part']:06d}.qs8b"), "wb") as f:
            f.write(r["image"])
        n += 1
    return n
