"""Best-fit packing of tokenised documents into sequences.

Every sequence has three capacities: tokens, documents and attention cost (the sum of squared lengths). Pieces
are placed from the longest down, each into the open sequence that leaves the best score among those where it
fits under every constraint, else into a new one. Score "norm": the least weighted norm of what would be left;
"dot": the greatest weighted dot product of the piece's demand with what is left.
"""

from __future__ import annotations

import math
import zlib
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens


def place(lengths: np.ndarray, tokens_cap: int, docs_cap: int, cost_cap: int, score: str = "norm", weights: tuple[float, float, float] = (1.0, 0.05, 0.05)) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, lengths in falling order; each must fit an empty bin."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    caps = np.array([tokens_cap, docs_cap, cost_cap], np.float64)
    left = np.empty((3, n + 1))  # of open bins, by resource
    open_ids = np.empty(n + 1, np.int64)
    n_open = made = 0
    w = np.array(weights)[:, None] / caps[:, None] ** 2
    least = float(lengths.min()) if n else 0
    for i, size in enumerate(lengths.tolist()):
        want = np.array([size, 1.0, float(size) * size])
        best = -1
        if n_open:
            rest = left[:, :n_open] - want[:, None]
            fits = rest.min(axis=0) >= 0
            if fits.any():
                value = -(w * rest * rest).sum(axis=0) if score == "norm" else (w * want[:, None] * left[:, :n_open]).sum(axis=0)
                best = int(np.where(fits, value, -np.inf).argmax())
        if best < 0:
            best = n_open
            left[:, best] = caps
            open_ids[best] = made
            made, n_open = made + 1, n_open + 1
        bins[i], offsets[i] = open_ids[best], tokens_cap - int(left[0, best])
        left[:, best] -= want
        if left[0, best] < least or left[1, best] < 1 or left[2, best] < least * least:  # nothing fits any more
            n_open -= 1
            left[:, best], open_ids[best] = left[:, n_open], open_ids[n_open]
    return bins, offsets


def _pack(pdf: pd.DataFrame, cap: int, docs_cap: int, cost_cap: int, score: str) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
    n = pdf["length"].to_numpy(np.int64)
    full = int((n == cap).sum())  # these fill a sequence each
    bins, offsets = place(n[full:], cap, docs_cap, cost_cap, score)
    seq = np.concatenate([np.arange(full), full + bins])
    return pdf.assign(sequence_id=(pdf["shard"].to_numpy(np.int64) << 32) + seq, offset=np.concatenate([np.zeros(full, np.int64), offsets])).drop(columns=["shard"])


def _pieces(file: str, end_id: int, cap: int):
    def make():
        encode = tokens.encoder(file).ids
        end = np.array([end_id], "<u4").tobytes()

        def step(doc_ids, texts):
            docs, pieces, starts, lengths, crcs = [], [], [], [], []
            for doc, text in zip(doc_ids, texts, strict=True):
                ids = encode(text) + end
                n = len(ids) // 4
                a, k = 0, 0
                b = n % cap or cap
                while a < n:
                    docs.append(doc)
                    pieces.append(k)
                    starts.append(a)
                    lengths.append(b - a)
                    crcs.append(zlib.crc32(ids[4 * a : 4 * b]))
                    a, b, k = b, b + cap, k + 1
            return docs, pieces, starts, lengths, crcs

        return step

    return make


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, max_documents: int | None = None, max_cost: int | None = None, score: str = "norm", shard: int = 8192) -> DataFrame:
    """Packs docs (doc_id, text; a null text is empty, an empty one has its end id alone) into sequences.

    Only documents of more than ``capacity`` ids are cut, or of so many that they alone cost more than ``max_cost``,
    into pieces of the most ids that fit an empty sequence, of which the first may be shorter. Pieces are dealt by their
    numbers into shards of about ``shard`` pieces, whatever their doc_ids; each shard is packed by itself, which costs at
    most about one open sequence a shard. max_documents and max_cost default to what tokens allow anyway. Repeated rows
    are packed once each; other columns of docs take no part. Returns doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    longest = min(capacity, math.isqrt(max_cost or capacity * capacity))
    pieces = common.map_batches(rows, _pieces(tokens.read_file(tokenizer), end_id, longest), "doc_id long, piece int, start long, length long, ids_crc32 long")
    # A written table, so that a piece keeps its number whatever is computed again.
    pieces = common.saved(pieces.withColumn("number", F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-pieces.count() // shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("number"), F.lit(shards)).cast("long")).drop("number")
    return dealt.groupBy("shard").applyInPandas(
        partial(_pack, cap=capacity, docs_cap=max_documents or capacity, cost_cap=max_cost or capacity * capacity, score=score),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
