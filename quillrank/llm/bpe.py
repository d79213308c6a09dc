"""BPE with a memory-mapped lexicon of frequent words.

The most frequent words of the corpus and their ids are compiled into a minimal acyclic automaton: suffixes are
shared, and each arc carries the number of words that leave its state by earlier arcs, so that the sum along a
word's path is its number among the sorted words and selects its ids. Each worker maps the automaton's bytes
from a file. A word that it lacks is merged pair by pair, lowest rank first, leftmost among equals.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import struct
import tempfile
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

_HEAD = struct.Struct("<4sIIII")


class Merges:
    """Ranked merges of a tokenizers BPE file, on pieces in the letters of tokens.byte_letters."""

    def __init__(self, file: str):
        model = json.loads(file)["model"]
        if model["type"] != "BPE" or model["dropout"] or model["continuing_subword_prefix"] or model["ignore_merges"] or model["byte_fallback"] or model["unk_token"]:
            raise ValueError("a plain BPE file is needed")
        self.vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): r for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.made = [self.vocab[a + b] for a, b in pairs]

    def ids(self, piece: str) -> list[int]:
        got = [self.vocab[c] for c in piece[:-1]] + [self.vocab[piece[-1] + self.suffix]]
        rank, never = self.rank, len(self.made)
        found = [rank.get(p, never) for p in zip(got, got[1:])]
        while found and (best := min(found)) < never:
            i = found.index(best)
            got[i : i + 2] = [self.made[best]]
            del found[i]
            if i:
                found[i - 1] = rank.get((got[i - 1], got[i]), never)
            if i < len(found):
                found[i] = rank.get((got[i], got[i + 1]), never)
        return got


def compile_lexicon(entries: Iterable[tuple[str, list[int]]]) -> bytes:
    """Compiles pieces with their ids; the bytes that Lexicon reads."""
    items = sorted((k.encode("utf-8"), v) for k, v in dict(entries).items())
    # States as [final, {byte: state}]; a state off the current path is replaced by an equal registered one.
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    path, last = [0], b""

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            s = path.pop()
            key = (final[s], tuple(arcs[s].items()))
            arcs[path[-1]][last[len(path) - 1]] = known.setdefault(key, s)

    for word, _ in items:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        settle(same)
        for c in word[same:]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][c] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        last = word
    settle(0)
    order, at = [0], {0: 0}  # the states that are left, from the start
    for s in order:
        for t in arcs[s].values():
            if t not in at:
                at[t] = len(order)
                order.append(t)
    below: dict[int, int] = {}
    for s in sorted(order, key=lambda s: -s):  # arcs lead to states made later, or to shared ones: repeat until known
        stack = [s]
        while stack:
            x = stack[-1]
            if missing := [t for t in arcs[x].values() if t not in below]:
                stack += missing
            else:
                below[x] = final[x] + sum(below[t] for t in arcs[x].values())
                stack.pop()
    first, label, target, skip = [0], [], [], []
    for s in order:
        passed = int(final[s])
        for c, t in arcs[s].items():
            label.append(c)
            target.append(at[t])
            skip.append(passed)
            passed += below[t]
        first.append(len(label))
    ends = np.cumsum([0, *(len(v) for _, v in items)])
    ids = [x for _, v in items for x in v]
    parts = [np.array(first, "<u4"), np.array([final[s] for s in order], "u1"), np.array(label, "u1"), np.array(target, "<u4"), np.array(skip, "<u4"), np.array(ends, "<u4"), np.array(ids, "<u4")]
    return _HEAD.pack(b"QLEX", len(order), len(label), len(items), len(ids)) + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """Looks pieces up in compiled bytes, mapped from an unnamed file of this worker."""

    def __init__(self, body: bytes):
        f = tempfile.TemporaryFile()
        f.write(body)
        f.flush()
        self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        f.close()
        magic, states, n_arcs, words, n_ids = _HEAD.unpack_from(self.map)
        if magic != b"QLEX":
            raise ValueError("not a lexicon")
        self.words, at = words, _HEAD.size

        def view(kind: str, size: int) -> memoryview:
            nonlocal at
            got = memoryview(self.map)[at : at + size].cast(kind)
            at += size
            return got

        self.first, self.final, self.labels = view("I", 4 * (states + 1)), view("B", states), view("B", n_arcs).tobytes()
        self.target, self.skip, self.ends, self.out = (view("I", 4 * n) for n in (n_arcs, n_arcs, words + 1, n_ids))
        self.states = states

    def ids(self, piece: str) -> list[int] | None:
        state, number = 0, 0
        find, first, target, skip = self.labels.find, self.first, self.target, self.skip
        for c in piece.encode("utf-8"):
            arc = find(c, first[state], first[state + 1])
            if arc < 0:
                return None
            number += skip[arc]
            state = target[arc]
        return self.out[self.ends[number] : self.ends[number + 1]].tolist() if self.final[state] else None


class Coder:
    """Encodes and decodes whole texts with a lexicon and exact merges."""

    def __init__(self, file: str, lexicon: bytes, units: int = 350_000, pieces: int = 350_000):
        self.cut = tokens.Pieces(file)
        self.merges = Merges(file)
        self.lexicon = Lexicon(lexicon)
        self.letters = {i: t for t, i in self.merges.vocab.items()} | {i: t for t, i in self.cut.special.items()}
        self.pieces = tokens.Remembered(self._piece, pieces)
        self.units = tokens.Remembered(self._unit, units)

    def _unit(self, unit: str) -> tuple[str, str]:
        got = [self.pieces[p] for p in self.cut.of_unit(unit)]
        return got[0] if len(got) == 1 else (" ".join([a for a, _ in got]), " ".join([b for _, b in got]))

    def _piece(self, piece: str) -> tuple[str, str]:
        ids = self.lexicon.ids(piece)
        ids = self.merges.ids(piece) if ids is None else ids
        return " ".join(map(str, ids)), " ".join([self.letters[i] for i in ids])

    def coded(self, text: str | None) -> tuple[str, str]:
        """The decimal ids and the decoded tokens, each joined by a blank: what the library's encode and decode
        of a file without a decoder give."""
        if not text:
            return "", ""
        if (units := self.cut.units(text)) is not None and self.cut.style == "words":
            numbers, letters = zip(*map(self.units.__getitem__, units)) if units else ((), ())
            return " ".join(numbers), " ".join(letters)
        got = [(str(p), self.letters[p]) if isinstance(p, int) else self.pieces[p] for p in self.cut.of_text(text)]
        return " ".join([a for a, _ in got]), " ".join([b for _, b in got])


@lru_cache(1)
def coder(file: str, lexicon: bytes) -> Coder:
    return Coder(file, lexicon)


def _counts(file: str):
    def make():
        cut, units, pieces = tokens.Pieces(file), Counter(), Counter()

        def out():
            for u, n in units.items():
                for p in cut.of_unit(u):
                    pieces[p] += n
            words, numbers = list(pieces), list(pieces.values())
            units.clear()
            pieces.clear()
            return words, numbers

        def step(texts):
            for t in texts:
                if t and (u := cut.units(t)) is not None:
                    units.update(u)
                elif t:
                    pieces.update([p for p in cut.of_text(t) if isinstance(p, str)])
            if len(units) + len(pieces) > 500_000:  # bounds the task's memory; Spark adds up the parts
                return out()
            return None

        step.rest = out
        return step

    return make


def build_lexicon(docs: DataFrame, file: str, words: int = 32768, longest: int = 64) -> bytes:
    """Counts the pieces of all docs and compiles the ``words`` most frequent ones of at most ``longest`` characters.
    Special tokens are no pieces."""
    counted = common.map_batches(docs.select(F.col("text").cast("string")), _counts(file), "word string, n long")
    top = common.most_frequent(counted.where(F.length("word") <= longest).groupBy("word").agg(F.sum("n").alias("n")), words)
    merges = Merges(file)
    return compile_lexicon((word, merges.ids(word)) for word, _ in top)


def encode_decode(docs: DataFrame, tokenizer: str, words: int = 32768) -> DataFrame:
    """docs (doc_id, text; a null text is empty) -> doc_id, n_tokens, ids_sha256, decoded_sha256. Repeated rows
    are coded once each."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    file = tokens.read_file(tokenizer)
    if tokens.Pieces(file).tokenizer.decoder is not None:
        raise ValueError("a file without a decoder is needed")
    shared = docs.sparkSession.sparkContext.broadcast((file, build_lexicon(rows, file, words)))

    def make():
        code = coder(*shared.value).coded

        def step(doc_ids, texts):
            n, a, b = [], [], []
            for t in texts:
                ids, decoded = code(t)
                n.append(ids.count(" ") + 1 if ids else 0)
                a.append(hashlib.sha256(ids.encode()).hexdigest())
                b.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
            return doc_ids, n, a, b

        return step

    return common.map_batches(rows, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
