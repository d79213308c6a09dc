"""Alignment of two tokenizers' tokens: which tokens of one stand for which of the other.

A byte-level BPE file (A) and a sentencepiece model (B) cut the same bytes. Tokens of A and B that overlap are joined in
a bipartite graph; its connected components, by union-find, are the smallest groups of tokens with the same bytes, and every A
token of a component is linked with every B token of it. Links are counted over the corpus: for a pair of ids, in how
many documents it is linked.

Within a task, a text is cut where both tokenizers are sure to have a token end: before words that follow a single blank
or line end, and before a sign after a letter. What lies between, a unit, is aligned by itself and remembered; units that
are new are aligned together, in one call of each tokenizer. Pairs are counted by Spark. A link's count then comes back to
its documents in two ways: a bounded number of the most frequent pairs is broadcast, and the others, each of which has a
small share of all rows, are joined by pair.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

#: Pairs that are broadcast at most: some 2 megabytes.
FREQUENT = 1 << 17
#: Characters of texts aligned at once.
CHARACTERS = 1_000_000
#: A pair of ids is one number: the A id times 2**_SHIFT plus the B id.
_SHIFT = 20
#: Bits of such a number; vocabularies are smaller than 2**20.
_PAIR = 2 * _SHIFT
#: No white space, by the widest notion of it.
_SOLID = r"[^\s\x1c-\x1f\x85]"
#: Signs before which a text may be cut, and the letters that have to stand before them.
_SIGNS, _LETTERS = ",.;:!?)", "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_REGULAR = re.compile(rf"[ \n](?:(?!\u2581){_SOLID})+")


def components(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over tokens that overlap, given by their ends on the same bytes: number of the component of each A token and of
    each B token, in order. All edges are joined at once, the greater root under the smaller one, and paths
    are halved, until no edge joins two trees."""
    n = len(a_ends)
    mark = np.zeros(int(a_ends[-1]) + 1 if n else 0, bool)
    mark[a_ends] = mark[b_ends] = True
    end = np.flatnonzero(mark)  # what lies before an end and after the last one is in one token of each
    a, b = np.searchsorted(a_ends, end), n + np.searchsorted(b_ends, end)
    root = np.arange(n + len(b_ends))
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    number = np.cumsum(root[:n] == np.arange(n)) - 1  # a component's root is its first A token
    return number[root[:n]], number[root[n:]]


class Numbered(dict):
    """Names and their numbers; a new name gets the next one and waits in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.n = 0

    def __missing__(self, name: str) -> int:
        self[name] = number = self.n
        self.n += 1
        self.new.append(name)
        return number


class Aligner:
    """Aligns texts by two tokenizers' files. Units are numbered; those of up to ``longest`` characters keep their numbers until
    there are ``most`` or their pairs have grown to ``most_pairs``."""

    def __init__(self, a_file: str, b_model: bytes, most: int = 500_000, longest: int = 48, most_pairs: int = 4_000_000):
        import sentencepiece

        cut = tokens.Pieces(a_file)
        if cut.style != "spaced":
            raise ValueError("A has to be a byte-level BPE file in which a blank belongs to the word after it")
        self.a, self.most, self.longest, self.most_pairs = cut.tokenizer, most, longest, most_pairs
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        letters = {c: b for b, c in tokens.byte_letters().items()}
        vocabulary = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [bytes(map(letters.get, t)) if (t := vocabulary.get(i, "")) not in cut.special else b"" for i in range(max(vocabulary) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any("\u2581" in p.lstrip("\u2581") or "\n" in p for p in pieces):
            raise ValueError("B has a piece that goes on over a blank or a line end")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        signs = "".join(c for c in _SIGNS if not any(re.search(f"[{_LETTERS}]{re.escape(c)}", p) for p in pieces))
        sign = rf"|(?<=[{_LETTERS}])(?=[{re.escape(signs)}])" if signs else ""
        self.split = re.compile(rf"(?<={_SOLID})(?=[ \n]{_SOLID}){sign}").split
        # The same for texts whose only white space is single blanks and line ends between other characters.
        self.find = re.compile(rf"[ \n]?(?:[^ \n{_LETTERS}]++|[{_LETTERS}]++(?![{re.escape(signs)}]))*+[{_LETTERS}]*+").findall if signs else self.split
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << _SHIFT:
            raise ValueError("a vocabulary is too large")
        self.sizes = [np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes)]
        self._forget()

    def _forget(self) -> None:
        self.numbers = Numbered()
        self.slots = np.zeros(0, np.int64)  # where a number's unit stands below; -1 for a unit without tokens
        self.groups: list[bytes] = []
        self.sums: list[np.ndarray] = []  # n_a, n_b, n_groups, n_links, number of pairs
        self.pairs: list[np.ndarray] = []
        self.links: list[np.ndarray] = []
        self.n_pairs = 0

    def cut(self, text: str) -> list[str]:
        text = f" {text}"
        if text[1].isspace() or text[-1].isspace() or any(x in text for x in ("  ", " \n", "\n ", "\n\n")) or not tokens.plain(text):
            return self.split(text)
        units = self.find(text)
        if not units[-1]:
            units.pop()
        return units

    def _add(self, names: int, a: list[int], b: list[int], sizes: list[int]) -> None:
        """Adds as many new units, given the tokens of all of them on end and their lengths in bytes."""
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        a_ends, b_ends, ends = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b]), np.cumsum(sizes)
        of_a, of_b = components(a_ends, b_ends)
        many = len(of_a) and int(of_a[-1]) + 1
        n_a, n_b = np.bincount(of_a, minlength=many), np.bincount(of_b, minlength=many)
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        unit = np.searchsorted(ends, a_ends[first_a])  # of each component
        in_unit = np.bincount(unit, minlength=names)
        total = lambda x: np.bincount(unit, x, names).astype(np.int64)
        # Every A token meets every B token of its component.
        times = n_b[of_a]
        pair = np.repeat(a << _SHIFT, times) | b[np.repeat(first_b[of_a] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))]
        whose = np.repeat(unit[of_a], times)
        key = np.sort(whose << _PAIR | pair)
        pair, whose = key & ((1 << _PAIR) - 1), key >> _PAIR
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[: len(key)]
        self.pairs.append(pair[new])
        self.links.append(np.diff(np.append(new, len(pair))))
        self.n_pairs += len(new)
        self.sums.append(np.column_stack([total(n_a), total(n_b), in_unit, total(n_a * n_b), np.bincount(whose[new], minlength=names)]))
        x, y = list(map(str, a.tolist())), list(map(str, b.tolist()))
        said = [f"{x[i]}|{y[j]}" if p == q == 1 else f"{','.join(x[i : i + p])}|{','.join(y[j : j + q])}" for i, p, j, q in zip(first_a.tolist(), n_a.tolist(), first_b.tolist(), n_b.tolist(), strict=True)]
        at = 0
        for k in in_unit.tolist():
            self.groups.append(";".join(said[at : at + k]).encode())
            at += k

    def _tokens(self, lead: str, text: str) -> tuple[list[int], list[int]] | None:
        """The tokens of a text after what leads to it; None if a tokenizer doesn't give its bytes back."""
        a, b = self.a.encode_batch_fast([lead + text], add_special_tokens=False)[0].ids, self.b.encode((lead + text)[1:])
        skip = len(lead.encode())
        for ids, known in ((a, self.a_bytes), (b, self.b_bytes)):
            n = i = 0
            while n < skip:
                n += len(known[ids[i]])
                i += 1
            del ids[:i]
            if n > skip or b"".join(map(known.__getitem__, ids)) != text.encode():
                return None
        return a, b

    def _learn(self) -> None:
        """Aligns the units that wait."""
        names, self.numbers.new = self.numbers.new, []
        slots = np.full(len(names), -1)
        regular = [i for i, x in enumerate(names) if len(x) <= self.longest and _REGULAR.fullmatch(x)]
        some = [names[i] for i in regular]
        if some and (found := self._tokens(" a", "".join(some))):
            slots[regular] = len(self.groups) + np.arange(len(some))
            self._add(len(some), *found, [len(x.encode()) for x in some])
        for i in np.flatnonzero(slots < 0).tolist():
            # B's encoder sets a blank before its text; a sign has a letter before it, a line end too.
            if found := self._tokens("" if names[i][0] == " " else " a", names[i]):
                slots[i] = len(self.groups)
                self._add(1, *found, [len(names[i].encode())])
        self.slots = np.concatenate([self.slots, slots])
        for x in names:
            if len(x) > self.longest:  # not kept for later texts
                del self.numbers[x]

    def documents(self, texts: list[str | None]) -> tuple:
        """(n_a, n_b, n_groups, n_links, groups, pairs, links) of each text, as columns: pairs are distinct and ascending."""
        if self.numbers.n > self.most or self.n_pairs > self.most_pairs:
            self._forget()
        numbers = [list(map(self.numbers.__getitem__, self.cut(t))) if t else [] for t in texts]
        if self.numbers.new:
            self._learn()
        size = np.array(list(map(len, numbers)), np.int64)
        unit = self.slots[np.concatenate([np.array(x, np.int64) for x in numbers])]
        doc = np.repeat(np.arange(len(texts)), size)
        without = np.zeros(len(texts), bool)
        without[doc[unit < 0]] = True  # a unit has no tokens, so its text has none
        size[without] = 0
        unit, doc = unit[~without[doc]], doc[~without[doc]]
        groups, at, known = [], 0, unit.tolist()
        for n in size.tolist():
            groups.append(hashlib.sha256(b";".join(map(self.groups.__getitem__, known[at : at + n]))).hexdigest() if n else "")
            at += n
        for known in (self.sums, self.pairs, self.links):
            known[:] = [np.concatenate(known)] if known else []
        if not len(unit):
            zero, none = [0] * len(texts), [np.zeros(0, np.int64)] * len(texts)
            return zero, zero, zero, zero, groups, none, none
        sums = self.sums[0]
        # A unit's number of times in a document weighs its links.
        key = np.sort(doc << 32 | unit)
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, times = key[new], np.diff(np.append(new, len(key)))
        doc, unit = key >> 32, key & 0xFFFFFFFF
        columns = [np.bincount(doc, sums[unit, c] * times, len(texts)).astype(np.int64).tolist() for c in range(4)]
        many = sums[unit, 4]
        first = (np.cumsum(sums[:, 4]) - sums[:, 4])[unit]
        at = np.repeat(first - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        key, link = np.repeat(doc, many) << _PAIR | self.pairs[0][at], self.links[0][at] * np.repeat(times, many)
        order = np.argsort(key)
        key = key[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        pair, link = key[new] & ((1 << _PAIR) - 1), np.add.reduceat(link[order], new)
        edge = np.searchsorted(key[new] >> _PAIR, np.arange(1, len(texts)))
        return *columns, groups, np.split(pair, edge), np.split(link, edge)


@lru_cache(1)
def aligner(a_file: str, b_model: bytes) -> Aligner:
    """The worker's aligner; tasks of one worker share what it remembers."""
    return Aligner(a_file, b_model)


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>"


def aligned(docs: DataFrame, a_file: str, b_model: bytes) -> DataFrame:
    """docs (doc_id, text) -> ALIGNED: pairs are the distinct ones of a document, ascending, links how often each is linked."""
    both = docs.sparkSession.sparkContext.broadcast((a_file, b_model))

    def make():
        align = aligner(*both.value)

        def step(ids, texts):
            parts, at = [], 0
            while at < len(texts):  # about CHARACTERS at once, but for a longer text
                end, n = at, 0
                while end < len(texts) and (n == 0 or n + len(texts[end] or "") <= CHARACTERS):
                    n += len(texts[end] or "")
                    end += 1
                parts.append(align.documents(texts[at:end]))
                at = end
            return ids, *([x for part in column for x in part] for column in zip(*parts, strict=True))

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.map_batches(rows, make, ALIGNED, rows=500)


def counted(found: DataFrame) -> DataFrame:
    """aligned's rows -> (pair, n, best): in how many documents a pair is linked, and whether no other pair of its A id is in
    more. The greatest counts by A id are at most as many as the vocabulary has ids."""
    pairs = common.saved(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    a = F.shiftright("pair", _SHIFT).alias("a")
    most = pairs.groupBy(a).agg(F.max("n").alias("most"))
    return common.saved(pairs.withColumn("a", F.shiftright("pair", _SHIFT)).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counted")


def frequent(pairs: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, n, best) of the most frequent pairs, ascending by pair: all counts from the top that have at most ``most`` pairs
    together."""
    top = common.most_frequent(pairs.select("pair", "n"), most)
    if not top:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    least = top[-1][1]
    got = pairs.where(F.col("n") >= least).toArrow()
    pair, n, best = got.column("pair").to_numpy(), got.column("n").to_numpy(), got.column("best").to_numpy(zero_copy_only=False)
    order = np.argsort(pair)
    return pair[order], n[order], best[order]


def _known(shared) -> Callable:
    """Within a task: (number, pairs, links) -> (number, n_best, count_sum, pairs, links): what the frequent pairs
    say, and the pairs left."""

    def make():
        keys, n, best = shared.value

        def step(numbers, pairs, links):
            out = ([], [], [], [])
            for p, m in zip(pairs, links, strict=True):
                p, m = np.array(p, np.int64), np.array(m, np.int64)
                at = np.searchsorted(keys, p).clip(max=max(len(keys) - 1, 0))
                here = keys[at] == p if len(keys) else np.zeros(len(p), bool)
                found = at[here]
                for column, x in zip(out, (int(m[here][best[found]].sum()), int((m[here] * n[found]).sum()), p[~here], m[~here]), strict=True):
                    column.append(x)
            return numbers, *out

        return step

    return make


def align(docs: DataFrame, a_file: str, b_model: bytes, most: int = FREQUENT) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    a_file: text of a byte-level BPE tokenizers file, whose special tokens' strings are plain text here; b_model: bytes of a
    sentencepiece model that puts a blank before a text. A text that is null or empty, or whose bytes a tokenizer doesn't
    give back with that blank, has no tokens: zeros and ''. A link's count is the number of documents in which its pair
    of ids is linked; n_best are links of which no other pair with the same A id has a higher count, count_sum is the
    sum over links. Each row is a document of its own, whatever its doc_id; other columns take no part.
    """
    spark = docs.sparkSession
    found = common.saved(aligned(docs, a_file, b_model).withColumn("number", F.monotonically_increasing_id()), "aligned", compression="zstd")
    pairs = counted(found)
    top = spark.sparkContext.broadcast(frequent(pairs, most))
    known = common.saved(common.map_batches(found.select("number", "pairs", "links"), _known(top), "number long, n_best long, count_sum long, pairs array<long>, links array<long>", rows=500), "known", compression="zstd")
    left = known.select("number", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("number", F.col("x.pairs").alias("pair"), F.col("x.links").alias("links"))
    others = left.join(pairs, "pair").groupBy("number").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more_sum"))
    sums = known.select("number", "n_best", "count_sum").join(others, "number", "left").select("number", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"))
    return found.drop("pairs", "links").join(sums, "number").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
