"""The exact operators against brute force, with nulls, empty, long and repeated texts, ties, empty tables and extra
columns of clashing names."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrank.llm import bpe, digest, idfile, jaccard, mtree, packing, spans, substring, suffix, tokens

SCHEMA = "doc_id long, text string, n_removed string, row int, score double, key string"
WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"


def path(name):
    return pytest.importorskip("public_tokenizers").path(name)


def corpus(seed=0, n=60):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 5))) for _ in range(40)]
    say = lambda k: " ".join(rnd.choice(vocab) for _ in range(k))
    common = [say(45) for _ in range(3)]
    texts = [None, "", " ", "one", "two  words\n", "X " * 400, say(4000)]
    base = say(120)
    for i in range(n):
        kind = i % 6
        if kind == 0:
            texts.append(say(rnd.randint(1, 150)))
        elif kind == 1:
            texts.append(say(30) + " " + rnd.choice(common) + "\t" + say(20))
        elif kind == 2:
            texts.append(rnd.choice([t for t in texts if t]))
        else:
            w = base.split()
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
            texts.append(" ".join(w) if kind < 5 else " ".join(w).upper())
    rnd.shuffle(texts)
    return list(enumerate(texts))


def table(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, 0.5, "k") for d, t in rows], SCHEMA)


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def words_removed(rows, k):
    seen, out = set(), []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            if g in seen:
                gone[i : i + k] = [True] * k
            seen.add(g)
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, y in zip(w, gone) if not y)).hexdigest()))
    return sorted(out, key=repr)


def bytes_removed(rows, k):
    count = collections.Counter(b[i : i + k] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - k + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - k + 1):
            if count[b[i : i + k]] > 1:
                gone[i : i + k] = b"\1" * k
        kept = bytes(x for x, y in zip(b, gone) if not y)
        out.append((d, len(b), sum(gone), sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def bytes_removed_of(rows, k):
    """(doc_id, what stays)."""
    count = collections.Counter(b[i : i + k] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - k + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - k + 1):
            if count[b[i : i + k]] > 1:
                gone[i : i + k] = b"\1" * k
        out.append((d, bytes(x for x, y in zip(b, gone) if not y)))
    return out


@pytest.mark.parametrize("hot", [256, 1])
def test_substring(spark, hot):
    rows = corpus(1)
    assert got(substring.dedup_words(table(spark, rows).repartition(3), 20, hot=hot), "doc_id", "n_words", "n_removed", "kept_sha256") == words_removed(rows, 20)


@pytest.mark.parametrize("hot", [256, 1])
@pytest.mark.parametrize("length, gram", [(60, 15), (200, 50)])
def test_suffix(spark, hot, length, gram):
    rows = corpus(2)
    out = suffix.dedup_bytes(table(spark, rows).repartition(3), length, gram, hot=hot)
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == bytes_removed(rows, length)


def thue_morse(n):
    """Words of n letters for which polynomials modulo 2**64 collide."""
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join("ab"[x] for x in bits), "".join("ab"[1 - x] for x in bits)


def test_texts_made_to_collide(spark):
    a, b = thue_morse(2048)
    lead = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{lead} {a}"), (2, f"{lead} {b}"), (3, f"x y z {a}"), (4, f"x y z {b}"), (5, " ".join(a[:512])), (6, " ".join(b[:512]))]
    assert got(substring.dedup_words(table(spark, rows), 20), "doc_id", "n_words", "n_removed", "kept_sha256") == words_removed(rows, 20)
    assert got(jaccard.near_groups(table(spark, rows)), "doc_id", "n_shingles", "component_id") == groups(rows, 4, 85)
    out = suffix.dedup_bytes(table(spark, rows), 200, 50)
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == bytes_removed(rows, 200)


def test_paths_compact(spark):
    """A chain of edges is one path, a fork starts new ones, a cycle ends."""
    edges = [(i, 2, 100 + i, 101 + i) for i in range(40)] + [(50, 1, 140, 200), (51, 1, 140, 201), (60, 3, 300, 301), (61, 1, 301, 300), (70, 1, 400, 400)]
    out = {r["edge"]: (r["path"], r["at"]) for r in substring.compacted(spark.createDataFrame(edges, "edge long, m int, tail long, head long")).collect()}
    assert all(out[i] == (0, 2 * i) for i in range(40)) and out[50] == (50, 0) and out[51] == (51, 0)
    assert out[60] == (60, 0) and out[61] == (61, 0) and out[70] == (70, 0) and len(out) == len(edges)


def test_buckets_are_strings():
    rnd = np.random.default_rng(4)
    for depth in (1, 3, 8, 9, 21, 64):
        data = rnd.integers(97, 99, 600, np.uint8).tobytes() + b"ab" * 90
        bucket = suffix.refined(data, depth)
        assert len(bucket) == len(data) - depth + 1
        assert len(set(zip(bucket.tolist(), (data[i : i + depth] for i in range(len(bucket)))))) == len(set(bucket.tolist())) == len({data[i : i + depth] for i in range(len(bucket))})


def test_chunks_of_long_texts(monkeypatch):
    monkeypatch.setattr(spans, "CHUNK", 100)
    seq = spans.by_bytes(10)()("ab" * 300 + "c" * 300)
    whole = {int(p): int(h) for h, _, p in [(h, b, p) for hs, bs, ps in seq.windows(np.array([0]), np.array([700]), 40) for h, b, p in zip(hs, bs, ps)]}
    assert len(whole) == 700 and whole[0] == whole[2] != whole[1]
    assert sum(int(m.sum()) for _, _, _, m in seq.runs(40, 10)) == 861


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None)]
    out = got(substring.dedup_words(table(spark, rows), 3, 2), "doc_id", "n_removed")
    assert sorted(n for _, n in out) == [0, 0, 6, 6] and (None, 0) in out
    assert all(n == 6 for d, n in got(suffix.dedup_bytes(table(spark, [(1, "abcdef"), (1, "abcdef")]), 3, 2), "doc_id", "n_removed"))
    assert {r[2] for r in got(jaccard.near_groups(table(spark, [(5, "a b c d"), (5, "a b c d"), (None, "x")])), "doc_id", "n_shingles", "component_id")} == {5, None}


def groups(rows, n, percent):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
    label = {d: d for d in sets}
    while True:
        new = dict(label)
        for a in sets:
            for b in sets:
                i = len(sets[a] & sets[b])
                if i and 100 * i >= percent * len(sets[a] | sets[b]):
                    new[a] = min(new[a], new[b])
        if new == label:
            return sorted(((d, len(sets[d]), label[d]) for d in sets), key=repr)
        label = new


@pytest.mark.parametrize("heavy", [False, True])
def test_jaccard(spark, monkeypatch, heavy):
    if heavy:  # make shingles of several documents count as frequent
        real = jaccard.frequent
        monkeypatch.setattr(jaccard, "frequent", lambda sets: real(sets, least=3))
        monkeypatch.setattr(jaccard, "_sets", (lambda f: lambda n, least: f(n, 2))(jaccard._sets))
    rows = corpus(3, 90)
    for n, percent in ((4, 85), (2, 80)):
        assert got(jaccard.near_groups(table(spark, rows).repartition(3), n, percent), "doc_id", "n_shingles", "component_id") == groups(rows, n, percent)


def test_entries_guarantee():
    """Sets that link share a key that may join them."""
    rnd = np.random.default_rng(0)
    heavy = np.sort(rnd.integers(1, 1 << 60, 400).astype(np.uint64))
    rank = rnd.permutation(len(heavy))
    for _ in range(400):
        size = int(rnd.integers(6, 80))
        pool = np.concatenate([rnd.choice(heavy, int(rnd.integers(0, size + 1)), replace=False), rnd.integers(1, 1 << 60, size).astype(np.uint64)])[:size]
        a = np.unique(pool)
        b = np.unique(np.concatenate([a[int(rnd.integers(0, 1 + len(a) // 12)) :], rnd.integers(1, 1 << 60, int(rnd.integers(0, 4))).astype(np.uint64)]))
        i, u = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if 100 * i >= 85 * u and i < u:
            x, y = ({k: (kind, most) for k, kind, most in zip(*jaccard.entries(s, 85, heavy, rank))} for s in (a, b))
            shared = [k for k in x if k in y]
            assert any(not (x[k][0] == y[k][0] == jaccard.FEW) and x[k][1] >= len(b) and y[k][1] >= len(a) for k in shared)
            assert jaccard.least_difference(jaccard.parity(a), jaccard.parity(b)) <= u - i
    large = rnd.integers(1, 1 << 63, 5000).astype(np.uint64)
    assert jaccard.least_difference(jaccard.parity(large), jaccard.parity(large[:600])) <= 4400
    assert jaccard.least_difference(jaccard.parity(large), jaccard.parity(rnd.integers(1, 1 << 63, 5000).astype(np.uint64))) > 2000


def test_tokens_are_the_librarys():
    odd = ["", "  a  b ", "x \n y\n\n z  ", "<|endoftext|>hi<|startoftext|>", "I'll don't 'S", "ǅ İ ß ẞ Σας", "日本語 12٣", "a\tb\r\nc\x85e\xa0f", "é ́x", "²³ ½x _a_", "\U0001f600 z\xad", " lead", "trail ", "\n", "a" * 500]
    rnd = random.Random(1)
    odd += ["".join(rnd.choice("ab'sT 12\n\t_-é<|²́日\xa0!?") for _ in range(rnd.randint(1, 40))) for _ in range(500)]
    for name in (WORD, BYTE):
        file = tokens.read_file(path(name))
        e = tokens.Encoder(file, 50, 50)
        for t in odd:
            assert np.frombuffer(e.ids(t), "<u4").tolist() == e.cut.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_simple8b():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 59, 60, 61, 5000):
        for top in (1, 2, 5, 17, 33, 60, 63):
            ids = rnd.integers(0, 1 << top, n, dtype=np.uint64)
            ids[rnd.random(n) < 0.5] = 0
            if n > 3:
                ids[1:3] = (1 << 63, (1 << 60) - 1)
            words, offsets = idfile.pack(ids, 100)
            assert (idfile.unpack(words) == ids).all()
            for b in range(len(offsets) - 1):
                assert (idfile.unpack(words[int(offsets[b]) : int(offsets[b + 1])]) == ids[100 * b : 100 * b + 100]).all()
    im = idfile.Image(idfile.image([4, 9], [2, 300], np.arange(302), 64))
    assert im.ids(150, 70).tolist() == list(range(150, 220)) and im.counts.tolist() == [2, 300]


def test_idfile(spark, tmp_path):
    rows = corpus(4) + [(None, "zuletzt")]
    idfile.write_ids(table(spark, rows), str(tmp_path / "f"), path(WORD), 2, parts=3, most=500)
    tok = tokens.Pieces(tokens.read_file(path(WORD))).tokenizer
    want, at = [], 0
    for d, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got(idfile.read_documents(spark, str(tmp_path / "f")), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    (tmp_path / "x").mkdir()
    assert idfile.export_images(idfile.read_images(spark, str(tmp_path / "f")), str(tmp_path / "x")) > 3


def test_bpe(spark):
    rows = corpus(5)
    tok = tokens.Pieces(tokens.read_file(path(WORD))).tokenizer
    want = []
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got(bpe.encode_decode(table(spark, rows), path(WORD), 20), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_lexicon_shares_suffixes():
    words = [a + b for a in ("re", "un", "mis") for b in ("do", "doing", "done", "leading", "")]
    lex = bpe.Lexicon(bpe.compile_lexicon((w, [i, i + 1]) for i, w in enumerate(words)))
    assert all(lex.ids(w) == [i, i + 1] for i, w in enumerate(words)) and lex.ids("red") is None and lex.ids("x") is None
    assert lex.states < 25
    assert bpe.Lexicon(bpe.compile_lexicon([])).ids("a") is None


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_packing(spark, score):
    rows = corpus(6)
    out = packing.pack_documents(table(spark, rows), path(BYTE), 2, capacity=100, max_documents=5, score=score, shard=1000).toPandas()
    tok = tokens.Pieces(tokens.read_file(path(BYTE))).tokenizer
    for d, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        p = out[out.doc_id == d].sort_values("piece")
        assert p.start.tolist() == (p.length.cumsum() - p.length).tolist() and p.length.sum() == len(ids) and (p.length[1:] == 100).all()
        assert p.ids_crc32.tolist() == [zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()) for a, n in zip(p.start, p.length)]
    s = out.sort_values(["sequence_id", "offset"])
    g = s.groupby("sequence_id")
    assert (s.offset == g.length.cumsum() - s.length).all() and g.length.sum().max() <= 100 and g.size().max() <= 5


def test_packing_of_odd_rows(spark):
    """Null and repeated doc_ids are packed once each, and spread over shards."""
    rows = [(None, "a b c")] * 40 + [(7, "d e")] * 40 + [(None, None)]
    out = packing.pack_documents(table(spark, rows), path(BYTE), 2, capacity=10, shard=16).toPandas()
    assert len(out) == 81 and len(set(out.sequence_id // (1 << 32))) == 6
    assert out.groupby("sequence_id").length.sum().max() <= 10


def test_full_pieces_keep_the_cost(spark):
    out = packing.pack_documents(table(spark, [(1, "a b c d e f g h i j k l m n o p" * 9)]), path(BYTE), 2, capacity=64, max_cost=400).toPandas()
    assert (out.length * out.length).groupby(out.sequence_id).sum().max() <= 400


def test_packing_is_tight():
    lengths = np.sort(np.random.default_rng(1).integers(1, 1000, 3000))[::-1]
    bins, _ = packing.place(lengths, 1024, 1024, 1024 * 1024)
    assert bins.max() + 1 <= 1.02 * -(-lengths.sum() // 1024)


def test_digest(spark):
    rows = corpus(7)
    out = {r["doc_id"]: r for r in digest.fingerprints(table(spark, rows), 4).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for (d, t), (_, following) in zip(order, [*order[1:], order[0]]):
        t, following = t or "", following or ""
        changed = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        r = out[d]
        assert (r["n_chars"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), digest.digest(t), digest.digest(changed))
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["near_next"] == digest.likeness(digest.digest(t), digest.digest(following)) and 0 <= r["near_edited"] <= 1
    assert digest.fingerprints(table(spark, rows[:1]), 2).first()["near_next"] == 1


def test_mtree(spark):
    rnd = np.random.default_rng(2)
    v = rnd.normal(size=(700, 8))
    v[50:60] = v[40]
    rows = [(i, v[i].tolist()) for i in range(700)] + [(700, None), (800, [float("nan")] * 8), (900, [None] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.floor(1024 * v).astype(int)
    want = []
    for q in range(0, 700, 100):
        best = sorted((-int(s), i) for i, s in enumerate(x @ x[q]) if i != q)[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got(mtree.top_k(df, block=3, page=200), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    # Repeated rows, unlike lengths, empty vectors, null ids.
    odd = [(1, [0.5, 0.5]), (1, [0.8, 0.2]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (2, [1.0]), (3, []), (None, [1.0, 1.0]), (200, [2.0])]
    out = mtree.top_k(spark.createDataFrame(odd, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")))
    asked = [(100, 1, 100, 1 << 20), (100, 2, 1, 819 * 1024), (100, 3, 1, 512 * 1024)]
    assert got(out, "query_id", "rank", "vec_id", "score") == sorted(asked * 2 + [(200, 1, 2, 2 << 20)], key=repr)
    clusters = np.repeat(rnd.normal(size=(20, 8)) * 500, 100, axis=0) + rnd.normal(size=(2000, 8))
    tree = mtree.Tree(clusters.astype(int), np.column_stack([np.arange(2000)] * 2))
    tree.search(tree.vectors[0], 5)
    assert tree.computed < 2000


def test_empty_tables(spark):
    e = table(spark, [])
    for df in (substring.dedup_words(e), suffix.dedup_bytes(e), jaccard.near_groups(e), digest.fingerprints(e, 2), packing.pack_documents(e, path(BYTE), 2), bpe.encode_decode(e, path(WORD))):
        assert df.count() == 0
    assert mtree.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
