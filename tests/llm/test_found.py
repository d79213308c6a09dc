"""Benchmark passages, periodic runs and token alignment against brute force, with nulls, empty, long and repeated
texts, ties, empty tables and extra columns of clashing names."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quillrank.llm import alignment, decontam, periodic, queries, tokens

SCHEMA = "doc_id long, text string, items string, row int, starts double, n_a string, number int"


def table(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, 0.5, "k", 2) for d, t in rows], SCHEMA)


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Benchmark passages


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hits(docs, items, k):
    found = collections.defaultdict(set)
    for i, t in items:
        w = plain(t)
        for a in range(max(1, len(w) - k + 1)):
            if w:
                found[tuple(w[a : a + k])].add(i)
    out = []
    for d, t in docs:
        w = plain(t)
        hit, mine = [False] * len(w), set()
        for n in {len(x) for x in found}:
            for a in range(len(w) - n + 1):
                if (x := tuple(w[a : a + n])) in found:
                    hit[a : a + n] = [True] * n
                    mine |= found[x]
        ids = sorted(str(i) for i in mine if i is not None)
        out.append((d, len(w), sum(hit), len(ids), sha(",".join(ids)), any(hit)))
    return sorted(out, key=repr)


def passages(seed):
    rnd = random.Random(seed)
    vocab = ["a", "b", "É", "x9", "ß", "Straße", "日本", "the", "of", "7"]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, say(rnd.choice([0, 1, 2, 3, 9, 10, 11, 40]))) for i in range(30)] + [(5, say(12)), (None, say(14)), (90, None), (91, "a a a a a a a a a a a a a")]
    items += [(200 + i, items[8][1]) for i in range(4)]
    docs = [(1, None), (1, ""), (None, " -- "), (None, items[3][1]), (7, "A " * 3000), (8, say(4000))]
    for i in range(80):
        t = rnd.choice(items)[1] or ""
        w = t.upper().replace("ß", "ẞ").lower().split() if i % 7 else t.split()
        cut = rnd.randint(0, max(0, len(w) - 9))
        docs.append((10 + i, say(rnd.randint(0, 30)) + rnd.choice([" ", "-", "\n\t", ", "]) + rnd.choice([" ", "_", "!?"]).join(w[cut:]) + " " + say(rnd.randint(0, 30))))
    return docs, items


@pytest.mark.parametrize("block", [1 << 17, 200])
@pytest.mark.parametrize("window, shingle", [(10, 3), (4, 1), (3, 5)])
def test_contamination(spark, monkeypatch, block, window, shingle):
    monkeypatch.setattr(decontam, "PAIRS", 50)
    docs, items = passages(1)
    bench = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    out = decontam.digested(decontam.contamination(table(spark, docs).repartition(3), bench, window, shingle, block=block))
    assert got(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == hits(docs, items, window)


def test_contamination_by_share(spark):
    """A window of which one word in the middle is changed has seven of twelve shingles."""
    item = [f"w{i}" for i in range(14)]
    other = item[:6] + ["new"] + item[7:]
    docs = table(spark, [(1, " ".join(["x", *item, "y"])), (2, " ".join(["x", *other, "y"])), (3, " ".join(item[::-1])), (4, " ".join(item[:13]))])
    bench = spark.createDataFrame([("q", " ".join(item))], "item_id string, text string")
    near = lambda share: {r["doc_id"]: (r["starts"], r["lengths"], r["items"]) for r in decontam.contamination(docs, bench, 14, 3, share).collect()}
    assert near(1.0) == {1: ([1], [14], ["q"]), 2: ([], [], []), 3: ([], [], []), 4: ([], [], [])}
    assert near(0.75) == {1: ([1], [14], ["q"]), 2: ([1], [14], ["q"]), 3: ([], [], []), 4: ([], [], [])}
    assert near(0.8)[2] == ([], [], [])
    with pytest.raises(ValueError):
        near(0)


def test_prefixes_are_rare():
    """Where all shingles are needed one is joined, the rarest; with a share of three quarters the three rarest of nine."""
    text = " ".join("abcdefghijk").encode()
    for share, prefix in ((1.0, 1), (0.75, 3)):
        block = decontam.Block([text], ["q"], 3, share)
        keys = block.keys()[3]
        n = np.arange(len(keys))[::-1] * 10
        block.order({3: (keys, n)})
        assert set(block.index[3][0].tolist()) == set(keys[np.argsort(n)[:prefix]].tolist())


# Periodic runs


def stretches(w, exponent=4, least=6):
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, exponent * q) and not any(w[i : i + n - r] == w[i + r : i + n] for r in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def edited(d, t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    h = zlib.crc32(str(d).encode()) if d is not None else 1
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    return w


def told(d, w):
    found = stretches(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2])) if found else None
    return (d, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def looped(seed, n):
    rnd = random.Random(seed)
    rows = [(0, None), (0, ""), (None, " \n"), (None, "a a a a a a a"), (1, "z " * 5), (2, "z\t" * 6), (3, "a b " * 3000), (4, " ".join(rnd.choice("abcdefgh") for _ in range(3000)))]
    for i in range(n):
        w = [rnd.choice("abé" if i % 2 else "abcdefghij") for _ in range(rnd.randint(0, 120))]
        for _ in range(rnd.randint(0, 3)):
            block = [rnd.choice("abcde\u3000") for _ in range(rnd.randint(1, 9))]
            at = rnd.randint(0, len(w))
            w[at:at] = (block * 9)[: rnd.randint(1, 7) * len(block) + rnd.randint(0, 3)]
        rows.append((i // 2 + 5, rnd.choice([" ", "\n", "  \t"]).join(w)))
    return rows


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_periodic(spark, monkeypatch):
    for held in (300_000, 500):
        monkeypatch.setattr(periodic, "HELD", held)
        rows = looped(held, 300)
        out = periodic.digested(periodic.find_runs(periodic.repeating(table(spark, rows).repartition(3))))
        assert got(out, *COLUMNS) == sorted((told(d, edited(d, t)) for d, t in rows), key=repr)


def test_runs_of_random_strings():
    rnd = random.Random(5)
    for _ in range(600):
        u = [rnd.randrange(rnd.choice([1, 2, 2, 3])) for _ in range(rnd.randint(0, 50))]
        assert sorted(zip(*(x.tolist() for x in periodic.runs(np.array(u, np.int64))))) == sorted(stretches(u, 2, 2))


def test_runs_of_a_long_period():
    block = list(range(5000))
    start, length, period = periodic.runs(np.array(block * 4))
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [20000], [5000])


def test_walks_complete_the_vocabulary():
    """Squares at marks are fewer than all squares; the walks add the others."""
    units = np.array([1, 2, 3] * 5 + [9] + [2, 3, 1] * 3 + [8])
    ranks = periodic.Ranks(units)
    tree = periodic.Tree(units, ranks)
    marks = tree.marks(*periodic.covering(ranks))
    whole = tree.vocabulary(marks)
    assert len(marks) < len(whole) and {n for _, n in whole} == {6} and len(whole) == 3


# Alignment


def brute_alignment(rows):
    tok = tokens.Pieces(tokens.read_file(queries.vocabulary("byte_bpe_50k.json"))).tokenizer
    tok.encode_special_tokens = True
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    back = {c: b for b, c in tokens.byte_letters().items()}
    each = []
    for d, t in rows:
        groups = []
        if t:
            e = tok.encode(" " + t, add_special_tokens=False)
            a, b = e.ids, sp.encode(t)
            x = [bytes(back[c] for c in p) for p in e.tokens]
            y = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in zip(b, map(sp.id_to_piece, b))]
            if b"".join(x) == b"".join(y) == (" " + t).encode():
                ends = [set(np.cumsum([len(p) for p in z]).tolist()) for z in (x, y)]
                cuts, at = sorted(ends[0] & ends[1]), [0, 0]
                where = [np.cumsum([len(p) for p in z]) for z in (x, y)]
                for c in cuts:
                    to = [int(np.searchsorted(w, c)) + 1 for w in where]
                    groups.append((a[at[0] : to[0]], b[at[1] : to[1]]))
                    at = to
        each.append((d, groups))
    count = collections.Counter(p for _, gs in each for p in {(x, y) for g, h in gs for x in g for y in h})
    top = {}
    for (x, _), n in count.items():
        top[x] = max(n, top.get(x, 0))
    out = []
    for d, gs in each:
        links = [(x, y) for g, h in gs for x in g for y in h]
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in gs)
        out.append((d, sum(len(g) for g, _ in gs), sum(len(h) for _, h in gs), len(gs), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), sha(text) if gs else ""))
    return sorted(out, key=repr)


def odd_texts():
    rnd = random.Random(8)
    rows = [(0, None), (0, ""), (None, " "), (None, "<|endoftext|> <s> </s> <0x41> hi"), (1, "a\u2581b"), (2, "a \u2581 b"), (3, "\n\n  x  y \t z\r\n "), (4, "日本語のテキスト ne  𝒳 \x00 é e\u0301"), (5, "=" * 333 + " " + "1234567" * 9), (6, "word " * 3000), (7, "x" * 700)]
    vocab = ["Hello", "unbelievable", "naïve", "don't", "I'll", "3.14159", "--", "\u201cquoted\u201d", "zzzqqq", "ﬁ", "\u00a0", "\u3000", "\u2028", "\x1c", "\x85", "a\u00adb", "<unk>", "\u0130", "🙂🙃", "العربية", "Donaudampfschifffahrt"]
    rows += [(10 + i // 2, rnd.choice([" ", " ", "  ", "\n", ""]).join(rnd.choice(vocab) for _ in range(rnd.randint(1, 40)))) for i in range(120)]
    return rows


@pytest.mark.parametrize("most", [1 << 17, 40, 0])
def test_alignment(spark, most):
    pytest.importorskip("public_tokenizers")
    rows = odd_texts()
    out = alignment.align(table(spark, rows).repartition(3), tokens.read_file(queries.vocabulary("byte_bpe_50k.json")), tokens.read_bytes(queries.vocabulary("piece_bpe_32k.model")), most)
    assert got(out, "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256") == brute_alignment(rows)


def test_components():
    number = lambda a, b: [x.tolist() for x in alignment.components(np.array(a, np.int64), np.array(b, np.int64))]
    assert number([1, 2, 5, 6], [2, 4, 6]) == [[0, 0, 1, 1], [0, 1, 1]]
    assert number([3], [1, 2, 3]) == [[0], [0, 0, 0]] and number([], []) == [[], []]
    odd, even = np.arange(1, 4001, 2), np.append(np.arange(2, 4000, 2), 3999)  # one long chain
    assert {*number(odd, even)[0], *number(odd, even)[1]} == {0, 1} or number(odd, even)[0] == [0] * 2000


def test_units_forgotten_and_long():
    """The same rows whatever is remembered."""
    pytest.importorskip("public_tokenizers")
    files = tokens.read_file(queries.vocabulary("byte_bpe_50k.json")), tokens.read_bytes(queries.vocabulary("piece_bpe_32k.model"))
    texts = [t for _, t in odd_texts()]
    plain = lambda x: [[y.tolist() if isinstance(y, np.ndarray) else y for y in c] for c in x]
    whole = plain(alignment.Aligner(*files).documents(texts))
    small = alignment.Aligner(*files, most=20, longest=6)
    for i, t in enumerate(texts):
        assert plain(small.documents([t])) == [[c[i]] for c in whole]


def test_found_in_empty_tables(spark):
    none = table(spark, [])
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(none, items).count() == 0 and periodic.find_runs(none).count() == 0
    assert decontam.digested(decontam.contamination(table(spark, [(1, "a b")]), items)).select("n_words", "n_hit", "contaminated").collect() == [(2, 0, False)]
    assert alignment.align(none, tokens.read_file(queries.vocabulary("byte_bpe_50k.json")), tokens.read_bytes(queries.vocabulary("piece_bpe_32k.model"))).count() == 0
