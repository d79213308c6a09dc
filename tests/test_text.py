from pyspark.sql import functions as F

from quillrank.functions import citations as C
from quillrank.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_extract(spark):
    t = "Gemäss Art. 41 Abs. 1 OR und SR 220 Art. 47 sowie BGE 145 II 32 E. 3 gilt."
    assert one(spark, t, C.extract) == sorted(["Art. 41 Abs. 1 OR", "Art. 47 sowie", "SR 220 Art. 47", "BGE 145 II 32 E. 3"])
    assert one(spark, None, C.extract) == []
    spans = one(spark, t, lambda c: C.extract_spans(c, "strict"))
    assert all(t[s["start"] : s["end"]] == s["text"] for s in spans) and len(spans) == 4


def test_parse_and_normal(spark):
    norm = lambda c: C.normal(C.parse(c))
    assert one(spark, "SR 220 Art. 47", norm) == "Art. 47 220"
    assert one(spark, "Art. 41  Abs. 1 lit. a OR", norm) == "Art. 41 Abs. 1 lit. a OR"
    assert one(spark, "BGE 145 II 32 E. 3.1", norm) == "BGE 145 II 32 E. 3.1"
    assert one(spark, "5A_800/2019 E 2.1", norm) == "5A_800/2019 E 2.1"
    assert one(spark, "nichts", norm) is None


def test_codec(spark):
    assert one(spark, "Art. 228 Abs. 1 StPO", lambda c: C.decode_token(C.encode_token(c))) == "Art. 228 Abs. 1 StPO"


def test_chunks(spark):
    toks = [f"t{i}" for i in range(9)]
    assert one(spark, toks, lambda c: T.chunks(c, 4, 1), "array<string>") == ["t0 t1 t2 t3", "t3 t4 t5 t6 t7 t8"]
    assert one(spark, toks, lambda c: T.chunks(c, 4, 1, compat=True), "array<string>") == ["t0 t1 t2 t3", "t6 t7 t8"]
    assert one(spark, toks[:3], lambda c: T.chunks(c, 4, 1), "array<string>") == ["t0 t1 t2"]
    assert one(spark, [], lambda c: T.chunks(c, 4, 1), "array<string>") == []


def test_sentence_windows(spark):
    assert one(spark, list("ABCDEFG"), lambda c: T.sentence_windows(c, 4, 2), "array<string>") == ["A B C D", "C D E F G"]


def test_sentences(spark):
    t = "Es gilt Art. 41 Abs. 1 OR. Danach nichts!  Ende"
    assert one(spark, t, lambda c: T.protected_sentences(c, C.extract(c))) == ["Es gilt Art. 41 Abs. 1 OR.", "Danach nichts!", "Ende"]
    assert one(spark, "Nach Art. 5 gilt es. Dann vgl. Abs. 2 hier.", T.abbreviation_sentences) == ["Nach Art. 5 gilt es.", "Dann vgl. Abs. 2 hier."]


def test_windows_and_lists(spark):
    assert one(spark, list("abcde"), lambda c: T.around(c, F.lit(1), 2), "array<string>") == "a b c d"
    assert one(spark, [1, 4, 6], lambda c: T.nearest(c, F.lit(5)), "array<int>") == 4
    assert one(spark, "[2] > [9] > [2] > [1]", lambda c: T.permutation(c, 3)) == [2, 1, 3]
    assert one(spark, "1. eins\n2. zwei\nkein", T.numbered_list) == ["eins", "zwei"]
    assert one(spark, list("abcabd"), lambda c: T.token_window(c, F.array(F.lit("a"), F.lit("b"), F.lit("d")), 2), "array<string>") == "c a b d"
    assert one(spark, ["aa", "bb", "cc"], lambda c: T.packed(c, 5), "array<string>") == ["aa bb", "cc"]


def test_no_break_spaces(spark):
    """Court texts set them between an abbreviation and its number."""
    from pyspark.sql import functions as F

    from quillrank.functions import citations as C
    from quillrank.functions import text as T

    b = "\u00a0"
    text = f"Gem\u00e4ss Art.{b}41{b}OR gilt das.{b}Siehe BGE{b}145{b}II\u202f32 E.{b}3 und SR{b}220 Art.{b}47."
    row = spark.createDataFrame([(text,)], "t string").select(
        C.extract(F.col("t")).alias("all"), C.extract(F.col("t"), "classifier").alias("bounded"), T.sentences(F.col("t")).alias("s"),
        C.normal(C.parse(F.lit(f"Art.{b}41{b}Abs.{b}2{b}OR"))).alias("n"), C.collapse(F.lit(f"{b}a{b} b")).alias("c"), C.type_flags(F.lit(f"BGE{b}145"))["is_bge"].alias("bge"),
    ).first()
    assert row["all"] == sorted([f"Art.{b}41{b}OR", f"BGE{b}145{b}II\u202f32 E.{b}3", f"SR{b}220 Art.{b}47"]) and f"Art.{b}41{b}OR" in row["bounded"]
    assert len(row["s"]) == 5 and row["n"] == "Art. 41 Abs. 2 OR" and row["c"] == "a b" and row["bge"]


def test_token_window_of_long_texts(spark):
    """The place is found in one pass over the tokens: in less than half of the time of comparing a slice at every place."""
    import time

    words = [chr(ord("a") + i) for i in range(20)]
    needle = F.array(*[F.lit(x) for x in words])
    long = spark.range(200).select(F.concat(F.transform(F.sequence(F.lit(0), F.lit(20000)), lambda i: (i % 7).cast("string")), needle, F.array(F.concat(F.lit("z"), F.col("id")))).alias("t")).localCheckpoint()

    def took(window):
        began = time.time()
        assert {r[0] for r in long.select(window(F.col("t"), needle, 4).alias("w")).collect()} == {f"0 1 {' '.join(words)} z{i}" for i in range(200)}
        return time.time() - began

    def slices(t, n, size):
        at = lambda x: F.get(F.filter(F.sequence(F.lit(0), F.size(x) - 20), lambda i: F.slice(x, i + 1, 20) == n), F.lit(0))
        return T.let(t, lambda x: T.let(at(x), lambda a: F.array_join(F.slice(x, a - 1, 24), " ")))

    took(T.token_window)
    assert took(T.token_window) < took(slices) / 2


def test_token_window_of_odd_tokens(spark):
    kind = "array<string>"
    window = lambda needle: lambda c: T.token_window(c, F.array(*[F.lit(x) for x in needle]), 2)
    assert one(spark, ["", "a", "", "b"], window(["a"]), kind) == " a "
    assert one(spark, ["a\x1fb", "a", "b"], window(["b"]), kind) == "a b" and one(spark, ["aa", "a"], window(["a"]), kind) == "aa a"
    assert one(spark, [], window([""]), kind) is None and one(spark, ["a"], window(["b"]), kind) is None and one(spark, ["x", None, "b", "c"], window(["b"]), kind) == "b c"


def test_tokens_are_joined_once_for_many_needles(spark):
    """Windows of all sizes are cut from tokens that were joined before, and rows that are distinct aren't shuffled again."""
    from quillrank.plans import base, texts  # noqa: F401

    df = spark.createDataFrame([(["a", "b", "c", "d"],), (["a\x1f", "b", None, "c"],), ([],), (None,)], "t array<string>")
    for needle in (["b"], ["b", "c"], ["x"], ["a\x1f"]):
        n = F.array(*[F.lit(x) for x in needle])
        got = df.select(T.searched(F.col("t")).alias("s"), "t").select(T.windows_in(F.col("s"), n, (2, 4)).alias("w"), F.array(T.token_window(F.col("t"), n, 2), T.token_window(F.col("t"), n, 4)).alias("x")).collect()
        assert all(r["w"] == r["x"] for r in got)
    plan = base.QUERIES["token_window"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1
