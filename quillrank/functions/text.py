"""Text as Column functions: tokens, sentences, chunks, windows, overlaps, features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD2 = r"[\p{L}\p{N}_]{2,}"
LETTERS3 = r"\p{L}{3,}"
SENTENCE_END = r"(?U)(?<=[.!?])\s+"


def let(value: Column, body) -> Column:
    """body(value) with value computed once: inside a lambda an expression would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column, pattern: str = WORD2) -> Column:
    """Lower-case runs that match pattern."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def words(text: Column) -> Column:
    """White-space tokens."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")


def punctuation_tokens(text: Column) -> Column:
    """Lower case, split at everything that is neither letter nor digit, longer than one."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) > 1)


def without_stopwords(found: Column, stopwords: list[str]) -> Column:
    return F.filter(found, lambda x: ~x.isin(*stopwords)) if stopwords else found


def german_stopwords() -> list[str]:
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("german")


def sentences(text: Column) -> Column:
    """Split after . ! ? and white space; trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.trim(F.coalesce(text, F.lit(""))), SENTENCE_END), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def protected_sentences(text: Column, citations: Column) -> Column:
    """Sentences, of which none is cut within one of the given citations (longest first)."""
    text = F.coalesce(text, F.lit(""))
    ordered = F.array_sort(citations, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    numbered = F.transform(ordered, lambda c, i: F.struct(c.alias("c"), F.concat(F.lit("\x01"), i.cast("string"), F.lit("\x02")).alias("mark")))

    def split(marks: Column) -> Column:
        hidden = F.aggregate(marks, text, lambda t, x: F.replace(t, x["c"], x["mark"]))
        return F.transform(sentences(hidden), lambda s: F.aggregate(marks, s, lambda t, x: F.replace(t, x["mark"], x["c"])))

    return let(numbered, split)


#: Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = ("Abs", "Art", "E", "Nr", "Ziff", "bzw", "ca", "etc", "usw", "vgl")


def abbreviation_sentences(text: Column) -> Column:
    """Split after . ! ? before a capital or a digit, but not after an abbreviation."""
    guarded = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?<![\p{{L}}])({'|'.join(ABBREVIATIONS)})\.", "$1\x01")
    parts = F.split(guarded, r"(?U)(?<=[.!?])\s+(?=[A-ZÄÖÜ0-9])")
    return F.filter(F.transform(parts, lambda s: F.trim(F.replace(s, F.lit("\x01"), F.lit(".")))), lambda s: s != "")


def long_sentences(text: Column, more_than: int = 30) -> Column:
    return F.filter(sentences(text), lambda s: F.length(s) > more_than)


def chunks(toks: Column, size: int, overlap: int, compat: bool = False) -> Column:
    """Windows of ``size`` tokens every size - overlap, each joined by blanks. A tail that no whole window ends with
    extends the last one; with compat it replaces it from the tail's own start, and so loses tokens."""
    if size <= 0 or overlap >= size or overlap < 0:
        raise ValueError("size must be positive and overlap in 0..size-1")
    return let(toks, lambda t: _chunks(t, size, size - overlap, compat))


def _chunks(toks: Column, size: int, step: int, compat: bool) -> Column:
    n = F.size(toks)
    count = F.greatest(F.lit(1), F.ceil((n - size) / step).cast("int") + 1)
    tail = (n > size) & (F.pmod(n - size, F.lit(step)) != 0)
    starts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * step)

    def cut(start: Column, length: Column) -> Column:
        return F.array_join(F.slice(toks, start + 1, length), " ")

    whole = F.transform(starts, lambda s: cut(s, F.lit(size)))
    last = (count - 1) * step
    fixed = cut(last, n - last) if compat else cut(last - step, n - last + step)
    shortened = F.concat(F.slice(whole, 1, F.greatest(count - 2, F.lit(0))), F.array(fixed))
    return F.when(n == 0, F.array().cast("array<string>")).when(tail, shortened).otherwise(whole)


def sentence_windows(items: Column, width: int, step: int) -> Column:
    """Windows of ``width`` items every ``step``, joined by blanks; a last partial window is merged into the one before
    it, with the items alone that it lacks."""
    return let(items, lambda x: _sentence_windows(x, width, step))


def _sentence_windows(items: Column, width: int, step: int) -> Column:
    n = F.size(items)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda i: (i + width <= n) | (i == 0))
    windows = F.transform(starts, lambda i: F.slice(items, i + 1, F.lit(width)))
    end = F.element_at(starts, -1) + width
    rest = F.slice(items, F.least(end, n) + 1, F.greatest(n - end, F.lit(0)))
    last = F.element_at(windows, -1)
    merged = F.concat(F.slice(windows, 1, F.size(windows) - 1), F.array(F.concat(last, F.filter(rest, lambda x: ~F.array_contains(last, x)))))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(merged, lambda w: F.array_join(w, " ")))


def around(items: Column, index: Column, left: int, right: int | None = None) -> Column:
    """Items index - left to index + right (0-based index) joined by blanks, within bounds."""
    right = left if right is None else right
    first = F.greatest(index - left, F.lit(0))
    return F.array_join(F.slice(items, first + 1, index + right + 1 - first), " ")


def before_and_after(items: Column, index: Column, n: int) -> tuple[Column, Column]:
    """The n items before and the n after, without the one at index."""
    first = F.greatest(index - n, F.lit(0))
    return F.array_join(F.slice(items, first + 1, index - first), " "), F.array_join(F.slice(items, index + 2, F.lit(n)), " ")


def first_with(items: Column, needle: Column) -> Column:
    """0-based index of the first item that contains needle, or null."""
    hits = F.filter(F.transform(items, lambda x, i: F.when(F.contains(x, needle), i)), lambda i: i.isNotNull())
    return F.get(hits, F.lit(0))


def evidence(items: Column, needle: Column, width: int = 2) -> Column:
    """The window around the first item with needle; without one the first 2 * width + 1 items."""
    return F.coalesce(around(items, first_with(items, needle), width), F.array_join(F.slice(items, 1, 2 * width + 1), " "))


def nearest(candidates: Column, wanted: Column) -> Column:
    """The candidate index closest to the wanted one, the smaller on a tie."""
    return F.array_min(F.transform(candidates, lambda i: F.struct(F.abs(i - wanted).alias("d"), i.alias("i"))))["i"]


#: Stands between tokens that are searched as one string.
_BETWEEN = "\x1f"


def token_window(toks: Column, needle: Column, size: int) -> Column:
    """size // 2 tokens on either side of the first place where the tokens ``needle`` stand; null without one."""
    return token_windows(toks, needle, (size,))[0]


def token_windows(toks: Column, needle: Column, sizes: tuple[int, ...]) -> Column:
    """An array with the window of each size."""
    return let(F.struct(searched(toks).alias("t"), needle.alias("n")), lambda x: windows_in(x["t"], x["n"], sizes))


def _odd(a: Column) -> Column:
    return F.contains(F.array_join(a, "", _BETWEEN), F.lit(_BETWEEN))


def searched(toks: Column) -> Column:
    """Tokens as windows_in takes them: joined to one string; as they are where that sign or a null stands among them."""

    def told(x: Column) -> Column:
        text = F.concat(F.lit(_BETWEEN), F.array_join(x["t"], _BETWEEN), F.lit(_BETWEEN))
        return F.struct(F.when(~x["odd"], text).alias("text"), F.when(x["odd"], x["t"]).alias("toks"))

    return let(toks, lambda t: F.when(F.size(t) > 0, let(F.struct(t.alias("t"), _odd(t).alias("odd")), told)))


def windows_in(tokens: Column, needle: Column, sizes: tuple[int, ...]) -> Column:
    """token_windows of searched tokens, which are made once for many needles."""
    return let(F.struct(tokens.alias("t"), needle.alias("n")), lambda x: _token_windows(x["t"], x["n"], sizes))


def _token_windows(tokens: Column, needle: Column, sizes: tuple[int, ...]) -> Column:
    """The place is sought as a string, with a sign on both sides of each token; arrays in which that sign or a null stands are
    compared slice by slice."""
    text = tokens["text"]
    sought = F.concat(F.lit(_BETWEEN), F.array_join(needle, _BETWEEN), F.lit(_BETWEEN))

    def cut(x: Column, size: int) -> Column:
        # One sign more than tokens, on the side of the needle; where there are fewer, the outermost sign is no token's.
        left = let(F.substring_index(x["before"], _BETWEEN, -(size // 2 + 1)), lambda y: F.when(y == x["before"], F.substring(y, 2, 1 << 30)).otherwise(y))
        right = let(F.substring_index(x["after"], _BETWEEN, size // 2 + 1), lambda y: F.when(y == x["after"], F.substring(y, F.lit(1), F.length(y) - 1)).otherwise(y))
        return F.translate(F.concat(left, x["middle"], right), _BETWEEN, " ")

    def around(x: Column) -> Column:
        n = F.length(x["sought"])
        before = F.substring(x["text"], F.lit(1), x["at"])
        after = F.substring(x["text"], x["at"] + n - 1, F.length(x["text"]))
        middle = F.substring(x["sought"], F.lit(2), n - 2)
        return let(F.struct(before.alias("before"), after.alias("after"), middle.alias("middle")), lambda y: F.array(*[cut(y, s) for s in sizes]))

    none = F.array(*[F.lit(None).cast("string") for _ in sizes])
    placed = lambda y: let(F.struct(y["text"].alias("text"), y["sought"].alias("sought"), F.call_function("locate", y["sought"], y["text"]).alias("at")), lambda x: F.when(x["at"] > 0, around(x)).otherwise(none))
    fast = let(F.struct(text.alias("text"), sought.alias("sought")), placed)
    # Where only the needle is odd, it doesn't stand in the tokens.
    slow = F.array(*[_slice_window(tokens["toks"], needle, s) for s in sizes])
    return F.when((F.size(needle) > 0) & tokens.isNotNull(), F.when(tokens["toks"].isNotNull(), slow).when(_odd(needle), none).otherwise(fast)).otherwise(none)


def _slice_window(toks: Column, needle: Column, size: int) -> Column:
    k = F.size(needle)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(toks) - k, F.lit(0))), lambda i: F.slice(toks, i + 1, k) == needle)
    at = F.get(starts, F.lit(0))
    first = F.greatest(at - size // 2, F.lit(0))
    return F.array_join(F.slice(toks, first + 1, at + k + size // 2 - first), " ")


def leading_facts(items: Column, has_citation: Column) -> Column:
    """Items before the first one that cites; "none" if there are none. has_citation: array of booleans."""
    at = F.array_position(has_citation, True)
    lead = F.when(at > 0, F.slice(items, 1, at.cast("int") - 1)).otherwise(items)
    return F.coalesce(F.nullif(F.array_join(lead, " "), F.lit("")), F.lit("none"))


def bigrams(text: Column) -> Column:
    def pairs(t: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2))))

    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.length(t) < 2, F.array().cast("array<string>")).otherwise(let(t, pairs))


def ngrams(toks: Column, n: int) -> Column:
    """Each n successive tokens, joined by blanks; none of fewer."""

    def grams(t: Column) -> Column:
        return F.when(F.size(t) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), " ")))

    return let(toks, grams)


def jaccard(a: Column, b: Column) -> Column:
    """Of two distinct arrays; 0 if either is empty."""
    inter = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(inter / (F.size(a) + F.size(b) - inter))


def coverage(query: Column, text: Column) -> Column:
    """Share of the query's distinct white-space tokens that the text has; 0 without any."""
    q = F.array_distinct(words(F.lower(query)))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, words(F.lower(text)))) / F.size(q))


def keyword_count(text: Column, keywords: list[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.contains(low, F.lit(k)).cast("int") for k in keywords), F.lit(0))


def occurrences(text: Column, needle: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def query_features(q: Column) -> dict[str, Column]:
    n = F.size(words(q))
    return {
        "n_tokens": n,
        "n_chars": F.length(q),
        "is_short": (n < 10).cast("int"),
        "is_long": (n > 40).cast("int"),
        "has_question": F.contains(q, F.lit("?")).cast("int"),
        "n_commas": occurrences(q, ","),
        "n_quotes": occurrences(q, '"'),
        "has_art": q.rlike(r"(?i)Art\.?\s*\d").cast("int"),
        "has_bge": q.rlike(r"(?i)BGE\s+\d").cast("int"),
        "has_digit": q.rlike(r"\d").cast("int"),
    }


def packed(items: Column, most: int = 500) -> Column:
    """Items packed greedily, in order, into strings of at most ``most`` characters; a longer item stands alone."""
    none = F.array().cast("array<string>")

    def put(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (F.length(last) + 1 + F.length(x) <= most)
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, F.lit(" "), x)))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(items, none, put)


def permutation(reply: Column, n: int) -> Column:
    """[i] in a reply, 1-based, each once and in range, followed by the missing ones."""
    given = F.transform(F.regexp_extract_all(reply, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))
    good = F.array_distinct(F.filter(given, lambda x: (x >= 1) & (x <= n)))
    return F.concat(good, F.array_except(F.sequence(F.lit(1), F.lit(n)), good))


def numbered_list(reply: Column) -> Column:
    """What follows the first full stop of each line that has one, trimmed."""
    lines = F.filter(F.split(reply, "\n"), lambda x: F.contains(x, F.lit(".")))
    return F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^[^.]*\.", ""))), lambda x: x != "")


def with_context(context: Column, question: Column) -> Column:
    return F.concat_ws("\n\n", context, question)


def split_context(query: Column) -> tuple[Column, Column]:
    """(context, question): cut at the last blank line; without one all is question."""
    return F.when(F.contains(query, F.lit("\n\n")), F.regexp_extract(query, r"(?s)^(.*)\n\n", 1)).otherwise(F.lit("")), F.substring_index(query, "\n\n", -1)


def document_text(citation: Column, title: Column, text: Column) -> Column:
    one = lambda c: F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\s+", " ")
    return F.format_string("# %s\n## %s\n%s", one(citation), one(title), one(text))


def listed(text: Column, separator: str = ";") -> Column:
    """The items of a list in one string, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), separator), lambda x: F.trim(x)), lambda x: x != "")


def context(text: Column, citation: Column, width: int = 2) -> Column:
    """The sentences around the first one that holds the citation, or the citation with blanks for underscores; the whole text
    without any."""

    def around_it(x: Column) -> Column:
        spaced = F.replace(x["c"], F.lit("_"), F.lit(" "))
        at = F.coalesce(first_with(x["s"], x["c"]), first_with(x["s"], spaced))
        return F.coalesce(around(x["s"], at, width), x["t"])

    return let(F.struct(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), SENTENCE_END).alias("s"), citation.alias("c"), text.alias("t")), around_it)


def in_parentheses(text: Column, citation: Column, head: int = 6, most: int = 200) -> Column:
    """Whether parentheses of at most ``most`` characters hold the first letters of the citation."""
    inside = F.regexp_extract_all(text, F.lit(rf"\(([^)]{{0,{most}}})\)"), F.lit(1))
    return F.exists(inside, lambda x: F.contains(F.lower(x), F.lower(F.substring(citation, 1, head))))


#: Words by which a query's intent and field are told.
INTENTS = {
    "q_is_procedural": ["verfahren", "zuständigkeit", "frist", "rechtsmittel", "beschwerde", "klage", "antrag"],
    "q_is_substantive": ["haftung", "schadenersatz", "vertrag", "eigentum", "strafe", "verjährung", "anspruch"],
    "q_is_interpretive": ["auslegung", "analog", "sinn", "zweck", "ratio", "bedeutung", "begrif"],
    "q_domain_criminal": ["straf", "delikt", "täter", "opfer", "schuld"],
    "q_domain_civil": ["vertrag", "schuld", "eigentum", "miete", "kauf"],
    "q_domain_admin": ["verwaltung", "behörde", "bewilligung", "verfügung"],
}


def query_intents(q: Column) -> dict[str, Column]:
    return {k: (keyword_count(q, words) > 0).cast("int") for k, words in INTENTS.items()}


def german_stem(word: str) -> str:
    """The stem of a lower-case German word by the published Snowball rules."""
    vowels = "aeiouyäöü"
    w = word.replace("ß", "ss")
    marked = ""
    for c, following in zip(w, w[1:] + " ", strict=True):  # u and y between vowels are none
        marked += c.upper() if c in "uy" and marked[-1:] in tuple(vowels) and following in vowels else c
    w = marked

    def region(start: int) -> int:
        i = start
        while i < len(w) and w[i] not in vowels:
            i += 1
        while i < len(w) and w[i] in vowels:
            i += 1
        return min(i + 1, len(w))

    r1 = region(0)
    r2 = region(r1)
    r1 = max(r1, min(3, len(w)))

    def ending(*suffixes: str) -> str:
        return max((x for x in suffixes if w.endswith(x)), key=len, default="")

    end = ending("em", "ern", "er", "e", "en", "es", "s")
    if end and len(w) - len(end) >= r1 and (end != "s" or w[-2:-1] in tuple("bdfghklmnrt")):
        w = w[: -len(end)]
        if end in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    end = ending("en", "er", "est", "st")
    if end and len(w) - len(end) >= r1 and (end != "st" or (w[-3:-2] in tuple("bdfghklmnt") and len(w) >= 6)):
        w = w[: -len(end)]
    end = ending("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit")
    if end and len(w) - len(end) >= r2:
        if end in ("end", "ung"):
            w = w[: -len(end)]
            if w.endswith("ig") and not w.endswith("eig") and len(w) - 2 >= r2:
                w = w[:-2]
        elif end in ("ig", "ik", "isch"):
            if w[-len(end) - 1 : -len(end)] != "e":
                w = w[: -len(end)]
        elif end in ("lich", "heit"):
            w = w[: -len(end)]
            if w.endswith(("er", "en")) and len(w) - 2 >= r1:
                w = w[:-2]
        else:
            w = w[: -len(end)]
            more = next((x for x in ("lich", "ig") if w.endswith(x)), "")
            if more and len(w) - len(more) >= r2:
                w = w[: -len(more)]
    return w.lower().replace("ä", "a").replace("ö", "o").replace("ü", "u")

