"""Citations in text as Column functions: finding, parsing, normalising.

There are three families: SR (a collection number, with or without an article), BGE (volume, part, page, with or
without a consideration) and Art (article, paragraphs, law). Dialects differ in the Art family and in case; "wide" is this
library's own, which also takes longer collection numbers and articles without a blank.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The grammar of each family and dialect.
SR = r"SR\s*\d{3}(?:\.\d+)?(?:\s+Art\.?\s*\d+[a-z]?)?"
BGE = r"BGE\s+\d{1,3}\s+[IVX]+[a-z]?\s+\d+(?:\s+E\.\s*\d+[a-z]?)?"
ART = {
    "loose": r"Art\.?\s+\d+[a-z]?\s+(?:Abs\.?\s*\d+\s+)*(?:[A-Z][a-zA-ZäöüÄÖÜß0-9]*)",
    "strict": r"Art\.?\s+\d+[a-z]?\s+(?:Abs\.?\s*\d+\s+)?[A-Z]{2,}",
    "ranker": r"Art\.?\s+\d+[a-z]?\s+(?:Abs\.?\s*\d+\s+)*(?:[A-Z][a-zA-ZäöüÄÖÜß0-9]*)",
    "classifier": r"Art\.?\s+\d+[a-z]?\s+(?:Abs\.?\s*\d+\s+)?[A-Z]{2,}",
}
#: Dialects that ignore case, and the one whose matches begin and end at word boundaries.
ANY_CASE = {"loose", "strict", "wide"}
BOUNDED = {"classifier"}
#: This library's own dialect.
WIDE = {"sr": r"SR\s*\d{3}(?:\.\d+)*(?:\s+Art\.?\s*\d+[a-z]?)?", "art": r"Art\.?\s*\d+[a-z]?(?:\s+Abs\.?\s*\d+)*\s+[A-Za-zÄÖÜäöü][\p{L}\p{N}_]*"}
FAMILIES = ("art", "sr", "bge")


def pattern(family: str, dialect: str = "loose") -> str:
    own = {"sr": SR, "bge": BGE} | ({"art": ART[dialect]} if dialect != "wide" else WIDE)
    body = rf"\b(?:{own[family]})\b" if dialect in BOUNDED else own[family]
    return f"(?iU){body}" if dialect in ANY_CASE else f"(?U){body}"  # U: no-break spaces are white space too


def found(text: Column, family: str, dialect: str = "loose") -> Column:
    """All matches of a family, in order, with repeats."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern(family, dialect)), F.lit(0))


def extract(text: Column, dialect: str = "loose") -> Column:
    """The distinct citations of a text, sorted; none for null."""
    return F.array_sort(F.array_distinct(F.concat(*[found(text, f, dialect) for f in FAMILIES])))


def extract_typed(text: Column, dialect: str = "strict") -> Column:
    """Distinct (text, type), sorted."""

    def typed_as(family: str) -> Column:
        return F.transform(found(text, family, dialect), lambda x: F.struct(x.alias("text"), F.lit(family).alias("type")))

    typed = [typed_as(f) for f in FAMILIES]
    return F.array_sort(F.array_distinct(F.concat(*typed)))


def extract_spans(text: Column, dialect: str = "strict") -> Column:
    """(text, start, end) of every match, 0-based by code points: each match of a family is sought from the end of the
    one before it."""
    text = F.coalesce(text, F.lit(""))

    def spans(family: str) -> Column:
        none = F.array().cast("array<struct<text:string,start:int,end:int>>")
        state = F.struct(none.alias("got"), F.lit(1).alias("at"))

        def put(s: Column, x: Column) -> Column:
            at = F.call_function("locate", x, text, s["at"])
            one = F.struct(x.alias("text"), (at - 1).cast("int").alias("start"), (at - 1 + F.length(x)).cast("int").alias("end"))
            return F.struct(F.concat(s["got"], F.array(one)).alias("got"), (at + F.length(x)).cast("int").alias("at"))

        return F.aggregate(found(text, family, dialect), state, put, lambda s: s["got"])

    return F.array_sort(F.array_distinct(F.concat(*[spans(f) for f in FAMILIES])))


def collapse(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


#: Article first, number first, decisions by volume, decisions by docket; the groups of the first are article,
#: paragraph, letter, number, law, those of the second law, article, paragraph, letter, number.
ARTICLE_FIRST = r"(?iU)Art\.?\s*(\d+[a-zA-Z]?)(?:\s*Abs\.?\s*(\d+))?(?:\s*lit\.?\s*([a-z]))?(?:\s*Ziff\.?\s*(\d+))?\s*([A-Z]{2,}|\d{3}(?:\.\d+)?)"
NUMBER_FIRST = r"(?iU)SR\s*(\d{3}(?:\.\d+)?)(?:\s+Art\.?\s*(\d+[a-zA-Z]?))?(?:\s*Abs\.?\s*(\d+))?(?:\s*lit\.?\s*([a-z]))?(?:\s*Ziff\.?\s*(\d+))?"
DECISION = r"(?iU)^BGE\s*\d+\s*[I]{1,3}\s*\d+(?:\s*E\.?\s*\d+(?:\.\d+)*)?"
DOCKET = r"(?iU)^\b\d+[A-Z]_?\d+/\d+\s+E\.?\s*\d+(?:\.\d+)*\b"


def parse(citation: Column) -> Column:
    """struct(kind, art, abs, lit, ziff, law, raw): kind "law", "bge" or "docket", tried in this order, an article before a
    number; null if it is none."""
    c = F.regexp_replace(citation, r"(?U)^\s+|\s+$", "")
    names = ("art", "abs", "lit", "ziff", "law")

    def law(rx: str, groups: tuple[int, ...]) -> Column:
        return F.struct(F.lit("law").alias("kind"), *[F.nullif(F.regexp_extract(c, rx, g), F.lit("")).alias(n) for n, g in zip(names, groups, strict=True)], c.alias("raw"))

    def case(kind: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), *[F.lit(None).cast("string").alias(n) for n in names], c.alias("raw"))

    return F.when(c.rlike(ARTICLE_FIRST), law(ARTICLE_FIRST, (1, 2, 3, 4, 5))).when(c.rlike(NUMBER_FIRST), law(NUMBER_FIRST, (2, 3, 4, 5, 1))).when(c.rlike(DECISION), case("bge")).when(c.rlike(DOCKET), case("docket"))


def normal(parsed: Column) -> Column:
    """Art. a Abs. b lit. c Ziff. d LAW, without the parts that are absent; a case as it stands."""
    parts = [F.when(parsed[k].isNotNull(), F.concat(F.lit(label), parsed[k])) for k, label in (("art", "Art. "), ("abs", "Abs. "), ("lit", "lit. "), ("ziff", "Ziff. "))]
    return F.when(parsed["kind"] != "law", parsed["raw"]).when(parsed.isNotNull(), F.concat_ws(" ", *parts, parsed["law"]))


def granularity(parsed: Column) -> Column:
    """2 for a paragraph, 1 for a letter, 1 for a number."""
    return F.when(parsed["abs"].isNotNull(), 2).otherwise(0) + F.when(parsed["lit"].isNotNull(), 1).otherwise(0) + F.when(parsed["ziff"].isNotNull(), 1).otherwise(0)


def is_sr(law: Column) -> Column:
    return law.rlike(r"^[0-9.]+$")


def type_flags(citation: Column) -> dict[str, Column]:
    return {"is_bge": citation.rlike(r"(?iU)^BGE\s+\d"), "is_art": citation.rlike(r"(?iU)^Art\.?\s*\d"), "is_sr": citation.rlike(r"(?iU)^SR\s*\d")}


def _longest_first(citations: Column) -> Column:
    return F.array_sort(citations, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))


def normalise_sr(text: Column, dialect: str = "loose") -> Column:
    """Every SR citation replaced by its normal form, longest first."""
    seen = _longest_first(F.array_distinct(found(text, "sr", dialect)))
    return F.aggregate(seen, text, lambda t, c: F.replace(t, c, F.coalesce(normal(parse(c)), c)))


def without_citations(text: Column, dialect: str = "loose") -> Column:
    """The text without its citations, longest first."""
    return F.aggregate(_longest_first(extract(text, dialect)), text, lambda t, c: F.replace(t, c, F.lit("")))


def annotated(text: Column, titles: Column) -> Column:
    """Law ids in the text followed by their titles: titles is an array of (id, title)."""
    return F.aggregate(titles, text, lambda t, x: F.replace(t, x["id"], F.concat(x["id"], F.lit(" ("), x["title"], F.lit(")"))))


#: Marks around an encoded citation.
OPEN, CLOSE = "⟦", "⟧"


def encode_token(citation: Column) -> Column:
    """A citation as one token, blanks as underscores between marks."""
    return F.concat(F.lit(OPEN), F.replace(citation, F.lit(" "), F.lit("_")), F.lit(CLOSE))


def decode_token(token: Column) -> Column:
    """The inverse; an error for anything else."""
    good = token.startswith(OPEN) & token.endswith(CLOSE)
    inner = F.regexp_replace(token, f"^{OPEN}|{CLOSE}$", "")
    return F.when(good, F.replace(inner, F.lit("_"), F.lit(" "))).otherwise(F.raise_error(F.lit("not an encoded citation")).cast("string"))


def tokens_in(text: Column) -> Column:
    """The encoded citations of a text, in order; one never holds another's opening mark."""
    return F.regexp_extract_all(text, F.lit(f"{OPEN}[^{OPEN}{CLOSE}]*{CLOSE}"), F.lit(0))
