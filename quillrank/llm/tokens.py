"""Exact token ids of a public tokenizer's file, at the cost of a dictionary lookup a word.

The tokenizers library gives the ids; this module only remembers them. A text is cut in one pass into the pieces
that the file's own pre-tokenizer makes, whose ids do not depend on their neighbours and are kept in a bounded
dictionary of the worker. (Pieces and not words between blanks: a word has many forms with signs beside it.) A text
with a character outside a checked range, with a special token or of another kind of file goes through the library's
own normalizer and pre-tokenizer instead, whose pieces have a dictionary of their own.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Latin letters, digits and signs for which Python's re, str.lower and the library agree (no U+00AD, no
#: superscript digits or fractions, no U+0130).
_SAFE = [0x0A, *range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0xB2), *range(0xB4, 0xB9), 0xBA, 0xBB, *range(0xBF, 0x130), *range(0x131, 0x250)]
_ODD = np.ones(1 << 16, bool)
_ODD[_SAFE] = False
#: The same characters and their small forms by kind: a class of given characters is searched faster than one of kinds, and
#: letters come first, as no other branch begins with one.
_CHARS = sorted({x for c in map(chr, _SAFE) for x in (c, *c.lower())})
_LETTERS, _SIGNS = (f"[{''.join(re.escape(c) for c in _CHARS if re.fullmatch(kind, c))}]" for kind in (r"[^\W\d_]", r"_|[^\s\w]"))
_WORDS = re.compile(rf"{_LETTERS}+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|{_SIGNS}+")
_SPACED = re.compile(rf" ?{_LETTERS}+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?{_SIGNS}+|\s+(?!\S)|\s+")
_WORD_FILE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(1)
def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself if printable, else the next free one from U+0100."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = (b for b in range(256) if b not in set(keep))
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(free)}


def plain(text: str) -> bool:
    return "<|" not in text and not _ODD[np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")].any()


def as_letters(piece: str) -> str:
    if piece.isascii() and piece.isprintable():
        return piece.replace(" ", "\u0120")
    return piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(byte_letters())


class Remembered(dict):
    """A dictionary that makes what it lacks and starts anew when it holds ``most`` entries."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = value = self.make(key)
        return value


class Recent(Remembered):
    """The same, but when it is full it keeps what it holds as an older half, from which entries come back when they are asked
    for: frequent ones are made once. It holds at most twice ``most`` entries."""

    def __init__(self, make: Callable, most: int):
        super().__init__(make, most)
        self.before: dict = {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


class Pieces:
    """Cuts texts as one tokenizers file does. style: "words" (lower case, white space dropped), "spaced"
    (a blank belongs to the word after it) or "other"."""

    def __init__(self, file: str):
        """file: the JSON text of the tokenizers file."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(file)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        pre = spec.get("pre_tokenizer") or {}
        parts = pre.get("pretokenizers", [])
        if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not spec["normalizer"]:
            self.style = "spaced"
        elif len(parts) == 2 and parts[0].get("pattern") == {"Regex": _WORD_FILE} and parts[0]["invert"] and parts[1]["type"] == "ByteLevel" and not parts[1]["use_regex"]:
            self.style = "words"
        else:
            self.style = "other"
        if any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec["added_tokens"]):
            raise ValueError("added tokens with rules of their own aren't supported")

    def units(self, text: str) -> list[str] | None:
        """The units of a plain text; None if the library has to cut it."""
        if self.style == "words":
            return text.lower().split() if plain(text) else None
        if self.style == "spaced" and text and not text[-1].isspace() and not any(x in text for x in ("  ", " \n", "\n ", "\n\n")) and plain(text):
            return f"\x01{text}".replace("\n", " \x00").split(" ")
        return None

    def of_plain(self, text: str) -> list[str] | None:
        """The pieces of a plain text as they stand in it, without byte_letters; None if the library has to cut it."""
        if self.style == "other" or not plain(text):
            return None
        return _WORDS.findall(text.lower()) if self.style == "words" else _SPACED.findall(text)

    def of_unit(self, unit: str) -> list[str]:
        """The pieces of a unit, in the letters of byte_letters."""
        if self.style == "words":
            return [as_letters(p) for p in _WORDS.findall(unit)]
        head = {"\x00": "\n", "\x01": ""}.get(unit[:1])
        return [as_letters(p) for p in _SPACED.findall(f" {unit}" if head is None else head + unit[1:])]

    def of_text(self, text: str) -> list[str | int]:
        """The pieces of any text by the library's own normalizer and pre-tokenizer; a special token is its id."""
        out: list[str | int] = []
        for part in self.marks.split(text) if self.marks else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                norm = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
                out += [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(norm)]
        return out


class Encoder:
    """ids(text): what encode(text, add_special_tokens=False).ids of the library gives, as little-endian
    unsigned 32-bit integers in bytes."""

    def __init__(self, file: str, plain: int = 100_000, pieces: int = 100_000):
        self.cut = Pieces(file)
        self.model = self.cut.tokenizer.model
        self.pieces = Remembered(self._piece, pieces)
        self.plain = Recent(lambda p: self._piece(as_letters(p)), plain)

    def _piece(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if (found := self.cut.of_plain(text)) is not None:
            return b"".join(map(self.plain.__getitem__, found))
        if self.cut.style == "other":
            return np.array(self.cut.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join([np.array([p], "<u4").tobytes() if isinstance(p, int) else self.pieces[p] for p in self.cut.of_text(text)])


@lru_cache(2)
def encoder(file: str) -> Encoder:
    """The worker's encoder of a file; tasks of one worker share what it remembers."""
    return Encoder(file)


def read_file(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def read_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()
