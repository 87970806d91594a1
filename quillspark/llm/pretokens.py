"""Splitting of texts as the public tokenizers split them, by chunk where that is exact."""

from __future__ import annotations

import re

import regex

#: Letters, numbers and white space below U+0250, where both engines and all Unicode versions agree.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\\t-\\r \\x85\xa0"
_BEYOND = re.compile("[^\x00-\u024f]")
_FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
_RUN = re.compile(r"[\s\x1c-\x1f]{2}")


def byte_level(text: str, pattern: str) -> list[str]:
    """All matches of the byte-level splitter `pattern`; they cover the text."""
    return regex.findall(pattern, text) if _BEYOND.search(text) else _FAST.findall(text)


def spaced_pieces(text: str) -> list[str] | None:
    """The text cut before each blank, or None if it has two white-space characters in a row.

    Without such runs the byte-level splitter's matches never cross the cuts, so that pieces can be split alone.
    """
    return None if _RUN.search(text) else text.split(" ")


def lower_words(chunk: str) -> list[str] | None:
    """Matches of the lower-casing word splitter in a chunk without white space; None if it needs the library."""
    return None if _BEYOND.search(chunk) else _WORDS.findall(chunk.lower())
