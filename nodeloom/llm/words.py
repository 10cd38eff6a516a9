"""Words of a text: the maximal runs of letters after normalisation and lower-casing."""

from __future__ import annotations

import unicodedata

import regex

#: Characters removed after NFKC normalisation.
REMOVED = dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])

_letters = regex.compile(r"\p{L}+")
_ascii_letters = regex.compile(r"[a-z]+")


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if text.isascii():
        return _ascii_letters.findall(text.lower())
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return _letters.findall(text.translate(REMOVED).lower())
