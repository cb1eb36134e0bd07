"""Plain words of a text, the same for corpus and evaluation material."""

from __future__ import annotations

import re
import unicodedata

ASIDE = re.compile(r"\([^()]{0,200}\)|\[[^\[\]]{0,200}\]")
BROKEN = re.compile(r"(?<=\w)[-­]\s*\n\s*(?=\w)")
WORD = re.compile(r"[^\W_]+")
MARKS = {c: None for c in range(0x300, 0x370)}


def plain(text: str) -> str:
    """Lower case without accents, asides in brackets and broken lines."""
    if "(" in text or "[" in text:
        text = ASIDE.sub(" ", text)
    if "-\n" in text or "- \n" in text or "­" in text:
        text = BROKEN.sub("", text)
    text = text.lower()
    return text if text.isascii() else unicodedata.normalize("NFKD", text).translate(MARKS)


def words(text: str | None) -> list[str]:
    return WORD.findall(plain(text)) if text else []
