"""Text helpers shared by the text operators."""

from __future__ import annotations

import re
import unicodedata

WORD = re.compile(r"[^\W_]+")
# UTF-8 read as Latin-1 or Windows-1252
_BROKEN = re.compile("[ÂÃ][\u0080-ÿŒœŠšŸŽžƒˆ˜–-…‰‹›€™]")
_END = re.compile(r"[.!?…]+[\"'”»)\]]*(?=\s|$)|;(?=\s*\n|\s*$)|\n\s*")


def words(text: str) -> list[str]:
    """Runs of letters and digits, lower case, after NFC."""
    return WORD.findall(unicodedata.normalize("NFC", text).lower())


def repaired(text: str) -> str:
    """Undo UTF-8 that was read as a single-byte code page; other characters stay."""

    def one(m: re.Match) -> str:
        for page in ("latin-1", "cp1252"):
            try:
                return m.group().encode(page).decode("utf-8")
            except UnicodeError:
                continue
        return m.group()

    return _BROKEN.sub(one, text) if "Ã" in text or "Â" in text else text


def plain(text: str) -> str:
    """Lower case without accents: a view in which damaged and missing accents agree."""
    text = unicodedata.normalize("NFKD", repaired(text).lower())
    return "".join(c for c in text if not unicodedata.combining(c))


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence without blanks around it; line breaks end one only
    after a mark, so wrapped lines stay together."""
    spans, start = [], 0
    n = len(text)
    for m in _END.finditer(text):
        if m.group()[0] == "\n":
            tail = text[start : m.start()].rstrip()
            if tail and tail[-1] not in ".!?;…:\"')]”»" and not text[m.start() : m.end()].count("\n") > 1:
                continue
        end = m.end()
        while start < end and text[start].isspace():
            start += 1
        stop = end
        while stop > start and text[stop - 1].isspace():
            stop -= 1
        if stop > start:
            spans.append((start, stop))
        start = end
    while start < n and text[start].isspace():
        start += 1
    stop = n
    while stop > start and text[stop - 1].isspace():
        stop -= 1
    if stop > start:
        spans.append((start, stop))
    return spans
