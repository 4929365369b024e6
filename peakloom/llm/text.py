"""Plain words from texts in any dress."""

from __future__ import annotations

import html
import re
import unicodedata

_TWICE = re.compile("[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]{1,3}")
#: What a tag holds after its name: attributes with values, of any number and length, or anything short on one line.
_REST = r"(?:(?:\s+[\w:.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>=]+)(?:\s+[\w:.-]+(?=[\s/>]))?)++\s*/?|[^<>\n]{0,200})>"
#: Tags inside a line; all others end a word.
_INLINE = re.compile(rf"</?(?:a|abbr|b|code|em|font|i|mark|s|small|span|strong|sub|sup|tt|u)\b{_REST}", re.IGNORECASE)
_TAG = re.compile(rf"</?[A-Za-z][\w:-]*{_REST}")
_MARKS = re.compile("[" + "".join(c for c in map(chr, range(0x300, 0x20000)) if unicodedata.combining(c)) + "]+")
_HIDDEN = re.compile("[­᠎​-‏⁠﻿‪-‮]")
_BROKEN = re.compile(r"[-‐‑][ \t]*\r?\n[ \t>|]*")
_QUOTE = re.compile(r"(?m)^[ \t]*(?:>[ \t]*)+")


def _mend(m: re.Match) -> str:
    for code in ("latin-1", "cp1252"):
        try:
            return m.group().encode(code).decode("utf-8")
        except UnicodeError:
            pass
    return m.group()


def _uncommented(text: str) -> str:
    """Without comments of markup, however long; one that isn't closed stays."""
    out, at = [], 0
    while (begin := text.find("<!--", at)) >= 0 and (end := text.find("-->", begin + 4)) >= 0:
        out.append(text[at:begin])
        at = end + 3
    return " ".join([*out, text[at:]])


def mend(text: str) -> str:
    """Bytes that were read in the wrong encoding put right, entities resolved, tags and invisible characters dropped."""
    if not text.isascii():
        text = _TWICE.sub(_mend, text)
        text = _HIDDEN.sub("", text)
    if "&" in text:
        text = html.unescape(text)
        text = _HIDDEN.sub("", text)
    if "<" in text:
        if "<!--" in text:
            text = _uncommented(text)
        text = _TAG.sub(" ", _INLINE.sub("", text))
    return text


def words(text: str | None) -> list[str]:
    """The words of a text: between blanks, without letter case, accents, punctuation, typography and markup.

    A number with its decimals is one word; a word divided at a line's end is whole again; None and empty texts have none.
    """
    if not text:
        return []
    text = mend(text)
    if "\n" in text:
        text = _BROKEN.sub("", text)
        if ">" in text:
            text = _QUOTE.sub("", text)
    if text.isascii():
        text = text.casefold()
    else:
        text = unicodedata.normalize("NFKD", text).casefold()
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    out = []
    for w in text.split():
        if not w.isalnum():
            w = "".join(filter(str.isalnum, w))
            if not w:
                continue
        out.append(w)
    return out
