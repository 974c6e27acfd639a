"""The visible text of wiki pages, and its words."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_REF = re.compile(r"<ref\b[^<>]*?/\s*>|<ref\b[^<>]*>.*?</ref\s*>", re.S | re.I)
_PARAMETER = re.compile(r"\{\{\{[^{}]*\}\}\}")
_TEMPLATE = re.compile(r"\{\{([^{}]*)\}\}")
_LINK = re.compile(r"\[\[([^\[\]]*)\]\]")
_HIDDEN_LINK = re.compile(r"\s*(?:category|kategorie|catégorie|categoría)\s*:", re.I)
_EXTERNAL = re.compile(r"\[(?:https?:|ftp:)?//[^\s\[\]]*([^\[\]]*)\]", re.I)
_TABLE_LINE = re.compile(r"^[ \t:*#]*(?:\{\||\|-|\|\})[^\n]*$", re.M)
_CELL_FORMAT = re.compile(r"^([|!]|.*?(?:\|\||!!))[^|\[\]\n!]*=\s*\"[^|\n]*\|(?!\|)", re.M)
_TAG = re.compile(r"<(/?)([a-z][a-z0-9]*)\b[^<>]*>", re.I)
_INLINE = frozenset("b i u s em strong small big sub sup span font abbr code tt del ins mark cite q nowiki noinclude includeonly onlyinclude".split())
_QUOTES = re.compile(r"'{2,}")
_ENTITY = re.compile(r"&(#[0-9]+|#x[0-9a-f]+|[a-z][a-z0-9]*);", re.I)
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]")
_KEY = re.compile(r"^\s*([^\s=|<>\[\]]{1,40})\s*=")
#: Named arguments that hold what a template shows.
_SHOWN = frozenset("text quote content 1 2 3".split())
_WORD = re.compile(r"[^\W_]+")

#: Words of a named argument of any other name from which on it is taken for text too.
LONG_ARGUMENT = 8


def _entity(m: re.Match) -> str:
    whole = m.group(0)
    got = html.unescape(whole)
    if got == whole and whole != whole.lower():
        got = html.unescape(whole.lower())
    return got


def _argument(text: str) -> str | None:
    """An argument as far as it is shown. Single words are codes, units and dates, as in notes of maintenance."""
    key = _KEY.match(text)
    least = 2 if key is None or key.group(1).lower() in _SHOWN else LONG_ARGUMENT
    own = text[key.end() :] if key else text
    return own if len(_WORD.findall(own)) >= least else None


def _template(m: re.Match) -> str:
    kept = " ".join(x for x in map(_argument, m.group(1).split("|")[1:]) if x is not None)
    return f" {kept} " if kept else ""


def _link(m: re.Match) -> str:
    inside = m.group(1)
    return "" if _HIDDEN_LINK.match(inside) else inside.rpartition("|")[2]


def _repeat(pattern: re.Pattern, by, text: str) -> str:
    n = 1
    while n:
        text, n = pattern.subn(by, text)
    return text


def visible_text(text: str) -> str:
    """What the page shows: no comments, footnotes, tags or short templates; labels of
    links, cells of tables, quoted arguments of templates, characters for references."""
    if "<" in text:
        text = _REF.sub(" ", _COMMENT.sub("", text))
    if "{|" in text or "\n|" in text:
        text = _TABLE_LINE.sub(" ", text)
        text = _CELL_FORMAT.sub(r"\1 ", text)
    if "[" in text:
        text = _repeat(_LINK, _link, text)
        text = _EXTERNAL.sub(r"\1", text)
    if "{{" in text:
        text = _repeat(_PARAMETER, "", text)
        text = _repeat(_TEMPLATE, _template, text)
    if "<" in text:
        text = _TAG.sub(lambda m: "" if m.group(2).lower() in _INLINE else " ", text)
    if "''" in text:
        text = _QUOTES.sub("", text)
    if "&" in text:
        text = _ENTITY.sub(_entity, text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", _INVISIBLE.sub("", text))
    return text


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, without case."""
    return _WORD.findall(unicodedata.normalize("NFC", text.casefold()))


class WordIds(dict):
    """Numbers of the words of blank-separated pieces, as int32 bytes; new words are numbered on."""

    def __init__(self, keep: int = 200_000) -> None:
        super().__init__()
        self.vocabulary: dict[str, int] = {}
        self.keep = keep

    def __missing__(self, piece: str) -> bytes:
        number = self.vocabulary
        found = np.array([number.setdefault(w, len(number)) for w in words(piece)], np.int32).tobytes()
        if len(piece) < 64:
            if len(self) >= self.keep:
                self.clear()
            self[piece] = found
        return found

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))

    def forget(self) -> None:
        self.clear()
        self.vocabulary.clear()
