"""Folding of text for comparison: case, accents, punctuation and spacing fall away."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import regex

_MARKS = regex.compile(r"\p{M}+")
_WORD = re.compile(r"[^\W_]+")
# Letters that Unicode does not decompose.
UNDECOMPOSED = {"đ": "d", "ł": "l", "ø": "o", "ı": "i", "æ": "ae", "œ": "oe", "ħ": "h", "ŧ": "t", "ð": "d", "þ": "th"}
_ODD = regex.compile("[" + "".join(UNDECOMPOSED) + "]")


def fold(text: str) -> str:
    """Lower case without accents: compatibility decomposition, case folding, marks dropped."""
    if text.isascii():
        return text.lower()
    t = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
    t = _MARKS.sub("", t)
    return t if t.isascii() else _ODD.sub(lambda m: UNDECOMPOSED[m.group()], t)


def words(text: str) -> list[str]:
    """The folded words: unbroken runs of letters or digits."""
    return _WORD.findall(fold(text))


@lru_cache(maxsize=1 << 17)
def fold_word(word: str) -> str:
    """fold() of a single word, remembered: words recur."""
    return fold(word)
