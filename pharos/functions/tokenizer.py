"""The tokenizer shared by index and queries.

A lemma is lower-cased text without accents; a word is a maximal run of letters and numbers. Anything
else separates: a run that holds one of ``. , ; ! ? ( ) [ ] { } |`` is a hard separator, which moves the
position by 8 instead of 1. Leading separators don't count.

On columns this stays in the JVM: each hard separator is written as seven marker tokens, so a token's
index is its position. ``analyse`` is the same for one text on the driver.
"""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

HARD = r".,;!?()\[\]{}|"
HARD_GAP = 8
MAX_WORD_BYTES = 250
MAX_POSITIONS = 65_536
_MARK = "\x01"
_LEAD = r"^[^\p{L}\p{N}]+"
_HARD_RUN = rf"[^\p{{L}}\p{{N}}{HARD}]*[{HARD}][^\p{{L}}\p{{N}}]*"
_TOKEN = rf"[\p{{L}}\p{{N}}]+|{_MARK}"
_GAP = " " + f"{_MARK} " * (HARD_GAP - 1)


@functools.cache
def accents() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose into a base letter and combining marks."""
    pairs = {}
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(cp):
            pairs[chr(cp).lower()] = base.lower()
    pairs = {a: b for a, b in pairs.items() if len(a) == 1 and a != b}
    return "".join(pairs), "".join(pairs.values())


def lemma(text: Column) -> Column:
    a, b = accents()
    return F.translate(F.lower(text), a, b)


def lemma_text(text: str) -> str:
    a, b = accents()
    return text.lower().translate(str.maketrans(a, b))


def tokens(text: Column) -> Column:
    """Array of tokens, markers included: the index of a word is its position."""
    marked = F.regexp_replace(F.regexp_replace(lemma(text), _LEAD, ""), _HARD_RUN, _GAP)
    return F.regexp_extract_all(marked, F.lit(_TOKEN), 0)


def is_word(word: Column) -> Column:
    return (word != _MARK) & (F.octet_length(word) <= MAX_WORD_BYTES)


#: The twin for oracles: a DuckDB expression of column ``{text}``.
SQL = (
    "regexp_extract_all(regexp_replace(regexp_replace(strip_accents(lower({text})), '^[^\\p{{L}}\\p{{N}}]+', ''), "
    "'[^\\p{{L}}\\p{{N}}.,;!?()\\[\\]{{}}|]*[.,;!?()\\[\\]{{}}|][^\\p{{L}}\\p{{N}}]*', '"
    + _GAP + "', 'g'), '[\\p{{L}}\\p{{N}}]+|" + _MARK + "')"
)


class Token:
    """A piece of a text: ``kind`` is word, stop, soft or hard; ``start``/``end`` are character offsets."""

    __slots__ = ("end", "kind", "lemma", "start", "text")

    def __init__(self, text: str, start: int, end: int, kind: str):
        self.text, self.start, self.end, self.kind = text, start, end, kind
        self.lemma = lemma_text(text)

    def __repr__(self) -> str:
        return f"{self.kind}:{self.text!r}"


def analyse(text: str, stop_words: frozenset[str] = frozenset()) -> list[Token]:
    out = []
    for m in re.finditer(r"[^\W_]+|[\W_]+", text):
        s = m[0]
        if s[0].isalnum():
            kind = "stop" if lemma_text(s) in stop_words else "word"
        else:
            kind = "hard" if any(c in ".,;!?()[]{}|" for c in s) else "soft"
        out.append(Token(s, m.start(), m.end(), kind))
    return out
