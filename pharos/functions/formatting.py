"""Highlighting and cropping: which parts of a text match a query, and how to show them.

Plain functions on one text, and Arrow UDFs of them for pages of hits (a page is small; the whole
corpus is never formatted).
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pharos.functions.tokenizer import Token, analyse
from pharos.plans.derive import typos
from pharos.plans.query import Phrase, Query, branches


@dataclass(frozen=True)
class FormatOptions:
    highlight: bool = False
    crop: int | None = None

    def merge(self, other: FormatOptions) -> FormatOptions:
        """What either asks for."""
        return FormatOptions(self.highlight or other.highlight, other.crop if other.crop is not None else self.crop)


@dataclass(frozen=True)
class Match:
    start: int  # characters
    length: int
    unit: int
    token: int
    tokens: int


class Matcher:
    """Finds a query's units in texts. Longer units are tried first, and take their tokens."""

    def __init__(self, tree, prefix: str = "<em>", suffix: str = "</em>", marker: str = "…"):
        units = dict.fromkeys(u for _, s in branches(tree) for u in s)
        self.units = sorted(units, key=lambda u: -len(u.words) if isinstance(u, Phrase) else -1)
        self.prefix, self.suffix, self.marker = prefix, suffix, marker

    def matches(self, text: str) -> list[Match]:
        return self._find(text, analyse(text))

    def _find(self, text: str, tokens: list[Token]) -> list[Match]:
        words = [i for i, t in enumerate(tokens) if t.kind in ("word", "stop")]
        out, n = [], 0
        while n < len(words):
            hit = None
            for k, u in enumerate(self.units):
                if isinstance(u, Phrase):
                    size = len(u.words)
                    span = words[n : n + size]
                    if len(span) == size and all(w is None or tokens[i].lemma == w for w, i in zip(u.words, span, strict=True)):
                        a, z = tokens[span[0]], tokens[span[-1]]
                        hit = Match(a.start, z.end - a.start, k, span[0], span[-1] - span[0] + 1)
                        n += size - 1
                        break
                elif isinstance(u, Query):
                    t = tokens[words[n]]
                    if typos(u.word, t.lemma, u.prefix, u.typos) is not None:
                        # of a prefix only the matched part counts
                        length = len(u.word) if u.prefix and t.lemma.startswith(u.word) and len(t.lemma) == len(t.text) else t.end - t.start
                        hit = Match(t.start, length, k, words[n], 1)
                        break
            if hit:
                out.append(hit)
            n += 1
        return out

    def bounds(self, text: str) -> list[tuple[int, int]]:
        """(byte offset, byte length) of every match, as UTF-8."""
        return [(len(text[: m.start].encode()), len(text[m.start : m.start + m.length].encode())) for m in self.matches(text)]

    def format(self, text: str, options: FormatOptions) -> str:
        tokens = analyse(text)
        found = self._find(text, tokens) if options.highlight or options.crop is not None else []
        a, z = 0, len(text)
        if options.crop:
            a, z = self._window(tokens, found, options.crop)
        out, at = [], a
        if options.highlight:
            for m in found:
                if m.start >= a and m.start + m.length <= z:
                    out += [text[at : m.start], self.prefix, text[m.start : m.start + m.length], self.suffix]
                    at = m.start + m.length
        out.append(text[at:z])
        body = "".join(out)
        return (self.marker if a > 0 else "") + body + (self.marker if z < len(text) else "")

    def _window(self, tokens: list[Token], found: list[Match], size: int) -> tuple[int, int]:
        """Character span of the best ``size`` words: most different units, then closest, then earliest."""
        words = [i for i, t in enumerate(tokens) if t.kind in ("word", "stop")]
        if not words:
            return 0, tokens[-1].end if tokens else 0
        place = {t: n for n, t in enumerate(words)}
        best, core = None, (0, 0)
        for i, m in enumerate(found):
            inside = [x for x in found[i:] if place[x.token + x.tokens - 1] < place[m.token] + size]
            if not inside:
                continue
            gaps = sum(min(7, place[b.token] - place[a.token]) for a, b in zip(inside, inside[1:], strict=False))
            score = (len({x.unit for x in inside}), -gaps)
            if best is None or score > best:
                best, core = score, (place[m.token], place[inside[-1].token + inside[-1].tokens - 1])
        spare = max(0, size - (core[1] - core[0] + 1))
        first = max(0, core[0] - spare // 2)
        last = min(len(words) - 1, first + size - 1)
        first = max(0, last - size + 1)
        a = tokens[words[first]].start if first else 0
        z = tokens[words[last]].end if last < len(words) - 1 else tokens[-1].end
        return a, z

    def formatted(self, column: Column, options: FormatOptions) -> Column:
        me = self

        @F.pandas_udf("string")
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda t: None if t is None else me.format(t, options))

        return run(column)

    def bounds_of(self, column: Column) -> Column:
        me = self

        @F.pandas_udf("array<struct<start:int,length:int>>")
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda t: None if t is None else [{"start": a, "length": n} for a, n in me.bounds(t)])

        return run(column)


def index_proximity(left: int, right: int) -> int:
    """Forward distance as it is, backward plus one, at most 8."""
    return min(8, right - left if left < right else left - right + 1)


def positions_proximity(left: tuple[int, int], right: tuple[int, int]) -> int:
    return 8 if left[0] != right[0] else index_proximity(left[1], right[1])


def path_proximity(path: list[tuple[int, int]]) -> int:
    return sum(positions_proximity(a, b) for a, b in zip(path, path[1:], strict=False))


def is_faceted(field: str, faceted: set[str]) -> bool:
    return any(field == f or field.startswith(f + ".") for f in faceted)
