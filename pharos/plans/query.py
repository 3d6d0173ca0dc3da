"""From query text to an operation tree, on the driver.

``primitive`` splits the text into words and phrases; ``build`` makes the tree: for each word its
typo-tolerant form, its synonyms, its best split and its concatenations with neighbours, for each
matching strategy the successively shorter queries. ``branches`` flattens the tree into the
sequences of units that the ranking rules score.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product

from pharos.functions.tokenizer import analyse, lemma_text

STRATEGIES = ("last", "first", "frequency", "size", "any", "all")


@dataclass(frozen=True)
class Word:
    text: str
    prefix: bool = False


@dataclass(frozen=True)
class PhrasePart:
    words: tuple[str | None, ...]  # None: a stop word


def primitive(text: str, stop_words: frozenset[str] = frozenset(), words_limit: int | None = 10, prefix_search: bool = True) -> list[Word | PhrasePart]:
    """Only the very last token can be a prefix; a quotation mark or hard separator ends a phrase; an
    unclosed phrase counts; stop words are dropped unless the last token is one."""
    tokens = analyse(text, stop_words)
    parts: list[Word | PhrasePart] = []
    phrase: list[str | None] = []
    quoted = False

    def close() -> None:
        if any(w is not None for w in phrase):
            parts.append(PhrasePart(tuple(phrase)))
        phrase.clear()

    for i, t in enumerate(tokens):
        if words_limit is not None and len(parts) >= words_limit:
            break
        last = i + 1 == len(tokens)
        if t.kind in ("word", "stop"):
            if quoted:
                phrase.append(None if t.kind == "stop" else t.lemma)
            elif last:
                parts.append(Word(t.lemma, prefix_search))
            elif t.kind == "word":
                parts.append(Word(t.lemma))
        else:
            marks = t.text.count('"')
            if phrase and (marks or t.kind == "hard"):
                close()
            if marks % 2:
                quoted = not quoted
    if phrase and (words_limit is None or len(parts) < words_limit):
        close()
    return parts


@dataclass(frozen=True)
class Query:
    """A leaf: one word, how many typos it may have, and what it counts from the start."""

    word: str
    prefix: bool = False
    typos: int = 0
    original: bool = True

    def __str__(self) -> str:
        kind = f"Tolerant{{typo: {self.typos}}}" if self.typos or self.original else "Exact"
        return f"{'Prefix' if self.prefix else ''}{kind}{{{self.word}}}"


@dataclass(frozen=True)
class Phrase:
    words: tuple[str | None, ...]

    def __str__(self) -> str:
        return f"PHRASE[{' '.join(w or '_' for w in self.words)}]"


@dataclass(frozen=True)
class And:
    children: tuple

    def __str__(self) -> str:
        return f"AND({', '.join(map(str, self.children))})"


@dataclass(frozen=True)
class Or:
    children: tuple
    optional: bool = False  # its children drop more and more words

    def __str__(self) -> str:
        return f"OR{'(WORD)' if self.optional else ''}({', '.join(map(str, self.children))})"


def conj(children: list):
    children = [g for c in children for g in (c.children if isinstance(c, And) else (c,))]
    return children[0] if len(children) == 1 else And(tuple(children))


def disj(children: list, optional: bool = False):
    if not optional:
        children = [g for c in children for g in (c.children if isinstance(c, Or) and not c.optional else (c,))]
    children = list(dict.fromkeys(children))
    return children[0] if len(children) == 1 else Or(tuple(children), optional)


@dataclass
class Planner:
    """What the tree depends on. ``frequency`` and ``pair_frequency`` count documents."""

    authorize_typos: bool = True
    one_typo: int = 5
    two_typos: int = 9
    exact_words: frozenset[str] = frozenset()
    synonyms: dict[str, list[str]] = field(default_factory=dict)
    frequency: Callable[[str], int] = lambda w: 0
    pair_frequency: Callable[[str, str], int] = lambda a, b: 0
    split_words: bool = True
    ngrams: bool = True

    def typos(self, word: str, most: int = 2) -> int:
        """Budget by characters."""
        if not self.authorize_typos or word in self.exact_words or len(word) < self.one_typo:
            return 0
        return min(most, 1 if len(word) < self.two_typos else 2)

    def synonym_ops(self, words: list[str]) -> list:
        key = " ".join(words)
        table = {lemma_text(k): v for k, v in self.synonyms.items()}
        out = []
        for s in table.get(key, []):
            w = [t.lemma for t in analyse(s) if t.kind == "word"]
            if w:
                out.append(Query(w[0], original=False) if len(w) == 1 else Phrase(tuple(w)))
        return out

    def split(self, word: str):
        best, pair = 0, None
        for i in range(1, len(word)):
            n = self.pair_frequency(word[:i], word[i:])
            if n > best:
                best, pair = n, (word[:i], word[i:])
        return Phrase(pair) if pair else None

    def alternatives(self, part: Word | PhrasePart):
        if isinstance(part, PhrasePart):
            words = tuple(part.words)
            return Query(words[0], original=False) if len(words) == 1 and words[0] else Phrase(words)
        found = [Query(part.text, part.prefix, self.typos(part.text)), *self.synonym_ops([part.text])]
        if self.split_words and (s := self.split(part.text)) is not None:
            found.append(s)
        return disj(found)

    def sequence(self, parts: list[Word | PhrasePart]):
        """All ways to read the parts, with 1 to 3 adjacent words joined to one."""

        def read(rest: list) -> object:
            ways = []
            for n in range(1, min(3, len(rest)) + 1):
                head = rest[:n]
                if n > 1 and (not self.ngrams or any(isinstance(p, PhrasePart) for p in head)):
                    break
                if n == 1:
                    op = self.alternatives(head[0])
                else:
                    joined = "".join(p.text for p in head)
                    op = disj([Query(joined, head[-1].prefix, self.typos(joined, 1)), *self.synonym_ops([p.text for p in head])])
                ways.append(conj([op, read(rest[n:])]) if len(rest) > n else op)
            return disj(ways)

        return read(parts)

    def shorter(self, parts: list, strategy: str) -> list[list]:
        """The full query and its shorter forms, in order; phrases are never dropped."""
        words = [i for i, p in enumerate(parts) if isinstance(p, Word)]
        if strategy == "all" or len(words) + (len(words) < len(parts)) <= 1:
            return [parts]
        if strategy == "last":
            order = words[::-1]
        elif strategy == "first":
            order = words
        elif strategy == "size":
            order = sorted(words, key=lambda i: len(parts[i].text.encode()))
        elif strategy == "frequency":
            order = sorted(words, key=lambda i: (-self.frequency(parts[i].text), i))
        else:
            raise ValueError(f"unknown strategy {strategy}; use one of {', '.join(STRATEGIES)}")
        out, gone = [parts], set()
        for i in order:
            gone.add(i)
            rest = [p for j, p in enumerate(parts) if j not in gone]
            if rest:
                out.append(rest)
        return out

    def build(self, parts: list, strategy: str = "last"):
        """The operation tree, None for an empty query."""
        if not parts:
            return None
        if strategy == "any":
            singles = [self.alternatives(p) for p in parts]
            whole = self.sequence(parts)
            return disj([whole, *singles], optional=True) if len(parts) > 1 else whole
        forms = [self.sequence(p) for p in self.shorter(parts, strategy)]
        return disj(forms, optional=len(forms) > 1)


def maximum_typo(op) -> int:
    if isinstance(op, Or):
        return max(map(maximum_typo, op.children))
    if isinstance(op, And):
        return sum(map(maximum_typo, op.children))
    return op.typos if isinstance(op, Query) else 0


def maximum_proximity(op) -> int:
    if isinstance(op, Or):
        return max(map(maximum_proximity, op.children))
    if isinstance(op, And):
        return sum(map(maximum_proximity, op.children)) + 7 * (len(op.children) - 1)
    return 0


def flatten(op) -> list[tuple]:
    """Sequences of units (queries and phrases) that satisfy ``op``."""
    if isinstance(op, Or):
        return list(dict.fromkeys(s for c in op.children for s in flatten(c)))
    if isinstance(op, And):
        return [sum(combo, ()) for combo in product(*(flatten(c) for c in op.children))]
    return [(op,)]


def branches(tree) -> list[tuple[int, tuple]]:
    """(number of dropped words' step, sequence of units) of every way to match."""
    if tree is None:
        return []
    if isinstance(tree, Or) and tree.optional:
        return [(k, s) for k, c in enumerate(tree.children) for s in flatten(c)]
    return [(0, s) for s in flatten(tree)]
