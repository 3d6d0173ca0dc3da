"""Vectorised text primitives shared by the operators of this subpackage.

Every function works on a whole Arrow batch at once: the batch's texts are laid end to end in one
byte buffer and words, hashes and sliding minima are numpy passes over that buffer, so the cost of a
word is a few dozen nanoseconds instead of a Python iteration.

Words come in two flavours:

* ``raw``: maximal runs of bytes that aren't ASCII white space, case kept;
* ``norm``: text is lower-cased, words are maximal runs of ``[0-9a-z]`` and non-ASCII characters.

A null text is treated as an empty one (no words).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
GRAM_BASE = np.uint64(0xD1342543DE82EF95)

_RAW = np.ones(256, dtype=bool)
_RAW[[9, 10, 11, 12, 13, 32]] = False
_NORM = np.zeros(256, dtype=bool)
_NORM[48:58] = _NORM[97:123] = _NORM[128:] = True

#: SQL twins of the two flavours, for oracles (RE2 syntax).
RAW_SQL = r"regexp_extract_all({text}, '[^ \t\n\r\f\v]+')"
NORM_SQL = r"regexp_extract_all(lower({text}), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser (splitmix64): spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(max(n, 1), base, dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


#: Bytes of text that are taken apart at once; a longer text is taken by itself.
SLICE_BYTES = 2 << 20


def slices(batches, rows: int = 500, size: int | None = None):
    """Arrow batches cut to at most ``rows`` rows and ``size`` bytes of strings (or one row), since the
    arrays of a batch's words are many times its text."""
    size = size or SLICE_BYTES
    for b in batches:
        weight = np.zeros(b.num_rows, np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
                weight += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
            elif pa.types.is_list(c.type) and pa.types.is_string(c.type.value_type):
                upto = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(c.flatten()), 0).to_numpy(zero_copy_only=False))))
                weight += np.diff(upto[c.offsets.to_numpy() - c.offsets[0].as_py()]) if len(c) else 0
        upto = np.cumsum(weight)
        at = 0
        while at < b.num_rows:
            fits = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, side="right"))
            to = min(at + rows, max(fits, at + 1))
            yield b.slice(at, to - at)
            at = to


class Words:
    """The words of a batch of texts: ``start``/``end`` byte offsets in ``buf``, ``hash`` (64 bits),
    ``doc`` (row in the batch) and ``first`` (index of each row's first word; one more at the end)."""

    __slots__ = ("buf", "doc", "doc_start", "end", "first", "hash", "start")

    def __len__(self) -> int:
        return len(self.start)

    def pos(self) -> np.ndarray:
        """Word number inside its document, from 0."""
        return np.arange(len(self.start), dtype=np.int64) - self.first[self.doc]


def words(texts: list[str | None], flavour: str = "raw") -> Words:
    table = _RAW if flavour == "raw" else _NORM
    low = flavour != "raw"
    parts = [(t.lower() if low else t).encode("utf-8", "replace") if t else b"" for t in texts]
    w = Words()
    sizes = np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts))
    w.doc_start = np.concatenate(([0], np.cumsum(sizes)))
    # a line break ends each text, so that no word crosses from one to the next
    w.buf = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    inside = table[w.buf]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    w.start, w.end = edge[0::2], edge[1::2]
    w.hash = span_hash(w.buf, w.start, w.end)
    w.first = np.searchsorted(w.start, w.doc_start)
    w.doc = np.repeat(np.arange(len(parts)), np.diff(w.first)) if len(parts) else np.zeros(0, np.int64)
    return w


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end): eight bytes a step, one pass over the spans for
    each eight bytes of the longest."""
    if not len(start):
        return np.zeros(0, np.uint64)
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    view = np.ndarray(shape=(len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    left = end - start
    h = _step(left.astype(np.uint64) * GRAM_BASE, view[start], left)
    todo, at, left = None, start, left
    while True:
        more = np.flatnonzero(left > 8)
        if not len(more):
            return mix(h)
        todo = more if todo is None else todo[more]
        at, left = at[more] + 8, left[more] - 8
        h[todo] = _step(h[todo], view[at], left)


def _step(h: np.ndarray, chunk: np.ndarray, left: np.ndarray) -> np.ndarray:
    chunk = chunk & MASKS[np.minimum(left, 8)]
    h = (h ^ chunk) * BASE
    return h ^ (h >> np.uint64(29))


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every n-word gram that stays inside one document."""
    total = len(w)
    if total < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p = powers(GRAM_BASE, n)[::-1]
    h = np.zeros(total - n + 1, np.uint64)
    for i in range(n):
        h += w.hash[i : total - n + 1 + i] * p[i]
    ok = np.flatnonzero(w.doc[: total - n + 1] == w.doc[n - 1 :])
    return ok, mix(h[ok])


def sliding_argmin(a: np.ndarray, width: int) -> np.ndarray:
    """Index of the minimum (the rightmost of equals) of every window of ``width`` values, by doubling."""
    val, idx, have = a, np.arange(len(a)), 1
    while have < width:
        step = min(have, width - have)
        right = val[step:] <= val[: len(val) - step]
        val = np.where(right, val[step:], val[: len(val) - step])
        idx = np.where(right, idx[step:], idx[: len(idx) - step])
        have += step
    return idx


def winnow(w: Words, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed fingerprints: (index of the gram's first word, hash).

    Of each ``window`` successive k-grams of a document the smallest hash is kept (the rightmost of
    equals), so two texts that share ``k + window - 1`` words keep a common fingerprint at the same
    place of the shared span. Documents with fewer k-grams than a window keep their smallest one.
    """
    at, h = grams(w, k)
    if not len(at):
        return at, h
    doc = w.doc[at]
    n = len(at)
    keep = np.zeros(n, dtype=bool)
    if n >= window:
        whole = doc[: n - window + 1] == doc[window - 1 :]
        keep[sliding_argmin(h, window)[whole]] = True
    counts = np.bincount(doc, minlength=len(w.first) - 1)
    short = np.flatnonzero((counts > 0) & (counts < window))
    if len(short):
        begin = np.searchsorted(doc, short)
        for b, c in zip(begin.tolist(), counts[short].tolist(), strict=True):
            keep[b + c - 1 - int(np.argmin(h[b : b + c][::-1]))] = True
    sel = np.flatnonzero(keep)
    return at[sel], h[sel]


def islands(group: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of successive ``pos`` in one ``group`` (both sorted)."""
    if not len(pos):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero((group[1:] != group[:-1]) | (pos[1:] != pos[:-1] + 1)) + 1
    return np.concatenate(([0], cut)), np.concatenate((cut, [len(pos)])) - 1
