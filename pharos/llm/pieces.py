"""Pre-tokenisation of byte-level BPE and a memo of encoded pieces, in numpy.

``pieces`` splits texts as the pattern of the public 50k vocabulary does:
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
A null text is treated as an empty one.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np

from pharos.llm import textkit as T

_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_table: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """Class of every code point: 1 letter, 2 number, 3 white space, 0 other."""
    if not _table:
        t = np.fromiter(({"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)
        t[_SPACES] = 3
        _table.append(t)
    return _table[0]


class Pieces:
    """``buf`` with the pieces' byte spans ``start``/``end``, ``doc`` (row), ``hash`` and ``check`` (two hashes)."""

    __slots__ = ("buf", "check", "doc", "end", "hash", "start")


def pieces(texts: list[str | None]) -> Pieces:
    texts = [t or "" for t in texts]
    whole = "".join(texts)
    cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    n = len(cp)
    p = Pieces()
    p.buf = np.frombuffer(whole.encode("utf-8"), np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    if not n:
        z = np.zeros(0, np.int64)
        p.start = p.end = p.doc = z
        p.hash = p.check = z.view(np.uint64)
        return p
    cls = _classes()[cp]
    head = np.zeros(n + 1, bool)
    head[bounds] = True
    cut = head.copy()
    cut[1:n] |= cls[1:] != cls[:-1]
    # white space before something else: a last blank goes with what follows, another stands alone
    e = np.flatnonzero((cls[:-1] == 3) & (cls[1:] != 3) & ~head[1:n]) + 1
    cut[e - 1] = True
    cut[e[cp[e - 1] == 32]] = False
    q = np.flatnonzero((cp == 39) & cut[:n])
    if len(q):
        pad = np.concatenate((cp, np.zeros(3, np.uint32)))
        a, b = pad[q + 1], pad[q + 2]
        hd = np.concatenate((head, np.ones(3, bool)))
        one = np.isin(a, [ord(c) for c in "stmd"]) & ~hd[q + 1]
        two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & ~hd[q + 1] & ~hd[q + 2]
        cut[q[one | two] + 1] = False
        cut[q[one] + 2] = True
        cut[q[two] + 3] = True
    size = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    at = np.concatenate(([0], np.cumsum(size)))
    first = np.flatnonzero(cut[:n])
    p.start = at[first]
    p.end = np.append(p.start[1:], at[-1])
    p.doc = np.searchsorted(bounds, first, side="right") - 1
    p.hash = T.span_hash(p.buf, p.start, p.end)
    p.check = T.mix((p.end - p.start).astype(np.uint64) * T.BASE + p.buf[p.start] + (p.buf[p.end - 1].astype(np.uint64) << np.uint64(8)))
    return p


#: Bytes of a piece in the memo besides its tokens: two hashes, the place and the number of its tokens.
ENTRY = 28


class Memo:
    """Encoded pieces of one task: each distinct piece is encoded once, until about ``limit`` bytes are held.

    ``encode`` takes a list of distinct pieces (bytes) and gives one list of token ids for each. Pieces
    are kept as arrays in the order of their hashes, a few dozen bytes each.
    """

    def __init__(self, encode: Callable[[list[bytes]], list], limit: int = 64 << 20):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.hash = self.check = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.size = self.flat = np.zeros(0, np.int32)

    def held(self) -> int:
        return len(self.hash) * ENTRY + 4 * len(self.flat)

    def tokens(self, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all pieces in order, number of tokens of each piece)."""
        if self.held() > self.limit:
            self.clear()
        uniq, first, back = np.unique(p.hash, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hash, uniq)
        known = np.zeros(len(uniq), bool)
        inside = at < len(self.hash)
        known[inside] = self.hash[at[inside]] == uniq[inside]
        new = np.flatnonzero(~known)
        if len(new):
            f = first[new]
            raw = p.buf.tobytes()
            ids = self.encode([raw[a:b] for a, b in zip(p.start[f].tolist(), p.end[f].tolist(), strict=True)])
            lens = np.array([len(x) for x in ids], np.int32)
            where = at[new]
            self.hash, self.check = np.insert(self.hash, where, uniq[new]), np.insert(self.check, where, p.check[f])
            self.start = np.insert(self.start, where, len(self.flat) + np.cumsum(lens, dtype=np.int64) - lens)
            self.size = np.insert(self.size, where, lens)
            self.flat = np.concatenate((self.flat, *(np.asarray(x, np.int32) for x in ids)))
            at = np.searchsorted(self.hash, uniq)
        place = at[back]
        if (self.check[place] != p.check).any():
            raise AssertionError("two pieces of one hash")
        n = self.size[place].astype(np.int64)
        off = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return self.flat[np.repeat(self.start[place], n) + off], n


def by_doc(p: Pieces, counts: np.ndarray, rows: int) -> np.ndarray:
    """Number of tokens of each row."""
    return np.bincount(p.doc, counts, minlength=rows).astype(np.int64) if len(p.doc) else np.zeros(rows, np.int64)
