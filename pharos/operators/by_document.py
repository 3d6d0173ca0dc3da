"""Operators that need a document's words together: words of whole documents, in numpy.

``whole`` brings the rows of a document together in one task and in a row, which moves texts once (words
are split off behind the shuffle) and holds no hash table; a task then takes a few hundred thousand words
of whole documents at a time, so that its memory follows the longest document and not the table. Rows of
one ``doc_id``, however many, are one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pharos.functions import tokenizer as Z
from pharos.runtime import ship

MAX_DISTANCE = 7
#: Words that are worked on at once, if no document has more.
WORDS = 1 << 18
#: Rows of a batch that a task returns.
ROWS = 1 << 16
#: Between the keys of the positions of two fields: more than any position and ``MAX_DISTANCE``.
LINE = Z.MAX_POSITIONS + MAX_DISTANCE + 1


class Words:
    """Words of whole documents, from rows (doc_id, fid, exact, at, words): the words that stand from
    position ``at`` on, markers included. ``code`` is a word's place in ``names``, ``doc`` its document's in ``ids``."""

    def __init__(self, t: pa.Table, stop_words: frozenset[str]):
        ids = t["doc_id"].combine_chunks().dictionary_encode("encode")
        lists = t["words"].combine_chunks()
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        flat = lists.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(n)), n)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + t["at"].to_numpy()[row]
        self.ids, self.names = ids.dictionary, flat.dictionary
        code = flat.indices.to_numpy().astype(np.int64)
        ok = pc.and_(pc.not_equal(self.names, Z._MARK), pc.less_equal(pc.binary_length(self.names), Z.MAX_WORD_BYTES))
        ok = pc.and_(ok, pc.invert(pc.is_in(self.names, value_set=pa.array(sorted(stop_words), pa.string())))) if stop_words else ok
        keep = ok.to_numpy(zero_copy_only=False)[code] & (pos < Z.MAX_POSITIONS) if len(code) else np.zeros(0, bool)
        row, self.pos, self.code = row[keep], pos[keep], code[keep]
        self.doc = ids.indices.to_numpy().astype(np.int64)[row]
        self.fid, self.exact = t["fid"].to_numpy().astype(np.int64)[row], t["exact"].to_numpy()[row]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each word of each document once: document, word, is it in a typo-tolerant and in an exact attribute?"""
        key = distinct(((self.doc * len(self.names) + self.code) << 1) | self.exact)
        both = key >> 1
        first = np.flatnonzero(np.diff(both, prepend=-1))
        last = np.append(first[1:], len(key)) - 1
        return *np.divmod(both[first], max(1, len(self.names))), (key[first] & 1) == 0, (key[last] & 1) == 1

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each ordered pair of words of each document once: document, words, least distance of 1 to 7 in a field."""
        known = self.ids.is_valid().to_numpy(zero_copy_only=False)[self.doc] if len(self.doc) else np.zeros(0, bool)
        doc, code = self.doc[known], self.code[known]
        at = (doc * (self.fid.max(initial=0) + 1) + self.fid[known]) * LINE + self.pos[known]
        step = np.diff(at)
        if (step <= 0).any():  # rows of one field that don't follow each other, or several of one place
            order = np.lexsort((code, at))
            at, code, doc = at[order], code[order], doc[order]
            new = np.append(True, (np.diff(at) > 0) | (np.diff(code) > 0))
            at, code, doc = at[new], code[new], doc[new]
        found, i, j = [], np.arange(len(at)), 0
        size = max(1, len(self.names))
        while len(i):
            j += 1
            i = i[: np.searchsorted(i, len(at) - j)]
            d = at[i + j] - at[i]
            i, d = i[d <= MAX_DISTANCE], d[d <= MAX_DISTANCE]
            some = d > 0
            k = i[some]
            found.append((((doc[k] * size + code[k]) * size + code[k + j]) << 3) | d[some])
        key = _least(np.concatenate(found) if found else np.zeros(0, np.int64))
        pair, second = np.divmod(key >> 3, size)
        return *np.divmod(pair, size), second, key & 7

    def prefixes(self, longest: int) -> tuple[pa.Array, list[np.ndarray]]:
        """Prefixes, and by length each name's place among them, -1 if it has none of up to ``longest`` bytes."""
        each = [pc.utf8_slice_codeunits(self.names, 0, k) for k in range(1, longest + 1)]
        all_ = pa.chunked_array(each, pa.string()).combine_chunks().dictionary_encode()
        place = all_.indices.to_numpy().astype(np.int64).reshape(longest, len(self.names))
        length = pc.utf8_length(self.names).to_numpy(zero_copy_only=False)
        return all_.dictionary, [np.where((length >= k) & (pc.binary_length(p).to_numpy(zero_copy_only=False) <= longest), place[k - 1], -1) for k, p in enumerate(each, 1)]

    def prefix_pairs(self, longest: int, forward: bool) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """``pairs`` with one of the words by its prefixes, a length at a time: prefixes, document, word, prefix, distance."""
        doc, first, second, d = self.pairs()
        known, other = (first, second) if forward else (second, first)
        names, places = self.prefixes(longest)
        for place in places:
            p = place[other]
            has = p >= 0
            key = _least(((((doc[has] * len(self.names) + known[has]) * len(names)) + p[has]) << 3) | d[has])
            if len(key):
                rest, prefix = np.divmod(key >> 3, len(names))
                yield names, *np.divmod(rest, len(self.names)), prefix, key & 7


def distinct(key: np.ndarray) -> np.ndarray:
    key = np.sort(key)
    return key[np.append(True, key[1:] != key[:-1])] if len(key) else key


def _least(key: np.ndarray) -> np.ndarray:
    """Of keys that are alike but for the last three bits, the least."""
    key = np.sort(key)
    return key[np.append(True, key[1:] >> 3 != key[:-1] >> 3)] if len(key) else key


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole documents with about ``WORDS`` words, from rows in which documents follow each other."""
    held: list[pa.RecordBatch] = []
    count, enough = 0, WORDS
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        count += len(b["words"].flatten())
        if count < enough:
            continue
        t = pa.Table.from_batches(held)
        rest = yield from _cut(t, True)
        held = rest.to_batches()
        count = sum(len(x["words"].flatten()) for x in held)
        enough = max(WORDS, 2 * count)
    if held:
        yield from _cut(pa.Table.from_batches(held), False)


def _cut(t: pa.Table, more: bool):
    """The pieces of ``t``; returns what is left: if ``more`` is to come, the last document."""
    doc = t["doc_id"].combine_chunks().dictionary_encode("encode").indices.to_numpy()
    starts = np.append(np.flatnonzero(np.diff(doc, prepend=-1)), t.num_rows)
    before = np.append(0, np.cumsum(pc.list_value_length(t["words"]).to_numpy()))[starts]
    k, last = 0, len(starts) - 1 - more
    while k < last:
        to = min(last, max(k + 1, np.searchsorted(before, before[k] + WORDS, "right") - 1))
        yield t.slice(starts[k], starts[to] - starts[k])
        k = to
    return t.slice(starts[last])


def whole(lines: DataFrame, schema: str, work: Callable[[Words], Iterator[dict]], stop_words: frozenset[str] = frozenset()) -> DataFrame:
    """What ``work`` makes of the words of whole documents, columns by name; ``doc_id`` keeps its type.

    ``lines`` has texts (doc_id, fid, exact, text) or words (doc_id, fid, pos, word).
    """
    spark = lines.sparkSession
    ship(spark)
    kind = lines.schema["doc_id"].dataType.simpleString()
    exact = F.col("exact") if "exact" in lines.columns else F.lit(False)
    if "text" in lines.columns:
        rows, at, words = lines.select("doc_id", "fid", exact.alias("exact"), "text"), F.lit(0), Z.tokens(F.col("text"))
    else:
        rows, at, words = lines.select("doc_id", "fid", exact.alias("exact"), "pos", "word"), F.col("pos"), F.array("word")
    rows = rows.repartition("doc_id").sortWithinPartitions("doc_id").select("doc_id", F.col("fid").cast("int").alias("fid"), "exact", at.cast("int").alias("at"), words.alias("words"))

    def run(batches):
        for t in _pieces(batches):
            for columns in work(Words(t, stop_words)):
                out = pa.RecordBatch.from_pydict(columns)
                for k in range(0, out.num_rows, ROWS):
                    yield out.slice(k, ROWS)

    return rows.mapInArrow(run, schema.format(doc_id=kind))
