"""Suffix-array dedup: passages of at least ``length`` words that occur more than once.

The index is a logarithmic family: each new batch of suffixes is sorted into a suffix array, scanned
against the arrays (levels) that exist already for matches of ``length`` words, and added as a level
of its own; levels of about equal size are then merged, so sizes grow geometrically and a suffix is
merged only a logarithmic number of times. Suffixes are compared word by word (by 32-bit hashes of the
words, big-endian, so byte order is word order) up to ``length`` words; levels hold each distinct
suffix once, with its first occurrence.

To spread this over a cluster, every window of ``length`` words is named by its least ``k``-gram hash
(winnowing). Equal windows have equal names, so windows meet in the shard of their name and no suffix
has to be compared with those of other shards. A name that occurs at one place only can't repeat:
those windows (most of a clean corpus) are dropped before any text moves.

1. Winnowed names with their places go to Parquet; names with two places or more are repeated.
2. Repeated places return to their document, which cuts the windows so named into segments.
3. Segments go to their shard in order of document; each shard keeps its index family.
4. Runs of repeated windows of a document are joined to maximal spans.

``repeated_spans`` does this for one table; ``SuffixIndex`` keeps names, texts and matches in stored levels.

Result: ``doc_id, start_word, n_words, first_doc_id``: every maximal span all of whose windows of
``length`` words occur elsewhere too (in another document or another place of this one), first and
later occurrences alike; ``first_doc_id`` is the smallest doc_id that holds one of its windows. Words
are runs without ASCII white space, case kept, counted from 0.

Defined results: null or empty texts and texts of fewer than ``length`` words have no window; rows
without a doc_id are ignored; repeated rows of one doc_id and text count as one; the distinct texts of a
doc_id that has several are read as one text, in order and with a blank between them; in ties the
smaller (doc_id, place) is first; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pharos.llm import textkit as T
from pharos.llm.frames import by_id
from pharos.operators.lifecycle import Store
from pharos.runtime import materialise, partitions, ship, table

LENGTH, K = 50, 10
#: Windows in a batch of the index family.
BATCH = 50_000


class SuffixFamily:
    """The levels of one shard: sorted suffixes, first occurrence (doc, place), reported already?"""

    def __init__(self, length: int):
        self.length = length
        self.levels: list[list[np.ndarray]] = []

    def add(self, keys: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Add a batch; returns (doc, place, first doc) of the occurrences that are now known to repeat."""
        order = np.argsort(keys, kind="stable")
        keys, doc, pos = keys[order], doc[order], pos[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        head = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        size = np.diff(np.append(head, len(keys)))
        own_doc, own_pos = doc[head].copy(), pos[head].copy()
        # rows of one document and place are one occurrence
        many = np.zeros(len(head), bool)
        np.logical_or.at(many, run, (doc != own_doc[run]) | (pos != own_pos[run]))
        known = np.zeros(len(head), bool)
        out = []
        for suffixes, d, p, told in self.levels:
            at = np.minimum(np.searchsorted(suffixes, keys[head]), len(suffixes) - 1)
            hit = np.flatnonzero(suffixes[at] == keys[head])
            at = at[hit]
            known[hit] = True
            own_doc[hit], own_pos[hit] = d[at], p[at]
            many[hit] = False
            fresh = np.zeros(len(head), bool)
            other = (doc != own_doc[run]) | (pos != own_pos[run])
            np.logical_or.at(fresh, run, other)
            many[hit] = fresh[hit] | told[at]
            tell = fresh[hit] & ~told[at]
            out.append((d[at[tell]], p[at[tell]], d[at[tell]]))
            told[at] |= fresh[hit]
        sel = many[run]
        out.append((doc[sel], pos[sel], own_doc[run[sel]]))
        add = np.flatnonzero(~known)
        if len(add):
            self.levels.append([keys[head[add]], own_doc[add], own_pos[add], many[add]])
        self._merge()
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _merge(self) -> None:
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            b, a = self.levels.pop(), self.levels.pop()
            both = [np.concatenate(x) for x in zip(a, b, strict=True)]
            order = np.argsort(both[0], kind="stable")  # timsort: one merge of two runs
            self.levels.append([x[order] for x in both])


def window_names(w: T.Words, k: int, length: int):
    """For each window of ``length`` words: index of its first word, of the word its name begins at, and the name."""
    at, h = T.grams(w, k)
    span = length - k + 1
    if len(h) < span:
        z = np.zeros(0, np.int64)
        return z, z, z.view(np.uint64)
    best = T.sliding_argmin(h, span)
    n = len(best)
    inside = (w.doc[at[:n]] == w.doc[at[span - 1 :]]) & (at[span - 1 :] - at[:n] == span - 1)
    first, best = at[:n][inside], best[inside]
    return first, at[best], h[best]


def _texts(docs: DataFrame) -> DataFrame:
    return by_id(docs)[0].select("doc_id", F.array_join("texts", " ").alias("text"))


def _places(texts: DataFrame, length: int, k: int) -> DataFrame:
    """(name, doc_id, pos): the name of every window, and the word at which its name's gram begins."""

    def names(batches):
        for c in T.slices(batches, 1000):
            w = T.words(c.column(1).to_pylist())
            _, place, name = window_names(w, k, length)
            sel = np.flatnonzero(np.diff(place, prepend=-1))
            ids = c.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(name[sel].view(np.int64)), pa.array(ids[w.doc[place[sel]]], pa.int64()), pa.array(w.pos()[place[sel]], pa.int32())], ["name", "doc_id", "pos"])

    return texts.mapInArrow(names, "name bigint, doc_id bigint, pos int")


def _repeated(places: DataFrame) -> DataFrame:
    spot = F.struct("doc_id", "pos")
    return places.groupBy("name").agg(F.min(spot).alias("a"), F.max(spot).alias("b")).where("a != b").select("name")


def _marks(places: DataFrame, names: DataFrame) -> DataFrame:
    return places.join(names, "name", "left_semi").groupBy("doc_id").agg(F.collect_set("pos").alias("marks"))


def _matches(texts: DataFrame, marks: DataFrame, length: int, k: int, batch: int) -> DataFrame:
    """(doc_id, lo, hi, own): runs of windows of the marked names that repeat, and the least document of each."""
    n = partitions(texts.sparkSession)
    shards = 16 * n

    def cut(batches):
        for c in T.slices(batches, 500):
            ids = c.column(0).to_numpy()
            w = T.words(c.column(1).to_pylist())
            first, place, name = window_names(w, k, length)
            marked = np.zeros(len(w) + 1, bool)
            m = c.column(2)
            row = np.repeat(np.arange(c.num_rows), np.diff(m.offsets.to_numpy()))
            at = w.first[row] + m.flatten().to_numpy()
            marked[at[at < w.first[row + 1]]] = True
            sel = marked[place]
            first, place, name = first[sel], place[sel], name[sel]
            if not len(first):
                continue
            starts = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (first[1:] != first[:-1] + 1))))
            ends = np.append(starts[1:], len(first)) - 1
            code = (w.hash >> np.uint64(32)).astype(">u4")
            a, z = first[starts], first[ends] + length
            offsets = np.concatenate(([0], np.cumsum(z - a)))
            flat = np.repeat(a - offsets[:-1], z - a) + np.arange(offsets[-1])
            blob = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(code[flat].tobytes())])
            shard = (T.mix(name[starts]) % np.uint64(shards)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(ids[w.doc[a]], pa.int64()), pa.array(w.pos()[a], pa.int32()), blob], ["shard", "doc_id", "pos", "words"])

    segments = texts.join(marks, "doc_id").select("doc_id", "text", "marks").mapInArrow(cut, "shard int, doc_id bigint, pos int, words binary")

    def scan(batches):
        family, current, held, windows = None, None, [], 0

        def flush():
            docs_, starts, blobs = zip(*held, strict=True)
            keys, d, p = [], [], []
            for doc, start, blob in zip(docs_, starts, blobs, strict=True):
                v = np.lib.stride_tricks.sliding_window_view(np.frombuffer(blob, np.uint8), 4 * length)[::4]
                keys.append(np.ascontiguousarray(v).view(f"S{4 * length}").ravel())
                d.append(np.full(len(v), doc))
                p.append(np.arange(start, start + len(v)))
            doc, pos, own = family.add(np.concatenate(keys), np.concatenate(d), np.concatenate(p))
            order = np.lexsort((pos, own, doc))
            doc, pos, own = doc[order], pos[order], own[order]
            fresh = np.ones(len(doc), bool)
            fresh[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1]) | (own[1:] != own[:-1])
            doc, pos, own = doc[fresh], pos[fresh], own[fresh]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (own[1:] != own[:-1]) | (pos[1:] != pos[:-1] + 1)
            a = np.flatnonzero(new)
            z = np.append(a[1:], len(doc)) - 1 if len(a) else a
            return pa.RecordBatch.from_arrays([pa.array(doc[a], pa.int64()), pa.array(pos[a], pa.int32()), pa.array(pos[z], pa.int32()), pa.array(own[a], pa.int64())], ["doc_id", "lo", "hi", "own"])

        for b in batches:
            for shard, doc, pos, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if shard != current or windows >= batch:
                    if held:
                        yield flush()
                        held, windows = [], 0
                    if shard != current:
                        family, current = SuffixFamily(length), shard
                held.append((doc, pos, blob))
                windows += len(blob) // 4 - length + 1
        if held:
            yield flush()

    return segments.repartition(n, "shard").sortWithinPartitions("shard", "doc_id", "pos").mapInArrow(scan, "doc_id bigint, lo int, hi int, own bigint")


def _spans(runs: DataFrame, length: int) -> DataFrame:
    by = Window.partitionBy("doc_id").orderBy("lo", "hi", "own")
    reach = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    return (
        runs.withColumn("new", (reach.isNull() | (F.col("lo") > reach + 1)).cast("int"))
        .withColumn("span", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "span")
        .agg(F.min("lo").alias("start_word"), (F.max("hi") - F.min("lo") + length).cast("int").alias("n_words"), F.min("own").alias("first_doc_id"))
        .drop("span")
    )


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = K, batch: int = BATCH) -> DataFrame:
    """See the module's text."""
    ship(docs.sparkSession)
    texts = _texts(docs)
    places = materialise(_places(texts, length, k))
    marks = materialise(_marks(places, _repeated(places)))
    return _spans(_matches(texts, marks, length, k, batch), length)


class SuffixIndex:
    """A stored index family, to which batches are added: after any number of batches ``spans`` is what
    ``repeated_spans`` gives for all their documents together.

    Each level holds its documents' texts, their windows' names in order, and the matches found so far. A
    batch's names are merged with those of every level; only texts that share a name with it (or with
    each other, in the batch) are matched by suffix arrays. The batch becomes a level; levels of about
    equal size are merged, so a document is rewritten a logarithmic number of times. A batch must hold
    no doc_id that the index has already; a writer that dies leaves the index as it was.
    """

    TABLES = ("texts", "places", "matches")

    def __init__(self, spark: SparkSession, root: str, length: int = LENGTH, k: int = K, batch: int = BATCH):
        ship(spark)
        self.spark, self.store, self.length, self.k, self.batch = spark, Store(spark, root), length, k, batch

    def levels(self) -> list[list]:
        """[folder, number of documents] of each level, largest first."""
        return self.store.settings()["levels"] if self.store.version() is not None else []

    def _read(self, levels: list[list], name: str) -> DataFrame | None:
        parts = [self.spark.read.parquet(f"{self.store.root}/{folder}/{name}") for folder, _ in levels]
        return functools.reduce(DataFrame.unionByName, parts) if parts else None

    def _write(self, folder: str, tables: dict[str, DataFrame]) -> None:
        for name, df in tables.items():
            (df.repartition("name").sortWithinPartitions("name") if name == "places" else df).write.parquet(f"{self.store.root}/{folder}/{name}")

    def add(self, docs: DataFrame) -> None:
        levels = self.levels()
        texts = materialise(_texts(docs))
        if levels and texts.join(self._read(levels, "texts"), "doc_id", "left_semi").limit(1).count():
            raise ValueError("the index has documents of the batch already")
        new = materialise(_places(texts, self.length, self.k))
        old, old_texts = self._read(levels, "places"), self._read(levels, "texts")
        names = _repeated(new)
        if old is not None:
            names = names.union(old.join(new.select("name"), "name", "left_semi").select("name")).distinct()
        names = materialise(names)
        places = new if old is None else new.unionByName(old)
        marks = materialise(_marks(places, names))
        found = _matches(texts if old is None else texts.unionByName(old_texts), marks, self.length, self.k, self.batch)
        name = f"v-{uuid.uuid4().hex}"
        self._write(f"{name}/new", {"texts": texts, "places": new, "matches": found})
        levels = [*levels, [f"{name}/new", texts.count()]]
        merged = 0
        while len(levels) > 1 and levels[-2][1] < 2 * levels[-1][1]:
            last = levels[-2:]
            merged += 1
            self._write(f"{name}/{merged}", {t: self._read(last, t) for t in self.TABLES})
            levels[-2:] = [[f"{name}/{merged}", last[0][1] + last[1][1]]]
        self.store.publish(name, json.dumps({"levels": levels}))

    def spans(self) -> DataFrame:
        return _spans(self._read(self.levels(), "matches"), self.length)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (SELECT doc_id, string_agg(text, ' ' ORDER BY text) AS text
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL) GROUP BY doc_id),
w AS (SELECT doc_id, {T.RAW_SQL.format(text="text")} AS ws FROM d),
win AS (
  SELECT doc_id, p, md5(array_to_string(ws[p : p + {LENGTH - 1}], ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {LENGTH - 2})) AS p FROM w)),
rep AS (SELECT g, min(doc_id) AS own FROM win GROUP BY g HAVING count(*) > 1),
hit AS (SELECT doc_id, p, own, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM win JOIN rep USING (g))
SELECT doc_id, CAST(min(p) - 1 AS INT) AS start_word, CAST(count(*) + {LENGTH - 1} AS INT) AS n_words, min(own) AS first_doc_id
FROM hit GROUP BY doc_id, run
"""
