"""Benchmark decontamination by winnowing.

Both sides are cut into normalised words (lower case, punctuation dropped). Of every ``window``
successive ``k``-grams the smallest hash is kept as a fingerprint; training and test fingerprints are
joined, and each hit is extended word by word in both directions. Any shared span of
``k + window - 1`` words is guaranteed to hold a common fingerprint, so every span of that length or
more is found, with its full extent; shorter extents are dropped.

``contamination`` gives the spans, ``decontaminate`` the rows of ``docs`` without any.

Defined results of ``contamination``: null or empty texts share nothing; rows without an id are ignored;
repeated rows count once; other columns, whatever their names, are ignored; an empty table on either side
gives an empty result; a text shorter than the guarantee can't match; of equal hashes the rightmost is
kept. ``decontaminate`` judges each row by its own text: a row without an id goes or stays like any other,
of several rows of one id those go whose text shares a span, and rows with a null text stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pharos.llm import textkit as T
from pharos.runtime import materialise, ship, table

K, WINDOW = 5, 4
#: Test sets up to so many bytes of text travel to each worker; larger ones are joined by shuffle.
BROADCAST_BYTES = 16 << 20

RESULT = "doc_id bigint, item_id bigint, doc_start int, item_start int, n_words int"


def fingerprints(df: DataFrame, key: str, k: int, window: int) -> DataFrame:
    """(key, pos, hash) of every winnowed fingerprint of column ``text``."""

    def run(batches):
        for b in T.slices(batches):
            w = T.words(b.column(1).to_pylist(), "norm")
            at, h = T.winnow(w, k, window)
            ids = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[w.doc[at]], pa.int64()), pa.array(w.pos()[at], pa.int32()), pa.array(h.view(np.int64))], ["id", "pos", "hash"]
            )

    return _texts(df, key).mapInArrow(run, "id bigint, pos int, hash bigint").withColumnRenamed("id", key)


def _texts(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null and text is not null")


def extend(dh, ddoc, ih, idoc, d, i, distinct: bool = True):
    """Grow hits at words ``d`` (of hashes ``dh`` in documents ``ddoc``) and ``i`` as far as the words agree.

    Returns (document word, item word, length) of each distinct maximal span, or of each hit.
    """
    lo = np.zeros(len(d), np.int64)
    hi = np.zeros(len(d), np.int64)
    for reach, step in ((lo, -1), (hi, 1)):
        live = np.arange(len(d))
        n = 1
        while len(live):
            a, b = d[live] + step * n, i[live] + step * n
            ok = (a >= 0) & (b >= 0) & (a < len(dh)) & (b < len(ih))
            live, a, b = live[ok], a[ok], b[ok]
            same = (dh[a] == ih[b]) & (ddoc[a] == ddoc[d[live]]) & (idoc[b] == idoc[i[live]])
            live = live[same]
            reach[live] = n
            n += 1
    if not distinct:
        return d - lo, i - lo, lo + hi + 1
    spans = np.unique(np.stack([d - lo, i - lo, lo + hi + 1], axis=1), axis=0) if len(d) else np.zeros((0, 3), np.int64)
    return spans[:, 0], spans[:, 1], spans[:, 2]


#: Hits that are held at once: a repetitive text meets a repetitive item at the product of their places.
HITS = 1 << 18


def _match(h, w, fp, starts, places):
    """All (document word, item word) of document fingerprints ``h`` at words ``w`` that ``fp`` holds, in
    parts of about ``HITS``."""
    j = np.searchsorted(fp, h)
    hit = np.flatnonzero((j < len(fp)) & (fp[np.minimum(j, len(fp) - 1)] == h)) if len(fp) else np.zeros(0, np.int64)
    j = j[hit]
    n = starts[j + 1] - starts[j]
    done = np.cumsum(n)
    at = 0
    while at < len(hit):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + HITS, side="right")))
        m = n[at:to]
        off = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        yield np.repeat(w[hit[at:to]], m), places[np.repeat(starts[j[at:to]], m) + off]
        at = to


def spans_of(dh, ddoc, ih, idoc, parts):
    """``extend`` of the hits in all ``parts``. Of the hits on one diagonal only the first is extended, and
    then the first beyond its span, so that a span is grown once in a part however many hits it holds."""
    found = [np.zeros((0, 3), np.int64)]
    for d, i in parts:
        order = np.lexsort((d, d - i))
        d, i = d[order], i[order]
        while len(d):
            line = d - i
            new = np.ones(len(d), bool)
            # another text or item on the same diagonal begins anew
            new[1:] = (line[1:] != line[:-1]) | (ddoc[d[1:]] != ddoc[d[:-1]]) | (idoc[i[1:]] != idoc[i[:-1]])
            first = np.flatnonzero(new)
            a, b, n = extend(dh, ddoc, ih, idoc, d[first], i[first], False)
            found.append(np.unique(np.stack((a, b, n), axis=1), axis=0))
            rest = d >= (a + n)[np.cumsum(new) - 1]
            d, i = d[rest], i[rest]
    spans = np.unique(np.concatenate(found), axis=0)
    return spans[:, 0], spans[:, 1], spans[:, 2]


def _rows(doc_ids, item_ids, w, iw_doc, iw_pos, spans, least):
    d, i, n = spans
    keep = n >= least
    d, i, n = d[keep], i[keep], n[keep]
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_ids[w.doc[d]], pa.int64()), pa.array(item_ids[iw_doc[i]], pa.int64()), pa.array(w.pos()[d], pa.int32()), pa.array(iw_pos[i], pa.int32()), pa.array(n, pa.int32())],
        ["doc_id", "item_id", "doc_start", "item_start", "n_words"],
    )


def contamination(docs: DataFrame, benchmark: DataFrame, k: int = K, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every maximal span of at least ``k + window - 1`` words shared by a document and a benchmark item."""
    ship(docs.sparkSession)
    items = _texts(benchmark, "item_id").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= broadcast_bytes:
        return _small(docs, items, k, window)
    return _large(docs, items, k, window)


def _shared(items: DataFrame, k: int, window: int):
    """The test set's words and fingerprints, for every worker."""
    rows = items.orderBy("id", "text").collect()  # its size was checked: at most broadcast_bytes
    item_ids = np.array([r[0] for r in rows], np.int64)
    iw = T.words([r[1] for r in rows], "norm")
    at, h = T.winnow(iw, k, window)
    order = np.argsort(h, kind="stable")
    fp, starts = np.unique(h[order], return_index=True)
    return items.sparkSession.sparkContext.broadcast((item_ids, iw.hash, iw.doc, iw.pos(), fp, np.append(starts, len(h)), at[order]))


def _small(docs: DataFrame, items: DataFrame, k: int, window: int) -> DataFrame:
    shared = _shared(items, k, window)

    def run(batches):
        ids, ih, idoc, ipos, fps, st, places = shared.value
        for b in T.slices(batches):
            w = T.words(b.column(1).to_pylist(), "norm")
            at, h = T.winnow(w, k, window)
            spans = spans_of(w.hash, w.doc, ih, idoc, _match(h, at, fps, st, places))
            yield _rows(b.column(0).to_numpy(zero_copy_only=False), ids, w, idoc, ipos, spans, k + window - 1)

    return _texts(docs, "doc_id").mapInArrow(run, RESULT).distinct()


def _large(docs: DataFrame, items: DataFrame, k: int, window: int) -> DataFrame:
    left = fingerprints(docs, "doc_id", k, window).withColumnRenamed("pos", "d")
    right = fingerprints(items.withColumnRenamed("id", "item_id"), "item_id", k, window).withColumnRenamed("pos", "i")
    hits = left.join(right, "hash").groupBy("doc_id", "item_id").agg(F.collect_set(F.struct("d", "i")).alias("hits"))
    pairs = (
        hits.join(_texts(docs, "doc_id").select(F.col("id").alias("doc_id"), F.col("text").alias("dtext")), "doc_id")
        .join(items.select(F.col("id").alias("item_id"), F.col("text").alias("itext")), "item_id")
        .select("doc_id", "item_id", "dtext", "itext", "hits.d", "hits.i")
    )

    def run(batches):
        for b in T.slices(batches):
            w, iw = (T.words(b.column(c).to_pylist(), "norm") for c in (2, 3))
            d, i = (b.column(c) for c in (4, 5))
            n = np.diff(d.offsets.to_numpy())
            row = np.repeat(np.arange(len(n)), n)
            dw, it = (w.first[row] + d.flatten().to_numpy(), iw.first[row] + i.flatten().to_numpy())
            ok = (dw < w.first[row + 1]) & (it < iw.first[row + 1])
            dw, it = dw[ok], it[ok]
            same = w.hash[dw] == iw.hash[it]  # an id that several texts carry meets foreign hits here
            spans = extend(w.hash, w.doc, iw.hash, iw.doc, dw[same], it[same])
            yield _rows(b.column(0).to_numpy(), b.column(1).to_numpy(), w, iw.doc, iw.pos(), spans, k + window - 1)

    return pairs.mapInArrow(run, RESULT).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = K, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows whose text shares no guaranteed span with the benchmark; all columns are kept. Against a small
    test set this is one pass without a shuffle."""
    ship(docs.sparkSession)
    items = _texts(benchmark, "item_id").distinct()
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > broadcast_bytes:
        name = F.xxhash64(F.col("text").cast("string"))  # of the text, which may have no other name
        bad = materialise(_large(docs.select(name.alias("doc_id"), "text").where("text is not null").distinct(), items, k, window).select("doc_id").distinct())
        return docs.join(bad, [name == bad["doc_id"], docs["text"].isNotNull()], "left_anti")
    shared = _shared(items, k, window)

    def run(batches):
        _, ih, idoc, _, fps, st, places = shared.value
        for b in T.slices(batches):
            w = T.words(b.column(b.schema.get_field_index("text")).to_pylist(), "norm")
            at, h = T.winnow(w, k, window)
            d, _, n = spans_of(w.hash, w.doc, ih, idoc, _match(h, at, fps, st, places))
            clean = np.ones(b.num_rows, bool)
            clean[w.doc[d[n >= k + window - 1]]] = False
            yield b.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _side(name: str, key: str) -> str:
    t = K + WINDOW - 1
    return f"""(SELECT {key}, p, array_to_string(ws[p : p + {t - 1}], ' ') AS g
      FROM (SELECT {key}, ws, unnest(range(1, len(ws) - {t - 2})) AS p
            FROM (SELECT DISTINCT {key}, {T.NORM_SQL.format(text="text")} AS ws FROM {name} WHERE {key} IS NOT NULL AND text IS NOT NULL)))"""


SQL = f"""
WITH hits AS (
  SELECT DISTINCT d.doc_id, i.item_id, d.p AS dp, i.p AS ip
  FROM {_side("documents", "doc_id")} d JOIN {_side("benchmark", "item_id")} i USING (g)),
runs AS (
  SELECT *, dp - row_number() OVER (PARTITION BY doc_id, item_id, dp - ip ORDER BY dp) AS run FROM hits)
SELECT doc_id, item_id, CAST(min(dp) - 1 AS INT) AS doc_start, CAST(min(ip) - 1 AS INT) AS item_start,
       CAST(count(*) + {K + WINDOW - 2} AS INT) AS n_words
FROM runs GROUP BY doc_id, item_id, dp - ip, run
"""
