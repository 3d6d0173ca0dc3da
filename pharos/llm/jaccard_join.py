"""N-gram Jaccard self-join, size-aware (heavy and light sets), exact.

Each document is the set of its word n-grams (words as in ``textkit``, flavour ``norm``); a text of
fewer words than ``n`` has one gram, all its words. Pairs with ``|A & B| / |A | B| >= threshold`` are
linked.

1. Grams go to shards by hash, packed (seven bytes a gram) in one blob for each slice of documents and
   shard. A shard knows each of its grams' documents; a gram of one document can never match and stays
   behind. Grams of equal documents are one *block*: whoever has one of them has all. Its name is a hash
   of these documents, led by their (rounded) number; only names and numbers of grams return, so the
   copies of a text become a few weighted blocks, however long it is.
2. All sets are ordered by block, rare first. Two sets above the threshold share a gram among the first
   ``s - ceil(threshold * s) + 1`` of each, and share two among the first ``s - ceil(threshold * s) + 2``.
   A document whose unique grams fill that prefix is done: nearly all documents end here, so passages
   shared by many otherwise different documents cost nothing more.
3. Documents of equal sets are represented by their smallest id.
4. Light sets (up to a boundary size) enumerate all subsets of two grams of their prefix (by block) and
   meet on them; each heavy set scans the inverted lists of its prefix, which hold heavy and light sets.
   The boundary is the size at which the sum of both costs is least, from the exact numbers of subsets
   and of pairs that lists and subsets bring together, counted over all sets up to ``SMALL`` grams.
   Long lists are divided in parts, and each two parts are paired by themselves.
5. Each candidate pair is verified by the weights of the blocks that both sets have.

``similar_pairs`` gives ``doc_id < partner_id`` and ``jaccard``: a document whose set equals that of a
smaller id appears once, with the smallest such id and 1.0; all other pairs are between these
representatives. ``all_pairs`` gives the full list of pairs from it. ``classes``, the query, gives one row
for each document that has a link: ``doc_id``, ``class_id`` (the least id among all that links connect,
directly or through others) and ``n_links`` (how many other documents are within the threshold, copies
included; each link counts, though none is a row).

Defined results: null, empty or wordless texts link with nothing; rows without a doc_id are ignored;
a doc_id that occurs in several rows counts as one document, with the union of their grams (so
repeated rows change nothing); ties in the order are broken by hash; other columns are ignored; an
empty table gives an empty result. Grams are compared by a hash of about 46 bits or more, the share
of the shard included, blocks by one of 56; the chance that this changes the overlap of one pair is
about 1e-9.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pharos.llm import textkit as T
from pharos.llm.frames import by_id
from pharos.runtime import materialise, partitions, ship, table

N, THRESHOLD = 3, 0.5
#: Sets up to so many grams may be light.
SMALL = 32
#: What it costs to make and move a subset, in pairs of list entries.
SUBSET_COST = 4
#: Entries of a list that are paired with each other at once.
SPLIT = 4096
#: Pairs that one group of a family verifies.
PAIRS = 200_000
#: Bytes of input whose grams one shard counts, at most about; more shards than Spark's own number are made for it.
SHARD_BYTES = 32 << 20
_LOW = np.uint64((1 << 40) - 1)
_NAME = np.uint64((1 << 56) - 1)


def _pack(tokens: np.ndarray) -> bytes:
    """The low five bytes of each."""
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack(blobs: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return out.view("<u8").ravel()


def gram_sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram hash) of every gram of every text, repeats included."""
    w = T.words(texts, "norm")
    at, h = T.grams(w, n)
    doc = w.doc[at]
    count = np.diff(w.first)
    for m in range(1, n):  # texts of m words: one gram, salted by its length
        if n > m and (short := np.flatnonzero(count == m)).size:
            sub = w.first[short]
            hh = np.zeros(len(sub), np.uint64)
            for i in range(m):
                hh = hh * T.GRAM_BASE + w.hash[sub + i]
            doc, h = np.concatenate((doc, short)), np.concatenate((h, T.mix(hh + np.uint64(m))))
    return doc, h


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal (sorted) keys."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _lengths(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (``size[0]`` of them), then start[1], ..."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def _blobs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values: ``values`` cut at ``ends`` (numbers of items)."""
    width = values.dtype.itemsize
    offsets = np.concatenate(([0], ends)).astype(np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _plain_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, texts): the texts of each doc_id, which is unique. Its rows come in the same order whenever
    a task is run again, as the names of slices need."""
    one, merged = by_id(docs)
    return materialise(one) if merged or "Exchange" in docs._jdf.queryExecution().executedPlan().toString() else one


def _shards(docs: DataFrame) -> int:
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # Catalyst's estimate: no pass over the data
    return max(partitions(docs.sparkSession), size // SHARD_BYTES if size < 1 << 60 else 0)


def gram_table(docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """One row for each document that may have a partner: its size, the number of its grams in the prefix
    that aren't unique, a hash of its set if no gram is unique, and its blocks (``names``, sorted, and
    ``counts``, the grams in each)."""
    shards = _shards(docs)
    packed = "part int, slice bigint, rows binary, names binary, counts binary, ids binary, sizes binary"

    def batch(cols):
        types = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["part", "slice", "rows", "names", "counts", "ids", "sizes"])

    def spread(batches):
        for c in T.slices(batches, 1024):
            ids = np.ascontiguousarray(c.column(0).to_numpy(zero_copy_only=False).astype("<i8"))
            lists = c.column(1)
            row, h = gram_sets(lists.flatten().to_pylist(), n)
            if not len(row):
                continue
            row = np.repeat(np.arange(c.num_rows), np.diff(lists.offsets.to_numpy()))[row]
            part = ((h >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)
            low = h & _LOW
            order = np.lexsort((low, part * c.num_rows + row))
            part, row, low = part[order], row[order], low[order]
            first = _runs(part, row, low)
            part, row, low = part[first], row[first], low[first]
            sizes = np.bincount(row, minlength=c.num_rows).astype("<u4")
            name = xxhash.xxh64_intdigest(ids.tobytes()) - (1 << 63)
            a = _runs(part)
            z = np.append(a[1:], len(part))
            rows16 = row.astype("<u2")
            none = [None] * len(a)
            yield batch([
                [*part[a].tolist(), name % shards], [name] * (len(a) + 1), [*(rows16[i:j].tobytes() for i, j in zip(a.tolist(), z.tolist(), strict=True)), None],
                [*(_pack(low[i:j]) for i, j in zip(a.tolist(), z.tolist(), strict=True)), None], [*none, None], [*none, ids.tobytes()], [*none, sizes.tobytes()],
            ])

    def count(batches):
        slices, rows, grams, held, size = [], [], [], [], []
        for b in batches:
            head = b.column(5).is_valid().to_numpy(zero_copy_only=False)
            if head.any():
                yield b.filter(pa.array(head))
                b = b.filter(pa.array(~head))
            slices.append(b.column(1).to_numpy())
            blobs = b.column(2).to_pylist()
            size.append(np.array([len(x) // 2 for x in blobs], np.int64))
            rows.append(np.frombuffer(b"".join(blobs), "<u2"))
            grams.append(_unpack(b.column(3).to_pylist()))
        if not grams:
            return
        slices, size, rows, grams = (np.concatenate(x) for x in (slices, size, rows, grams))
        blob = np.repeat(np.arange(len(size), dtype=np.int32), size)
        order = np.argsort(grams, kind="stable")
        starts = _runs(grams[order])
        freq = _lengths(starts, len(order))
        many = freq > 1
        keep = order[_ranges(starts[many], freq[many])]
        freq = freq[many]
        del order, grams
        blob, rows = blob[keep], rows[keep]
        who = T.mix(slices.view(np.uint64)[blob] + T.mix(rows.astype(np.uint64) + np.uint64(1)))
        ends = np.cumsum(freq)
        total = np.add.reduceat(who, ends - freq) if len(freq) else who
        # frequencies in eighths of a power of two: any order works, if all documents use the same
        level = np.minimum(255, np.log2(np.maximum(freq, 1)) * 8).astype(np.uint64)
        name = np.repeat((level << np.uint64(56)) | (T.mix(total) & _NAME), freq)
        order = np.lexsort((name, rows, blob))
        blob, rows, name = blob[order], rows[order], name[order]
        first = _runs(blob, rows, name)
        grams_of = _lengths(first, len(name)).astype("<u4")
        blob, rows, name = blob[first], rows[first].astype("<u2"), name[first]
        a = _runs(blob)
        z = np.append(a[1:], len(blob))
        whose = slices[blob[a]]
        for k in range(0, len(a), 256):
            cut = list(zip(a[k : k + 256].tolist(), z[k : k + 256].tolist(), strict=True))
            none = [None] * len(cut)
            yield batch([none, whose[k : k + 256], *([x[i:j].tobytes() for i, j in cut] for x in (rows, name, grams_of)), none, none])

    def gather(batches):
        now, held = None, []

        def sets():
            ids, sizes = (next((r[k] for r in held if r[k] is not None), None) for k in (3, 4))
            if ids is None:
                raise RuntimeError("a slice of documents changed its rows when its task was run again")
            ids, sizes = np.frombuffer(ids, "<i8"), np.frombuffer(sizes, "<u4").astype(np.int64)
            blobs = [r for r in held if r[0] is not None]
            if not blobs:
                return
            row = np.frombuffer(b"".join(r[0] for r in blobs), "<u2").astype(np.int64)
            name, grams_of = np.frombuffer(b"".join(r[1] for r in blobs), "<u8"), np.frombuffer(b"".join(r[2] for r in blobs), "<u4").astype(np.int64)
            order = np.lexsort((name, row))
            row, name, grams_of = row[order], name[order], grams_of[order]
            first = _runs(row, name)
            grams_of = np.add.reduceat(grams_of, first)
            row, name = row[first], name[first]
            a = _runs(row)
            n_names = _lengths(a, len(row))
            have = np.add.reduceat(grams_of, a)
            s = sizes[row[a]]
            prefix = s - np.ceil(threshold * s - 1e-9).astype(np.int64) + 1 - (s - have)
            whole = np.bitwise_xor.reduceat(T.mix(name + grams_of.astype(np.uint64)), a).view(np.int64)
            ok = prefix > 0
            if not ok.any():
                return
            pick = _ranges(a[ok], n_names[ok])
            ends = np.cumsum(n_names[ok])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[row[a][ok]]), pa.array(s[ok].astype(np.int32)), pa.array(prefix[ok].astype(np.int32)), pa.array(whole[ok], mask=have[ok] < s[ok]), _blobs(name[pick], ends), _blobs(grams_of[pick].astype("<u4"), ends)],
                ["doc_id", "size", "prefix", "whole", "names", "counts"],
            )

        for b in batches:
            for key, *row in zip(*(b.column(j).to_pylist() for j in (1, 2, 3, 4, 5, 6)), strict=True):
                if key != now:
                    if held:
                        yield from sets()
                    now, held = key, []
                held.append(row)
        if held:
            yield from sets()

    return (
        _plain_texts(docs).mapInArrow(spread, packed)
        .repartitionById(shards, "part")
        .mapInArrow(count, packed)
        .repartition(shards, "slice").sortWithinPartitions("slice")
        .mapInArrow(gather, "doc_id bigint, size int, prefix int, whole bigint, names binary, counts binary")
    )


def _unpacked(names: pa.Array, counts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(blocks of each set, names of all sets, their counts)."""
    blobs = names.to_pylist()
    size = np.array([len(x) // 8 for x in blobs], np.int64)
    return size, np.frombuffer(b"".join(blobs), "<u8"), np.frombuffer(b"".join(counts.to_pylist()), "<u4").astype(np.int64)


def _prefixes(sets: DataFrame) -> DataFrame:
    """(block, before, place, doc_id, size, n, extra) of the blocks that the first ``prefix + 1`` grams (not
    counting unique ones) of each set begin; ``n`` of these grams are in the block, which is extra if its
    first one is the last of them; ``before`` is a hash of the block before it (0: none), ``place`` the number
    of grams before it."""

    def run(batches):
        for b in T.slices(batches, 2000):
            ids, size, prefix = (b.column(i).to_numpy() for i in range(3))
            blocks, name, grams_of = _unpacked(b.column(3), b.column(4))
            row = np.repeat(np.arange(len(blocks)), blocks)
            ends = np.cumsum(grams_of)
            begin = np.cumsum(blocks) - blocks
            have = np.add.reduceat(grams_of, begin) if len(begin) else begin
            at = ends - grams_of - (np.cumsum(have) - have)[row]
            before = np.concatenate((np.zeros(min(1, len(name)), np.uint64), T.mix(name[:-1]) | np.uint64(1)))
            before[begin] = 0
            left = prefix[row] + 1 - at
            ok = np.flatnonzero(left > 0)
            row, at, left = row[ok], at[ok], left[ok]
            cols = [name[ok].view(np.int64), before[ok].astype(np.uint32).view(np.int32), (at + (size - have)[row]).astype(np.int32), ids[row], size[row], np.minimum(grams_of[ok], left).astype(np.int32), left == 1]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["block", "before", "place", "doc_id", "size", "n", "extra"])

    return sets.select("doc_id", "size", "prefix", "names", "counts").mapInArrow(run, "block bigint, before int, place int, doc_id bigint, size int, n int, extra boolean")


def always_heavy(threshold: float):
    """Sets of which one shared gram can be enough count as heavy, however small."""
    return F.ceil(F.col("size") * threshold - 1e-9) < 2


def subsets(prefix: DataFrame) -> DataFrame:
    """(doc_id, size, g1, g2): subsets of two grams of each set's extended prefix, by their blocks (once for
    each two blocks, and once for a block that holds two of the grams)."""
    sets = prefix.groupBy("doc_id", "size").agg(F.sort_array(F.collect_list(F.struct("block", "n"))).alias("g"))
    first = sets.select("doc_id", "size", F.posexplode("g").alias("i", "x"), "g")
    later = F.slice("g", F.col("i") + 2, F.size("g"))
    both = F.concat(F.when(F.col("x.n") > 1, F.array("x")).otherwise(F.slice("g", 1, 0)), later)
    return first.select("doc_id", "size", F.col("x.block").alias("g1"), F.explode(both).alias("y")).select("doc_id", "size", "g1", F.col("y.block").alias("g2"))


def costs(prefix: DataFrame, threshold: float, small: int = SMALL) -> list[tuple[int, int, int, int]]:
    """(size, subsets, pairs that meet on subsets, pairs that meet in lists) for each size up to ``small``: of
    pairs between sets up to that size, counted with the larger one. Exact; at most ``small`` rows."""
    few = prefix.where((F.col("size") <= small) & ~always_heavy(threshold))

    def pairs(entries: DataFrame, key: list[str], name: str) -> DataFrame:
        n = entries.groupBy(*key, "size").agg(F.count("*").alias("n"))
        smaller = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return n.select("size", "n", smaller.alias("s")).groupBy("size").agg(F.sum("n").alias(f"n_{name}"), F.sum(F.col("n") * F.col("s") + F.col("n") * (F.col("n") - 1) / 2).cast("long").alias(name))

    met, listed = pairs(subsets(few), ["g1", "g2"], "met"), pairs(few.where("not extra"), ["block"], "listed")
    rows = met.join(listed, "size", "full").select("size", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_met", "met", "listed"))).collect()
    return sorted(tuple(r) for r in rows)


def boundary(found: list[tuple[int, int, int, int]]) -> int:
    """The largest light size: where enumerating subsets up to it and scanning lists beyond costs least.

    Lists cost the pairs in them that hold a heavy set; subsets cost ``SUBSET_COST`` each and their pairs.
    """
    best = total = light = 0
    for size, made, met, listed in found:
        total += SUBSET_COST * made + met - listed
        if total < best:
            best, light = total, size
    return light


#: Pairs of list entries that one step of a scan makes, and pairs that a task holds to find those it has already.
STEP, POOL = 1 << 20, 1 << 22


def scan_lists(group, side, before, place, doc, size, heavy, threshold: float):
    """Pairs of the inverted lists in these columns, sorted by group, side and heavy sets first, of which
    one is heavy. Entries of side 0 are paired with those of side 1, or with each other if there is none.

    A pair is given at its first common block only, as far as that can be told: where the block before is
    the same in both sets, the pair has met there already. (The first common block of a pair has no such
    block before it, so no pair is lost; hashes of the block before agree by chance in 2e-10 of cases.)
    """
    starts = _runs(group)
    n = _lengths(starts, len(group))
    other = np.add.reduceat(side, starts) if len(starts) else n  # entries of side 1
    end = np.repeat(starts + n, n)
    at = np.arange(len(group))
    alone = np.repeat(other == 0, n)
    begin = np.where(alone, at + 1, end - np.repeat(other, n))
    partners = np.where(side == 1, 0, end - begin)
    partners[alone & ~heavy] = 0  # only light sets come after a light one
    done = np.cumsum(partners)
    ratio = threshold / (1 + threshold)
    at = 0
    while at < len(group):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + STEP, side="right")))
        i = np.repeat(np.arange(at, to), partners[at:to])
        j = _ranges(begin[at:to], partners[at:to])
        ok = (heavy[i] | heavy[j]) & (doc[i] != doc[j]) & ((before[i] != before[j]) | (before[i] == 0))
        i, j = i[ok], j[ok]
        low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        rest = np.minimum(size[i] - place[i], size[j] - place[j])
        ok = (low >= high * threshold) & (rest >= np.ceil((low + high) * ratio - 1e-9))
        yield doc[i[ok]], doc[j[ok]]
        at = to


def candidates(prefix: DataFrame, light: int, threshold: float) -> DataFrame:
    """Distinct pairs a < b that share enough of their prefixes."""
    n = partitions(prefix.sparkSession)

    def scan(batches):
        held, pool = [], []

        def distinct():
            a, b = (np.concatenate(x) for x in zip(*pool, strict=True))
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            first = _runs(a, b)
            return a[first], b[first]

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["a", "b"])

        def pairs(cols):
            for a, b in scan_lists(*cols, threshold):
                pool.append((np.minimum(a, b), np.maximum(a, b)))
                if sum(len(x) for x, _ in pool) > POOL:
                    pool[:] = [distinct()]
                    if len(pool[0][0]) > POOL // 2:
                        yield rows(pool.pop())

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(cols[0]):
                continue
            held = [np.concatenate(x) for x in zip(held, cols, strict=True)] if held else cols
            if len(held[0]) < STEP // 4:
                continue
            cut = int((np.flatnonzero(np.diff(held[0])) + 1).max(initial=0))  # the last group may go on
            if cut:
                yield from pairs([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held:
            yield from pairs(held)
        if pool:
            yield rows(distinct())

    heavy = (F.col("size") > light) | always_heavy(threshold)
    entries = prefix.where("not extra").select("block", "before", "place", "doc_id", "size", heavy.alias("heavy"))
    # lists of one leader go to one task: a family's pairs meet in many lists, nearly all of which have its least document
    lists = entries.groupBy("block").agg(F.min("doc_id").alias("leader"), F.ceil(F.count("*") / SPLIT).cast("int").alias("m"), F.count("*").alias("long")).where("long > 1")
    each = entries.join(lists, "block").withColumn("own", F.pmod(F.xxhash64("doc_id"), "m").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    pair = [F.least("own", "other"), F.greatest("own", "other")]
    whole = F.col("m") == 1
    grouped = each.select(
        F.when(whole, F.col("leader")).otherwise(F.xxhash64("leader", *pair)).alias("route"), F.when(whole, F.col("block")).otherwise(F.xxhash64("block", *pair)).alias("group"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "before", "place", "doc_id", "size", "heavy",
    )
    scanned = grouped.repartition(n, "route").sortWithinPartitions("route", "group", "side", F.desc("heavy")).drop("route").mapInArrow(scan, "a bigint, b bigint")
    if not light:
        return scanned.distinct()
    made = subsets(prefix.where(~heavy))
    low, high = F.least("x.size", "y.size"), F.greatest("x.size", "y.size")
    met = (
        made.alias("x")
        .join(made.alias("y"), (F.col("x.g1") == F.col("y.g1")) & (F.col("x.g2") == F.col("y.g2")) & (F.col("x.doc_id") < F.col("y.doc_id")))
        .where(low >= high * threshold)
        .select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
    )
    return scanned.union(met).distinct()


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index among all that the edges connect with each of ``n``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verify(pairs: DataFrame, sets: DataFrame, threshold: float, links: bool) -> DataFrame:
    """Exact Jaccard of the pairs a < b: (doc_id, partner_id, jaccard), or, if ``links``, (doc_id, root,
    n_links): of the links in one group of pairs, each document's number of them, weighted by the partners'
    copies (``n``), and the least document that they connect it with.

    Pairs go by the smallest partner of their ``a``: in a family of similar sets that is one and the same
    set, so each set travels once for its family instead of once for each pair. Families of many pairs
    are divided by ``a``.
    """
    spark = pairs.sparkSession
    least = pairs.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("m"))
    keyed = pairs.join(least, "a", "left").select(F.coalesce("m", "a").alias("key"), "a", "b")
    many = keyed.groupBy("key").agg(F.ceil(F.count("*") / PAIRS).alias("many")).where("many > 1")
    keyed = materialise(keyed.join(many, "key", "left").select("key", F.pmod(F.xxhash64("a"), F.coalesce("many", F.lit(1))).cast("int").alias("part"), "a", "b"))
    need = keyed.select("key", "part", F.col("a").alias("doc_id")).union(keyed.select("key", "part", "b")).distinct()
    none = F.lit(None)
    have = need.join(sets.select("doc_id", "size", "n", "names", "counts"), "doc_id").select("key", "part", F.col("doc_id").alias("a"), none.cast("long").alias("b"), "size", "n", "names", "counts")
    asked = keyed.select("key", "part", "a", "b", none.cast("int").alias("size"), none.cast("long").alias("n"), none.cast("binary").alias("names"), none.cast("binary").alias("counts"))

    def run(batches):
        now, held = None, []

        def group(rows):
            ids, partner = rows[0], rows[1]
            base = int(np.searchsorted(partner >= 0, True)) if len(partner) else 0
            names_of, counts_of = rows[4][:base], rows[5][:base]
            blocks = np.array([len(x) // 8 for x in names_of], np.int64)
            name, weight = np.frombuffer(b"".join(names_of), "<u8"), np.frombuffer(b"".join(counts_of), "<u4").astype(np.int64)
            begin = np.cumsum(blocks) - blocks
            docs, size, copies = ids[:base], rows[2][:base], rows[3][:base]  # sorted by id
            a, b = (np.searchsorted(docs, x[base:]) for x in (ids, partner))
            starts = _runs(a)
            both = np.zeros(len(a), np.int64)
            for s, e in zip(starts.tolist(), np.append(starts[1:], len(a)).tolist(), strict=True):
                x = slice(begin[a[s]], begin[a[s]] + blocks[a[s]])
                mine, count = name[x], weight[x]
                them = b[s:e]
                for k in range(0, len(them), 2000):
                    t = them[k : k + 2000]
                    theirs = name[_ranges(begin[t], blocks[t])]
                    at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                    same = np.where(mine[at] == theirs, count[at], 0)
                    both[s + k : s + k + len(t)] = np.add.reduceat(same, np.cumsum(blocks[t]) - blocks[t])
            j = both / (size[a] + size[b] - both)
            ok = j >= threshold
            a, b, j = a[ok], b[ok], j[ok]
            if not links:
                return pa.RecordBatch.from_arrays([pa.array(docs[a]), pa.array(docs[b]), pa.array(j)], ["doc_id", "partner_id", "jaccard"])
            n = np.bincount(a, copies[b], len(docs)) + np.bincount(b, copies[a], len(docs))
            some = np.flatnonzero(n)
            return pa.RecordBatch.from_arrays([pa.array(docs[some]), pa.array(docs[_roots(len(docs), a, b)[some]]), pa.array(n[some].astype(np.int64))], ["doc_id", "root", "n_links"])

        def columns(parts):
            return [np.concatenate(x) if k < 4 else [y for z in x for y in z] for k, x in enumerate(zip(*parts, strict=True))]

        for batch in batches:
            key, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            a, b, size, n = (batch.column(i).fill_null(-1).to_numpy() for i in (2, 3, 4, 5))
            names, counts = (batch.column(i).to_pylist() for i in (6, 7))
            cut = _runs(key, part)
            for s, e in zip(cut.tolist(), np.append(cut[1:], len(key)).tolist(), strict=True):
                if (k := (key[s], part[s])) != now:
                    if held:
                        yield group(columns(held))
                    now, held = k, []
                held.append((a[s:e], b[s:e], size[s:e].astype(np.int64), n[s:e], names[s:e], counts[s:e]))
        if held:
            yield group(columns(held))

    together = have.unionByName(asked).repartition(partitions(spark), "key", "part").sortWithinPartitions("key", "part", F.col("b").isNotNull(), "a")
    return together.mapInArrow(run, "doc_id bigint, root bigint, n_links bigint" if links else "doc_id bigint, partner_id bigint, jaccard double")


def _joined(docs: DataFrame, n: int, threshold: float, light: int | None, links: bool) -> tuple[DataFrame, DataFrame]:
    """(copies: rep, doc_id; verified pairs or links between representatives)."""
    ship(docs.sparkSession)
    sets = materialise(gram_table(docs, n, threshold))
    equal = sets.where("whole is not null").groupBy("whole", "size").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    members = materialise(sets.select("doc_id", "size", "whole").join(equal, ["whole", "size"]).select("rep", "doc_id", "n"))
    copies = members.where("doc_id != rep").select("rep", "doc_id")
    counted = members.where("doc_id = rep").select("doc_id", "n")
    single = sets.join(copies.select("doc_id"), "doc_id", "left_anti").join(counted, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    prefix = materialise(_prefixes(single))
    pairs = materialise(candidates(prefix, boundary(costs(prefix, threshold)) if light is None else light, threshold))
    return copies, _verify(pairs, single, threshold, links)


def similar_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, light: int | None = None) -> DataFrame:
    """See the module's text. ``threshold`` is above 0 and at most 1; ``light`` overrides the boundary."""
    copies, pairs = _joined(docs, n, threshold, light, False)
    return pairs.unionByName(copies.select(F.col("rep").alias("doc_id"), F.col("doc_id").alias("partner_id"), F.lit(1.0).alias("jaccard")))


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, light: int | None = None) -> DataFrame:
    """One row for each document that has a link, see the module's text."""
    copies, found = _joined(docs, n, threshold, light, True)
    found = materialise(found)
    near = found.groupBy("doc_id").agg(F.sum("n_links").alias("n_links"))
    label = groups(found.where("doc_id != root").select(F.col("root").alias("doc_id"), F.col("doc_id").alias("partner_id")))
    reps = copies.groupBy("rep").agg(F.count("*").alias("n"))
    one = (
        near.join(reps.withColumnRenamed("rep", "doc_id"), "doc_id", "full").join(label, "doc_id", "left")
        .select("doc_id", F.coalesce("group_id", "doc_id").alias("class_id"), (F.coalesce("n_links", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n_links"))
    )
    one = materialise(one)
    return one.unionByName(copies.join(one.withColumnRenamed("doc_id", "rep"), "rep").select("doc_id", "class_id", "n_links"))


def all_pairs(pairs: DataFrame) -> DataFrame:
    """Every pair of documents above the threshold, in the same columns, from the result of
    ``similar_pairs``: each document stands for all whose set equals its own."""
    near = pairs.where("jaccard < 1")
    copies = pairs.where("jaccard = 1").select(F.col("doc_id").alias("rep"), F.col("partner_id").alias("doc"))
    reps = pairs.select(F.col("doc_id").alias("rep")).union(near.select("partner_id")).distinct()
    members = materialise(copies.union(reps.select("rep", F.col("rep").alias("doc"))))
    x, y = members.select("rep", F.col("doc").alias("x")), members.select(F.col("rep").alias("other"), F.col("doc").alias("y"))
    equal = x.join(y, (F.col("rep") == F.col("other")) & (F.col("x") < F.col("y"))).select("x", "y", F.lit(1.0).alias("jaccard"))
    apart = near.withColumnsRenamed({"doc_id": "rep", "partner_id": "other"}).join(x, "rep").join(y, "other").select("x", "y", "jaccard")
    return equal.union(apart).select(F.least("x", "y").alias("doc_id"), F.greatest("x", "y").alias("partner_id"), "jaccard")


def groups(pairs: DataFrame) -> DataFrame:
    """Connected components of the pairs: (doc_id, group_id), the group's smallest id.

    Each round takes the smallest label among neighbours and then the label of that label, so the
    rounds grow with the logarithm of a chain's length; each is written to the shared folder.
    """
    e = pairs.select(F.col("doc_id").alias("u"), F.col("partner_id").alias("v"))
    e = materialise(e.union(e.select("v", "u")).distinct())
    label = e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("l"))
    while True:
        label = materialise(label)
        near = e.join(label.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        step = label.join(near, "u").select("u", F.least("l", "m").alias("l"))
        up = step.select(F.col("u").alias("l"), F.col("l").alias("top"))
        new = materialise(step.join(up, "l", "left").select("u", F.least("l", F.coalesce("top", "l")).alias("l")))
        if not new.join(label.withColumnRenamed("l", "old"), "u").where("l != old").limit(1).count():
            return new.select(F.col("u").alias("doc_id"), F.col("l").alias("group_id"))
        label = new


def keep_one(docs: DataFrame, **kw) -> DataFrame:
    """Of each class of linked documents the one of the smallest doc_id. Rows of one doc_id are one
    document, they stay or go together; rows without a doc_id stay."""
    drop = materialise(classes(docs, **kw).where("doc_id != class_id").select("doc_id"))
    return docs.join(drop, "doc_id", "left_anti").select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {T.NORM_SQL.format(text="text")} AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) < {N} THEN [array_to_string(ws, ' ')]
         ELSE [array_to_string(ws[i : i + {N - 1}], ' ') FOR i IN range(1, len(ws) - {N - 2})] END)) AS g
  FROM w WHERE len(ws) > 0),
grams AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM sets),
linked AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM grams a JOIN grams b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= {THRESHOLD}),
reach AS (
  SELECT a, b FROM linked
  UNION
  SELECT reach.a, linked.b FROM reach JOIN linked ON reach.b = linked.a)
SELECT doc_id, class_id, n_links
FROM (SELECT a AS doc_id, least(a, min(b)) AS class_id FROM reach GROUP BY a)
JOIN (SELECT a AS doc_id, count(*) AS n_links FROM linked GROUP BY a) USING (doc_id)
"""
