"""Approximate nearest neighbours by score-aware (anisotropic) quantisation, for inner products.

Vectors are clustered by coarse centroids; the residual of each vector from its centroid is product
quantised: pairs of dimensions with 16 codewords each, four bits a pair. Codes are chosen to minimise
``h_parallel * |parallel error|^2 + |orthogonal error|^2``, the error being split along the vector
itself: error along it changes large inner products most, so it costs more. Codebooks are trained
under the same loss.

Queries are the vectors whose id is divisible by ``every`` (1: all), each against all vectors. A query
visits the clusters of largest inner product, as many as hold ``COVERAGE`` of the true neighbours (few
where the vectors cluster, most where they don't), and scans their four-bit codes through its own
tables of partial products (two codes are one byte, so one lookup serves four dimensions). The longest
vectors of the table (the square root of their number, at most ``BLOCK``), which can be neighbours of
most queries wherever they lie, are scored for every query. Of all that a query has met, the
``rerank`` best by these scores meet their vectors and are scored exactly; the ``k`` best of them are
its neighbours. A vector isn't its own neighbour. The visits are measured on the whole table: ``ASKED``
queries of least hash are scored exactly against all vectors, in one pass.

Only codes (a quarter of a byte a dimension) go to the scans; clusters are split into blocks of at most
``BLOCK`` vectors and their queries into groups of about ``GROUP``, so no task holds a whole large
cluster or all queries of a popular one; their number follows the square root of the number of vectors.
Centroids and codebooks are fitted on a bounded sample (``SAMPLE`` vectors of least hash); every vector
is indexed.

Result: ``vec_id, neighbor_id, rank, score`` (rank from 1, float64 inner products).

Defined results: rows whose id or vector is null, holds a null or a number that isn't finite, or
differs in length from most others are neither queries nor answers; repeated rows of one id count once
(the least vector); ties of score go to the smaller id; fewer than k other vectors give fewer rows;
zero vectors score 0 with all; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pharos.runtime import materialise, partitions, ship, table

K, RERANK = 10, 100
#: Every so many ids, one is a query.
EVERY = 100
BLOCK, GROUP, SAMPLE = 2048, 65_536, 20_000
#: Scanned candidates that a task holds before it keeps the best of each query.
HELD = 1 << 20
#: Share of the true neighbours that the visited clusters hold, and the queries by which it is measured.
COVERAGE, ASKED = 0.97, 500
#: Weight of the error along the vector against that across it.
H_PARALLEL = 4.0


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _closest(x, c)
        order = np.argsort(own, kind="stable")
        used, first = np.unique(own[order], return_index=True)
        c[used] = np.add.reduceat(x[order], first) / np.diff(np.append(first, len(x)))[:, None]
    return c


def _closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Index of the closest of ``c`` to each row of ``x``, in bounded memory."""
    sq = (c * c).sum(1)
    return np.concatenate([np.argmin(sq - 2 * x[s : s + BLOCK] @ c.T, axis=1) for s in range(0, max(len(x), 1), BLOCK)])


class Quantiser:
    """Coarse centroids and codebooks (pairs of dimensions x 16 x 2)."""

    def __init__(self, sample: np.ndarray, clusters: int, h: float = H_PARALLEL, rounds: int = 6):
        sample = np.asarray(sample, np.float32)
        self.h = np.float32(h)
        self.dim = sample.shape[1]
        self.pad = -self.dim % 4  # two pairs make a byte
        self.centroids = kmeans(sample, clusters)
        own = self.assign(sample)
        r, unit = self._split(sample, own)
        m = r.shape[1]
        self.books = np.stack([kmeans(r[:, j], 16, seed=j) for j in range(m)])
        if self.books.shape[1] < 16:
            self.books = np.concatenate((self.books, np.repeat(self.books[:, :1], 16 - self.books.shape[1], axis=1)), axis=1)
        for _ in range(rounds):
            codes = self.encode(sample, own)
            self._refit(r, unit, codes)

    def assign(self, x: np.ndarray) -> np.ndarray:
        return _closest(x.astype(np.float32, copy=False), self.centroids)

    def _pairs(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.pad))).reshape(len(x), -1, 2)

    def _split(self, x: np.ndarray, own: np.ndarray):
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return self._pairs(x - self.centroids[own]), self._pairs(x / np.where(norm > 0, norm, 1))

    def encode(self, x: np.ndarray, own: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent on the anisotropic loss: |e|^2 + (h - 1) * (e . x / |x|)^2."""
        if len(x) > BLOCK:  # bounds the errors of all choices that are held at once
            return np.concatenate([self.encode(x[s : s + BLOCK], own[s : s + BLOCK], sweeps) for s in range(0, len(x), BLOCK)])
        r, u = self._split(x, own)
        n, m = r.shape[:2]
        e0 = r[:, :, None, :] - self.books[None]  # error of each choice
        sq = (e0 * e0).sum(3)
        along = (e0 * u[:, :, None, :]).sum(3)
        code = sq.argmin(2)
        rows = np.arange(n)
        total = np.take_along_axis(along, code[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(sweeps):
            for j in range(m):
                rest = total - along[rows, j, code[:, j]]
                loss = sq[:, j] + (self.h - 1) * (rest[:, None] + along[:, j]) ** 2
                code[:, j] = loss.argmin(1)
                total = rest + along[rows, j, code[:, j]]
        return code.astype(np.uint8)

    def _refit(self, r: np.ndarray, u: np.ndarray, code: np.ndarray) -> None:
        """Codewords of least loss for fixed codes, one pair of dimensions at a time."""
        n, m = code.shape
        e = r - self.books[np.arange(m)[None], code]
        total = (e * u).sum((1, 2))
        for j in range(m):
            c = code[:, j]
            rest = total - (e[:, j] * u[:, j]).sum(1)
            g = self.h - 1
            uj, by = u[:, j], lambda x: np.bincount(c, x, minlength=16)  # noqa: B023
            b = r[:, j] + g * ((r[:, j] * uj).sum(1) + rest)[:, None] * uj
            size = by(np.ones(n))
            cross = g * by(uj[:, 0] * uj[:, 1])
            lhs = np.stack((size + g * by(uj[:, 0] ** 2), cross, cross, size + g * by(uj[:, 1] ** 2)), axis=1).reshape(16, 2, 2)
            rhs = np.stack((by(b[:, 0]), by(b[:, 1])), axis=1)
            used = size > 0
            self.books[j, used] = np.linalg.solve(lhs[used], rhs[used][:, :, None])[:, :, 0]
            e[:, j] = r[:, j] - self.books[j, c]
            total = rest + (e[:, j] * u[:, j]).sum(1)

    def packed(self, code: np.ndarray) -> np.ndarray:
        return code[:, 0::2] | (code[:, 1::2] << 4)

    def scan(self, q: np.ndarray, cluster: int, packed: np.ndarray) -> np.ndarray:
        """Approximate inner products: queries x vectors of one cluster."""
        tables = np.einsum("qmd,mcd->qmc", self._pairs(q), self.books).astype(np.float32)
        two = (tables[:, 0::2, None, :] + tables[:, 1::2, :, None]).reshape(len(q), -1, 256)
        out = np.repeat((q @ self.centroids[cluster]).astype(np.float32)[:, None], len(packed), axis=1)
        for j in range(packed.shape[1]):
            out += two[:, j][:, packed[:, j]]
        return out


def _vectors(column: pa.Array, kind: type = np.float32) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(n, -1) if n else np.zeros((0, 0), kind)


def usable(vectors: DataFrame) -> DataFrame:
    """(id, v) of the rows that take part, one for each id."""
    v = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("v"))
    v = v.where("id is not null and v is not null and size(v) > 0").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    common = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).select("d")
    return v.join(F.broadcast(common), F.size("v") == F.col("d")).groupBy("id").agg(F.min("v").alias("v"))


def dot(a: str, b: str):
    """The float64 inner product of two columns of vectors, summed from the left."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)


def indexed(v: DataFrame, shared) -> DataFrame:
    """(id, v, cluster, code) of every vector."""

    def run(batches):
        q = shared.value
        for whole in batches:
            for s in range(0, whole.num_rows, BLOCK):
                b = whole.slice(s, BLOCK)
                x = _vectors(b.column(1))
                own = q.assign(x)
                codes = q.packed(q.encode(x, own))
                ends = np.arange(len(x) + 1, dtype=np.int32) * codes.shape[1]
                blob = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(codes))])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own.astype(np.int32)), blob], ["id", "v", "cluster", "code"])

    return v.mapInArrow(run, "id bigint, v array<float>, cluster int, code binary")


def visits_for(index: DataFrame, shared, asked: tuple[np.ndarray, np.ndarray], head: np.ndarray, k: int, coverage: float) -> int:
    """Clusters to visit so that these and ``head`` (ids) hold ``coverage`` of the exact k nearest, among
    all vectors of ``index``, of the ``asked`` (ids, vectors)."""
    both = index.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        ids, x = both.value
        best = [np.zeros((len(ids), 0), t) for t in (np.float32, np.int64, np.int32)]
        for whole in batches:
            for s in range(0, whole.num_rows, BLOCK):
                b = whole.slice(s, BLOCK)
                other, cluster = b.column(0).to_numpy(), b.column(2).to_numpy()
                score = x @ _vectors(b.column(1)).T
                score[ids[:, None] == other[None]] = -np.inf
                best = [np.concatenate(p, axis=1) for p in zip(best, (score, np.broadcast_to(other, score.shape), np.broadcast_to(cluster, score.shape)), strict=True)]
                if best[0].shape[1] > k:
                    top = np.argpartition(-best[0], k - 1, axis=1)[:, :k]
                    best = [np.take_along_axis(p, top, 1) for p in best]
        ok = np.isfinite(best[0])
        cols = [np.repeat(np.arange(len(ids)), ok.sum(1)), *(p[ok] for p in best)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["at", "score", "other", "cluster"])

    rank = Window.partitionBy("at").orderBy(F.desc("score"), "other")
    found = index.select("id", "v", "cluster").mapInArrow(run, "at bigint, score float, other bigint, cluster int")
    true = found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("at", "other", "cluster").toPandas()  # asked x k rows
    q = shared.value
    place = np.argsort(np.argsort(-(asked[1] @ q.centroids.T), axis=1, kind="stable"), axis=1)
    need = np.where(np.isin(true["other"], head), 1, place[true["at"], true["cluster"]] + 1)
    return int(min(len(q.centroids), np.quantile(need, coverage, method="higher")))


def _visits(queries: DataFrame, shared, visits: int) -> DataFrame:
    """(cluster, id, v): the ``visits`` clusters of largest inner product with each query."""

    def run(batches):
        q = shared.value
        for whole in batches:
            for s in range(0, whole.num_rows, 512):  # each vector is repeated ``visits`` times
                b = whole.slice(s, 512)
                near = np.argpartition(-(_vectors(b.column(1)) @ q.centroids.T), visits - 1, axis=1)[:, :visits]
                row = pa.array(np.repeat(np.arange(b.num_rows), visits))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), b.column(0).take(row), b.column(1).take(row)], ["cluster", "id", "v"])

    return queries.mapInArrow(run, "cluster int, id bigint, v array<float>")


def _best(found: list[np.ndarray], m: int) -> list[np.ndarray]:
    """The rows of (id, other, approx) that are among the ``m`` best of their id."""
    i, other, approx = found
    order = np.lexsort((other, -approx, i))
    i = i[order]
    first = np.flatnonzero(np.diff(i, prepend=i[0] - 1)) if len(i) else np.zeros(0, np.int64)
    place = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
    keep = order[place < m]
    return [x[keep] for x in found]


def _rows(found: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int64(), pa.float32()), strict=True)], ["id", "other", "approx"])


def _scanned(base: DataFrame, visiting: DataFrame, shared, rerank: int) -> DataFrame:
    """(id, other, approx): what the queries' scans met, of each task the ``rerank`` best of a query.

    ``base`` is (cluster, id, code), ``visiting`` (cluster, id, v).
    """
    parts = base.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    groups = visiting.groupBy("cluster").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    split = materialise(parts.join(groups, "cluster"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    base = base.join(split, "cluster").select("cluster", one("parts").alias("part"), each("groups").alias("group"), F.lit(0).alias("role"), "id", "code", F.lit(None).cast("array<float>").alias("v"))
    visiting = visiting.join(split, "cluster").select("cluster", each("parts").alias("part"), one("groups").alias("group"), F.lit(1).alias("role"), "id", F.lit(None).cast("binary").alias("code"), "v")

    def run(batches):
        q = shared.value
        key, ids, codes, ready = None, [], [], None
        held, size = [], 0

        def scan(i, w):
            approx = q.scan(w, key[0], ready[1])
            approx[i[:, None] == ready[0][None]] = -np.inf
            m = min(rerank, len(ready[0]))
            pick = np.argpartition(-approx, m - 1, axis=1)[:, :m]
            approx = np.take_along_axis(approx, pick, 1)
            ok = np.isfinite(approx)
            return [np.repeat(i, ok.sum(1)), ready[0][pick][ok], approx[ok]]

        for b in batches:
            c, p, g, role, i = (b.column(j).to_numpy() for j in range(5))
            cut = np.flatnonzero(np.concatenate(([True], (np.diff(c) != 0) | (np.diff(p) != 0) | (np.diff(g) != 0) | (np.diff(role) != 0)))) if len(c) else []
            for a, z in zip([*cut], [*cut[1:], len(c)], strict=True):
                now = (int(c[a]), int(p[a]), int(g[a]))
                if now != key:
                    key, ids, codes, ready = now, [], [], None
                if role[a] == 0:
                    ids.append(i[a:z])
                    codes.append(np.frombuffer(b"".join(b.column(5).slice(a, z - a).to_pylist()), np.uint8).reshape(z - a, -1))
                    continue
                if ready is None and ids:
                    ready = np.concatenate(ids), np.concatenate(codes)
                for s in range(a, z, 256) if ready else ():
                    e = min(z, s + 256)
                    held.append(scan(i[s:e], _vectors(b.column(6).slice(s, e - s))))
                    size += len(held[-1][0])
                    if size > HELD:
                        held = [_best([np.concatenate(x) for x in zip(*held, strict=True)], rerank)]
                        size = len(held[0][0])
                        if size > HELD // 2:
                            yield _rows(held[0])
                            held, size = [], 0
        if held:
            yield _rows(_best([np.concatenate(x) for x in zip(*held, strict=True)], rerank))

    key = ["cluster", "part", "group"]
    both = base.unionByName(visiting).repartition(partitions(base.sparkSession), *key).sortWithinPartitions(*key, "role", "id")
    return both.mapInArrow(run, "id bigint, other bigint, approx float")


def _long(queries: DataFrame, head, m: int) -> DataFrame:
    """(id, other, approx): the m best of the ``head`` (ids, vectors) for each query."""

    def run(batches):
        hid, hv = head.value
        for whole in batches:
            for s in range(0, whole.num_rows, 512):
                b = whole.slice(s, 512)
                i = b.column(0).to_numpy()
                score = _vectors(b.column(1)) @ hv.T
                score[i[:, None] == hid[None]] = -np.inf
                ok = np.isfinite(score)
                yield _rows(_best([np.repeat(i, ok.sum(1)), np.broadcast_to(hid, score.shape)[ok], score[ok]], m))

    return queries.mapInArrow(run, "id bigint, other bigint, approx float")


def _collected(v: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a bounded frame."""
    d = v.select("id", "v").toArrow().combine_chunks()
    ids, vecs = (c.combine_chunks() for c in d.columns)
    return ids.to_numpy(), _vectors(vecs)


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, coverage: float = COVERAGE, rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """See the module's text."""
    spark = vectors.sparkSession
    ship(spark)
    v = materialise(usable(vectors))
    n = v.count()
    asking = F.pmod("id", F.lit(every)) == 0
    if n < 2:
        return spark.createDataFrame([], "vec_id bigint, neighbor_id bigint, rank int, score double")

    def least(rows, bound):  # of least hash
        return _collected(rows.join(F.broadcast(rows.select("id", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(bound).select("id")), "id").orderBy("id"))

    x = least(v, sample)[1]
    shared = spark.sparkContext.broadcast(Quantiser(x, max(1, min(int(math.sqrt(n)), len(x) // 8))))
    index = materialise(indexed(v, shared))
    head = _collected(v.orderBy(dot("v", "v").desc(), "id").limit(min(BLOCK, int(math.sqrt(n)))))
    queries = v.where(asking)
    asked = least(queries, ASKED)
    if not len(asked[0]):
        return spark.createDataFrame([], "vec_id bigint, neighbor_id bigint, rank int, score double")
    visits = visits_for(index, shared, asked, head[0], k, coverage)
    long = spark.sparkContext.broadcast(head)
    base = index.join(F.broadcast(spark.createDataFrame([(int(i),) for i in head[0]], "id bigint")), "id", "left_anti").select("cluster", "id", "code")
    met = _scanned(base, _visits(queries, shared, visits), shared, rerank).union(_long(queries, long, rerank))
    best = Window.partitionBy("id").orderBy(F.desc("approx"), "other")
    chosen = met.withColumn("place", F.row_number().over(best)).where(F.col("place") <= rerank).select("id", "other")
    rank = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    return (
        chosen.join(v.select(F.col("id").alias("other"), F.col("v").alias("w")), "other")
        .join(queries.select("id", "v"), "id")
        .select("id", "other", dot("v", "w").alias("score"))
        .withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= k)
        .select(F.col("id").alias("vec_id"), F.col("other").alias("neighbor_id"), "rank", "score")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
