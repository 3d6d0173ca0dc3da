"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the distinct words of a text and their beginnings (stems) is trained in numpy
from confirmed toxic texts and unlabelled ones. The risk of positives is weighted by the class prior, and the negatives' risk, which
nobody labelled, is what the unlabelled texts' risk leaves when the positives' share is taken off;
where that estimate turns negative (over-fitting) its gradient is reversed.

Only words and stems that are significantly more frequent in confirmed texts than in unlabelled ones (``LEAST_Z``
standard errors; in ``LEAST_SHARE`` of them and ``MIN_POSITIVES`` texts) have a weight, so most have none and long texts gain
no score by length.

Fitting reads bounded samples: at most ``POSITIVES`` toxic and ``UNLABELLED`` other distinct texts,
those of least hash. Scoring covers every whole text. The class prior defaults to the share of toxic
among all labelled documents.

``score`` gives ``doc_id, score, toxic`` for each row; ``toxic_documents``, the query, those that are
toxic (score above 0).

Defined results: null and empty texts score the bias; rows without a doc_id keep a null one and are
left out of the query; repeated rows are scored each and given once by the query; a score of exactly
0 isn't toxic; other columns are ignored; empty tables give empty results; without a confirmed
example nothing is toxic. Labels of texts that aren't in the documents are ignored, and so are null
labels, for the prior too; of several labels of a document the greatest counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pharos.llm import textkit as T
from pharos.runtime import ship, table

STEMS = (4, 5, 6)
POSITIVES, UNLABELLED = 3000, 9000
MIN_POSITIVES = 3
LEAST_SHARE, LEAST_Z = 0.01, 5.0


@dataclass
class Linear:
    """Sorted feature hashes, their weights, and the bias."""

    feature: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        if not len(self.feature):
            return out
        docs, ids = [], []
        for doc, h in features(texts):
            at = np.minimum(np.searchsorted(self.feature, h), len(self.feature) - 1)
            hit = np.flatnonzero(self.feature[at] == h)
            docs.append(doc[hit])
            ids.append(at[hit])
        key = np.unique(np.concatenate(docs) * len(self.feature) + np.concatenate(ids))
        return out + np.bincount(key // len(self.feature), self.weight[key % len(self.feature)], minlength=len(texts))


def features(texts: list[str | None]):
    """(row, hash) of every word, then of the words' beginnings of each length in ``STEMS`` bytes."""
    w = T.words(texts, "norm")
    yield w.doc, w.hash
    for k in STEMS:
        longer = np.flatnonzero(w.end - w.start > k)
        yield w.doc[longer], T.mix(T.span_hash(w.buf, w.start[longer], w.start[longer] + k) + np.uint64(k))


def matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct features of each text."""
    doc, h = (np.concatenate(x) for x in zip(*features(texts), strict=True))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def unlike(texts: list[str]) -> list[str]:
    """Texts without near copies of earlier ones: those that share one of four minimal 3-gram hashes.

    Copies would make the words of one text look typical of its class.
    """
    w = T.words(texts, "norm")
    at, h = T.grams(w, 3)
    doc = w.doc[at]
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    least = {d: () for d in range(len(texts))}
    if len(starts):
        mins = [np.minimum.reduceat(T.mix(h * T.BASE + np.uint64(i)), starts).tolist() for i in range(4)]
        least |= dict(zip(doc[starts].tolist(), zip(*mins, strict=True), strict=True))
    seen: set[tuple[int, int]] = set()
    kept = []
    for d, text in enumerate(texts):
        marks = set(enumerate(least[d]))
        if not marks & seen:
            kept.append(text)
        seen |= marks
    return kept


def risk(fp: np.ndarray, fu: np.ndarray, prior: float, beta: float = 0.0, gamma: float = 1.0) -> tuple[float, np.ndarray, np.ndarray]:
    """The estimated risk of scores of positives and unlabelled, and the step's gradient by each score.

    Logistic loss: log(1 + exp(-f)) for positives, log(1 + exp(f)) for negatives. While the negatives' risk,
    what the unlabelled's leaves when the positives' share is taken off, is above ``-beta``, the gradient is
    that of the whole; else it is that of this rest, reversed and times ``gamma``.
    """
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    rest = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    value = prior * np.logaddexp(0, -fp).mean() + max(0.0, rest)
    dp_pos, dp_neg, du_neg = -prior * sig(-fp) / len(fp), -prior * sig(fp) / len(fp), sig(fu) / len(fu)
    if rest >= -beta:
        return value, dp_pos + dp_neg, du_neg
    return value, -gamma * dp_neg, -gamma * du_neg


def nnpu(positive: list[str], unlabelled: list[str], prior: float, rounds: int = 400, rate: float = 0.3, l1: float = 1e-4, beta: float = 0.0, gamma: float = 1.0) -> Linear:
    nothing = np.zeros(0, np.uint64)
    if not positive or not 0 < prior < 1:
        return Linear(nothing, np.zeros(0), -1.0)
    (pr, ph), (ur, uh) = matrix(positive), matrix(unlabelled)
    np_, nu = len(positive), max(1, len(unlabelled))
    vocab, a = np.unique(ph, return_counts=True)
    common = a >= np.maximum(MIN_POSITIVES, LEAST_SHARE * np_)
    vocab, a = vocab[common], a[common]
    if not len(vocab):
        return Linear(nothing, np.zeros(0), -1.0)

    def inside(rows, h):
        at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
        hit = np.flatnonzero(vocab[at] == h)
        return rows[hit], at[hit]

    ur, uc = inside(ur, uh)
    c = np.bincount(uc, minlength=len(vocab))
    both = (a + c) / (np_ + nu)
    z = (a / np_ - c / nu) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / np_ + 1 / nu))
    usable = z > LEAST_Z
    n = int(usable.sum())
    ids = np.cumsum(usable) - 1
    ur, uc = ur[usable[uc]], ids[uc[usable[uc]]]
    vocab = vocab[usable]
    if not n:
        return Linear(nothing, np.zeros(0), -1.0)
    pr, pc = inside(pr, ph)
    w, b = np.zeros(n), -1.0
    g2, gb2 = np.full(n, 1e-6), 1e-6
    for _ in range(rounds):
        fp = b + np.bincount(pr, w[pc], minlength=np_)
        fu = b + np.bincount(ur, w[uc], minlength=nu)
        _, dp, du = risk(fp, fu, prior, beta, gamma)
        grad = np.bincount(pc, dp[pr], minlength=n) + np.bincount(uc, du[ur], minlength=n)
        gb = dp.sum() + du.sum()
        g2 += grad * grad
        gb2 += gb * gb
        step = rate / np.sqrt(g2)
        w -= step * grad
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        b -= rate / np.sqrt(gb2) * gb
    kept = np.abs(w) >= 0.05
    return Linear(vocab[kept], w[kept], float(b))


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Linear:
    spark = docs.sparkSession
    ship(spark)
    marks = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if prior is None:
        ids = docs.select(F.col("doc_id").cast("long")).where(F.col("text").isNotNull())
        prior = marks.join(ids, "doc_id", "left_semi").agg(F.avg("toxic")).first()[0] or 0.0
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null").withColumn("h", F.xxhash64("text"))
    keyed = text.select("doc_id", "h").join(marks.where("toxic = 1"), "doc_id", "left").select(F.coalesce("toxic", F.lit(0)).alias("toxic"), "h")
    place = F.dense_rank().over(Window.partitionBy("toxic").orderBy("h"))
    chosen = keyed.withColumn("r", place).where(F.col("r") <= F.when(F.col("toxic") == 1, positives).otherwise(unlabelled)).where(F.col("r") <= max(positives, unlabelled)).select("toxic", "h").distinct()
    rows = text.join(F.broadcast(chosen), "h").groupBy("toxic", "h").agg(F.first("text").alias("text")).orderBy("toxic", "h").collect()
    return nnpu(*(unlike([r["text"] for r in rows if r["toxic"] == k]) for k in (1, 0)), prior)


def score(docs: DataFrame, model: Linear) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for c in T.slices(batches, 1000):
            s = shared.value.scores(c.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([c.column(0), pa.array(s), pa.array(s > 0)], ["doc_id", "score", "toxic"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, score double, toxic boolean")


def toxic_documents(docs: DataFrame, model: Linear) -> DataFrame:
    return score(docs, model).where("toxic and doc_id is not null").distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxic_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
