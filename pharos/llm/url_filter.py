"""URL filter: gradient-boosted trees on lexical features, trained from labelled URLs.

Features: lengths (whole, host, path, query), depth, subdomains, digit and symbol ratios, entropy of
the host and the path, parameter counts, longest segment and token, fragments, and statistics of the
suffixes (top-level domain, file extension): their smoothed share of bad labels.

Trees of depth ``DEPTH`` are grown on exact splits of the logistic loss (second order), in numpy; the
training table is small (``url_labels``, or any (url, label) frame up to ``TRAIN_ROWS`` rows of least
hash). A URL is blocked if its probability of being bad is above one half.

Result: ``page_id, url, score, blocked`` for each row of the input.

Defined results: a null URL has a null score and isn't blocked; an empty one is scored like any text;
a null page_id stays null; repeated rows are scored each; ties of split gains go to the feature and
threshold that come first; other columns are ignored; an empty table stays empty; with labels of one
class only, all URLs get that class's prior.
"""

from __future__ import annotations

import functools
import math
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pharos.llm.url_labels import rows as labelled_rows
from pharos.runtime import ship, table

TREES, DEPTH, RATE, MIN_LEAF = 60, 3, 0.2, 3
TRAIN_ROWS = 20_000
NAMES = [
    "length", "host_length", "path_length", "query_length", "depth", "subdomains", "digit_ratio", "symbol_ratio", "host_digits", "host_hyphens", "host_entropy", "path_entropy",
    "params", "param_length", "longest_segment", "longest_token", "fragment", "https", "port", "encoded", "tld_share", "ext_share",
]


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def parts(url: str):
    try:
        u = urlsplit(url if "://" in url else "//" + url)
        return u.scheme, (u.hostname or ""), u.netloc, u.path, u.query, u.fragment
    except ValueError:
        return "", "", "", url, "", ""


def suffixes(host: str, path: str) -> tuple[str, str]:
    last = path.rsplit("/", 1)[-1]
    return host.rsplit(".", 1)[-1], last.rsplit(".", 1)[-1].lower() if "." in last else ""


@dataclass
class Model:
    base: float
    trees: list = field(default_factory=list)
    share: dict = field(default_factory=dict)
    prior: float = 0.5

    def features(self, url: str) -> list[float]:
        scheme, host, netloc, path, query, fragment = parts(url)
        tld, ext = suffixes(host, path)
        segments = [s for s in path.split("/") if s]
        params = [p for p in query.split("&") if p]
        n = max(1, len(url))
        tokens = "".join(c if c.isalnum() else " " for c in url).split()
        return [
            len(url), len(host), len(path), len(query), len(segments), max(0, host.count(".") - 1),
            sum(c.isdigit() for c in url) / n, sum(not c.isalnum() and c not in "/.:" for c in url) / n, sum(c.isdigit() for c in host), host.count("-"),
            entropy(host), entropy(path), len(params), max([0, *map(len, params)]), max([0, *map(len, segments)]), max([0, *map(len, tokens)]),
            float(bool(fragment)), float(scheme == "https"), float(":" in netloc.rsplit("@", 1)[-1]), url.count("%"),
            self.share.get(("tld", tld), self.prior), self.share.get(("ext", ext), self.prior),
        ]

    def probability(self, urls: list[str]) -> np.ndarray:
        if not urls:
            return np.zeros(0)
        x = np.array([self.features(u) for u in urls], float)
        return 1 / (1 + np.exp(-(self.base + sum((predict(t, x) for t in self.trees), np.zeros(len(x))))))


def predict(tree, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))

    def walk(node, rows):
        if isinstance(node, float):
            out[rows] = node
        else:
            f, t, left, right = node
            low = x[rows, f] <= t
            walk(left, rows[low])
            walk(right, rows[~low])

    walk(tree, np.arange(len(x)))
    return out


def grow(x, g, h, rows, depth, l2=1.0):
    gs, hs = g[rows].sum(), h[rows].sum()
    leaf = float(-RATE * gs / (hs + l2))
    if depth == 0 or len(rows) < 2 * MIN_LEAF:
        return leaf
    best = (1e-6, None, None)
    for f in range(x.shape[1]):
        order = rows[np.argsort(x[rows, f], kind="stable")]
        v = x[order, f]
        gl, hl = np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
        ok = (v[1:] != v[:-1]) & (np.arange(1, len(v)) >= MIN_LEAF) & (len(v) - np.arange(1, len(v)) >= MIN_LEAF)
        if not ok.any():
            continue
        gain = np.where(ok, gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2), -1)
        i = int(gain.argmax())
        if gain[i] > best[0]:
            best = (gain[i], f, (v[i] + v[i + 1]) / 2)
    if best[1] is None:
        return leaf
    low = x[rows, best[1]] <= best[2]
    return (best[1], float(best[2]), grow(x, g, h, rows[low], depth - 1), grow(x, g, h, rows[~low], depth - 1))


def train(urls: list[str], bad: list[int], trees: int = TREES, depth: int = DEPTH) -> Model:
    y = np.array(bad, float)
    prior = float((y.sum() + 1) / (len(y) + 2))
    model = Model(math.log(prior / (1 - prior)), prior=prior)
    if not 0 < y.sum() < len(y):
        return model
    seen = defaultdict(lambda: [0.0, 0.0])
    for u, b in zip(urls, bad, strict=True):
        _, host, _, path, _, _ = parts(u)
        for kind, s in zip(("tld", "ext"), suffixes(host, path), strict=True):
            seen[kind, s][0] += b
            seen[kind, s][1] += 1
    model.share = {k: (b + 4 * prior) / (n + 4) for k, (b, n) in seen.items()}
    x = np.array([model.features(u) for u in urls], float)
    f = np.full(len(y), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        t = grow(x, p - y, p * (1 - p), np.arange(len(y)), depth)
        model.trees.append(t)
        f += predict(t, x)
    return model


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """From a frame (url, label); at most ``rows`` distinct URLs, those of least hash."""
    d = labelled.select(F.col("url").cast("string"), F.col("label").cast("int")).where("url is not null and label is not null")
    got = d.groupBy("url").agg(F.max("label").alias("label")).orderBy(F.xxhash64("url"), "url").limit(rows).collect()
    return train([r["url"] for r in got], [r["label"] for r in got])


@functools.cache
def default_model() -> Model:
    urls, bad = zip(*labelled_rows(), strict=True)
    return train(list(urls), list(bad))


def score(pages: DataFrame, model: Model | None = None) -> DataFrame:
    spark = pages.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model or default_model())

    def run(batches):
        for b in batches:
            urls = b.column(1).to_pylist()
            null = np.array([u is None for u in urls], bool)
            p = shared.value.probability([u or "" for u in urls])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p, mask=null), pa.array((p > 0.5) & ~null)], ["page_id", "url", "score", "blocked"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(run, "page_id bigint, url string, score double, blocked boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "pages"))
