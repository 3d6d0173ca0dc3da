"""Language identification by cross-parsing entropy.

For each language a bounded sample of labelled text becomes a suffix automaton. A text is cut, from
the left, into the longest phrases that occur in that sample (a character that the sample lacks is a
phrase by itself); the fewer phrases a language needs, the closer it is. Phrase counts are normalised
to bits a character, ``(phrases - 1) * log2(size of the sample) / characters`` (the text's end cuts the
last phrase short); the least wins.

All languages are parsed by numpy in lockstep: texts are cut into stretches of ``STRETCH`` bytes, one
row each, and one transition of all rows is one gather. A phrase ends with its stretch, for all
languages alike; whole texts are read.

Texts are normalised: lower case, digits and ASCII punctuation as blanks, runs of blanks as one.

A document is accepted if some language needs at most ``MAX_BITS`` bits a character; texts without a
letter are rejected. Result: ``doc_id, lang, predicted, bits, margin, accepted`` for each row of the
input, ``margin`` being the bits by which the next language is worse.

Defined results: a null or letterless text has null ``predicted``, ``bits`` and ``margin`` and isn't
accepted; a null doc_id or label stays null; ties go to the language whose name sorts first; repeated
rows are judged each; other columns are ignored; an empty table stays empty. Without any labelled
text every document is unknown and nothing is accepted. With one language the margin is null. Texts
of any length are judged whole, and may be in the labelled sample, whose bounds are ``TRAIN_BYTES``,
``TRAIN_ROWS`` and ``TRAIN_CHARS``.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pharos.llm.textkit import slices
from pharos.runtime import ship, table

#: Bound of the labelled sample: bytes of normalised text a language.
TRAIN_BYTES = 48_000
#: And rows a language that are read for it.
TRAIN_ROWS = 400
#: And characters of one row, so that no text fills the sample alone.
TRAIN_CHARS = 4000
STRETCH = 512
MAX_BITS = 6.0

_BLANK = bytes(32 if c < 128 and not chr(c).isalpha() else c for c in range(256))


def normalise(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_BLANK).split())


class Automaton:
    """Suffix automaton of a byte string, as a transition table: states x symbols, -1 where none."""

    def __init__(self, text: bytes, symbols: np.ndarray):
        nxt: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols[np.frombuffer(text, np.uint8)].tolist():
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        width = int(symbols.max()) + 1
        self.table = np.full((len(nxt), width), -1, np.int32)
        for s, d in enumerate(nxt):
            for c, t in d.items():
                self.table[s, c] = t
        self.size = max(2, len(text))


class Model:
    def __init__(self, samples: dict[str, bytes]):
        self.names = sorted(k for k, v in samples.items() if v)
        seen = sorted(set(b"".join(samples[k] for k in self.names)))
        self.symbols = np.zeros(256, np.int32)  # 0: a byte that no sample has
        self.symbols[seen] = np.arange(1, len(seen) + 1)
        self.automata = [Automaton(samples[k], self.symbols) for k in self.names]

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Number of phrases: languages x texts."""
        size = np.array([len(t) for t in texts], np.int64)
        rows = -(-size // STRETCH)
        owner = np.repeat(np.arange(len(texts)), rows)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(rows) - rows, rows)
        left = np.minimum(STRETCH, size[owner] - nth * STRETCH)
        order = np.argsort(-left, kind="stable")
        begin = (np.repeat(np.cumsum(size) - size, rows) + nth * STRETCH)[order]
        left, owner = left[order], owner[order]
        code = self.symbols[np.frombuffer(b"".join(texts), np.uint8)]
        alive = np.searchsorted(-left, -np.arange(1, STRETCH + 1), side="right")  # rows of at least so many bytes come first
        out = np.zeros((len(self.names), len(texts)), np.int64)
        steps = int(left[0]) if len(left) else 0
        # one column of all stretches at a time, laid out so that each step reads one run of memory
        grid = np.zeros((steps, len(left)), np.int32)
        for j in range(steps):
            n = alive[j]
            grid[j, :n] = code[begin[:n] + j]
        for k, a in enumerate(self.automata):
            flat, width = a.table.ravel(), a.table.shape[1]
            root = a.table[0]
            state = np.zeros(len(left), np.int32)
            count = np.zeros(len(left), np.int32)
            for j in range(steps):
                n = alive[j]
                c = grid[j, :n]
                t = flat[state[:n] * width + c]
                stop = np.flatnonzero(t < 0)
                if len(stop):
                    # the phrase ends before this character; at the start the character is one itself
                    again = root[c[stop]]
                    count[stop] += (state[stop] > 0).astype(np.int32) + (again < 0)
                    t[stop] = np.maximum(again, 0)
                state[:n] = t
            np.add.at(out[k], owner, count + (state > 0))
        return out

    def judge(self, texts: list[str | None]):
        """(index of the best language or -1, bits, margin) by text."""
        norm = [normalise(t) if t else b"" for t in texts]
        size = np.array([len(t.decode("utf-8", "replace")) for t in norm])
        best, bits, margin = np.full(len(texts), -1), np.full(len(texts), np.nan), np.full(len(texts), np.nan)
        some = np.flatnonzero(size > 0)
        if len(some) and self.names:
            scale = np.array([math.log2(a.size) for a in self.automata])[:, None]
            each = np.maximum(self.phrases([norm[i] for i in some]) - 1, 0) * scale / size[some]
            best[some] = np.argmin(each, axis=0)
            ranked = np.sort(each, axis=0)
            bits[some] = ranked[0]
            if len(self.names) > 1:
                margin[some] = ranked[1] - ranked[0]
        return best, bits, margin


def fit(labelled: DataFrame, train_bytes: int = TRAIN_BYTES, train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS) -> Model:
    """From the labelled rows of the least hash of text and label, up to the three bounds a language. Texts
    without a letter don't count."""
    text = labelled.select(F.col("lang").cast("string"), F.col("text").cast("string")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text", "lang"))
    # only hashes are ranked, and each task keeps its own first ones before anything moves
    place = F.dense_rank().over(Window.partitionBy("lang").orderBy("h"))
    first = text.select("lang", "h").withColumn("r", place).where(F.col("r") <= train_rows).distinct()
    last = {r[0]: r[1] for r in first.groupBy("lang").agg(F.max("h")).collect()}
    if not last:
        return Model({})
    chosen = functools.reduce(lambda x, y: x | y, [(F.col("lang") == k) & (F.col("h") <= v) for k, v in last.items()])
    rows = text.where(chosen).select("lang", "h", F.left("text", F.lit(train_chars)).alias("text")).dropDuplicates(["lang", "h"]).orderBy("lang", "h").collect()
    samples: dict[str, bytes] = {}
    for r in rows:
        have = samples.setdefault(r["lang"], b"")
        if len(have) < train_bytes:
            samples[r["lang"]] = (have + b" " + normalise(r["text"]))[:train_bytes]
    return Model(samples)


def identify(docs: DataFrame, model: Model, max_bits: float = MAX_BITS) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    label = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")

    def run(batches):
        m = shared.value
        for c in slices(batches, 2000):
            best, bits, margin = m.judge(c.column(2).to_pylist())
            names = [m.names[i] if i >= 0 else None for i in best.tolist()]
            yield pa.RecordBatch.from_arrays(
                [c.column(0), c.column(1), pa.array(names, pa.string()), pa.array(bits, mask=np.isnan(bits)), pa.array(margin, mask=np.isnan(margin)), pa.array((best >= 0) & (np.nan_to_num(bits, nan=np.inf) <= max_bits))],
                ["doc_id", "lang", "predicted", "bits", "margin", "accepted"],
            )

    return docs.select(F.col("doc_id").cast("long"), label, F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, lang string, predicted string, bits double, margin double, accepted boolean")


def accepted(docs: DataFrame, model: Model, max_bits: float = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` whose text is accepted, all columns kept, in one pass and without a shuffle."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in slices(batches, 1000):
            best, bits, _ = m.judge(b.column(b.schema.get_field_index("text")).to_pylist())
            yield b.filter(pa.array((best >= 0) & (np.nan_to_num(bits, nan=np.inf) <= max_bits)))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
