"""Personal data and secrets by a linear-chain conditional random field over word shapes.

Words (runs without ASCII white space) are tagged; the weights of a word's shape, of its neighbours'
shapes and of successive tags are trained from the small labelled table in ``pii_labels``. Tags are
O, and B-/I- of EMAIL, PHONE, IP, CARD, SSN and SECRET.

Decoding is Viterbi in numpy, all sequences of a batch in lockstep. Nearly all words hold no digit, @
or = and no row of capitals; where such a word's lead of O over every other tag exceeds what transitions can ever give back,
the best path is O there whatever surrounds it, so the chain may be cut there without changing the
result. Only the stretches between such words are decoded.

Result of ``find``: ``doc_id, start, end, kind``, character offsets into the text, one row a finding;
quotes, brackets and marks around a finding, and a key before ``=``, aren't part of it.

Defined results: null or empty texts have no findings; rows without a doc_id are ignored by ``find``
and redacted like others by ``redact``; repeated rows are searched each, and equal findings given
once; ties in decoding go to the tag that comes first in TAGS; other columns are ignored; an empty
table gives an empty result. ``redact`` keeps all rows and columns.
"""

from __future__ import annotations

import functools
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pharos.llm import textkit as T
from pharos.llm.pii_labels import rows as labelled_rows
from pharos.runtime import ship, table

KINDS = ["EMAIL", "PHONE", "IP", "CARD", "SSN", "SECRET"]
TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
KEYWORDS = ("password", "passwd", "token", "secret", "api_key", "apikey", "key", "pwd")

_CLASS = bytearray(range(256))
for _c in range(256):
    if 48 <= _c < 58:
        _CLASS[_c] = ord("0")
    elif 97 <= _c < 103:
        _CLASS[_c] = ord("f")
    elif 103 <= _c < 123 or _c >= 128:
        _CLASS[_c] = ord("z")
    elif 65 <= _c < 71:
        _CLASS[_c] = ord("F")
    elif 71 <= _c < 91:
        _CLASS[_c] = ord("Z")
_CLASS = bytes(_CLASS)
_EDGE = re.compile(rb"^[^0-9A-Za-z+(\x80-\xff]*|[^0-9A-Za-z)\x80-\xff]*$")


def _runs(core: bytes) -> str:
    """Shape with runs of letters as x and of digits as their length (9 stands for more than 8)."""
    return re.sub(rb"[fzFZ]+|0+", lambda m: b"x" if m[0][0] != 48 else str(min(len(m[0]), 9)).encode(), core).decode("latin-1")


def plain_features(code: int) -> list[str]:
    """Features of a word without digit, @ and =: bits are capital, end mark, keyword."""
    return ["plain", f"plain{code}"] + (["keyword"] if code & 4 else [])


def shape_features(word: bytes) -> list[str]:
    """Features of any other word."""
    out = ["bias"]
    if b"=" in word:
        key, _, value = word.partition(b"=")
        name = re.sub(rb"[^a-z_]", b"", key.lower()).decode()
        out.append("key=secret" if name in KEYWORDS else "key=other" if name else "key=none")
        value = value or key
    else:
        value = word
    shape = _EDGE.sub(b"", value.translate(_CLASS))
    digits, letters = shape.count(b"0"), sum(shape.count(c) for c in b"fzFZ" for c in [bytes([c])])
    if not shape:
        return [*out, "marks"]
    runs = _runs(shape)
    out.append(f"runs:{runs if len(runs) <= 24 else 'long'}")
    out.append("skeleton:" + re.sub(r"\d", "d", runs)[:24])
    out.append(f"digits{min(digits, 20) if digits < 13 else 13 if digits < 20 else 20}")
    out.append(f"letters{0 if not letters else 1 if letters < 8 else 2 if letters < 16 else 3}")
    if b"@" in shape:
        left, _, right = shape.partition(b"@")
        out.append("address" if left and b"." in right and right.count(b"@") == 0 else "at")
    if re.fullmatch(rb"0{1,3}(\.0{1,3}){3}", shape):
        out.append("quad")
    if re.fullmatch(rb"[0fF]{16,}", shape) and letters:
        out.append("hex")
    if re.fullmatch(rb"[0FZ]{16,}", shape) and letters:
        out.append("capitals" if digits else "capital word")
        if value.lstrip(b"\"'(<[").startswith(b"AKIA") and len(shape) == 20:
            out.append("access key")
    if re.fullmatch(rb"[0fzFZ_\-]{16,}", shape) and letters and digits:
        out.append("mixed")
    if re.fullmatch(rb"0{13,19}|(0{4}[ -]?){3}0{4}", shape):
        out.append("card")
    if shape.startswith(b"+"):
        out.append("plus")
    if shape.startswith(b"(") and shape.endswith(b")"):
        out.append("brackets")
    return out


class Field:
    """Weights by feature: of the word itself, of the word before and of the word after; transitions."""

    def __init__(self, names: dict[str, int], here, before, after, trans, start):
        self.names, self.here, self.before, self.after, self.trans, self.start = names, here, before, after, trans, start
        #: By tag: what the two transitions of a word can lose, at most, when that tag is changed to O.
        into = np.maximum((trans - trans[:, :1]).max(axis=0), start - start[0])
        self.give = into + np.maximum((trans - trans[:1]).max(axis=1), 0)

    def vector(self, features: list[str]) -> np.ndarray:
        ids = [self.names[f] for f in features if f in self.names]
        return np.stack([w[ids].sum(axis=0) for w in (self.here, self.before, self.after)])


def viterbi(emission: np.ndarray, first: np.ndarray, size: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Best tags of all sequences (words ``first`` to ``first + size``), in lockstep."""
    out = np.zeros(len(emission), np.int64)
    if not len(first):
        return out
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    score = emission[first] + start
    back = []
    alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
    final = np.zeros(len(first), np.int64)
    for t in range(1, int(size[0])):
        n = alive[t]
        final[n : alive[t - 1]] = score[n : alive[t - 1]].argmax(axis=1)
        path = score[:n, :, None] + trans[None]
        best = path.argmax(axis=1)
        back.append(best.astype(np.int8))
        score = np.take_along_axis(path, best[:, None, :], axis=1)[:, 0] + emission[first[:n] + t]
    final[: len(score)] = score.argmax(axis=1)
    tag = final
    for t in range(int(size[0]) - 1, -1, -1):
        n = alive[t]
        out[first[:n] + t] = tag[:n]
        if t:
            tag[:n] = back[t - 1][np.arange(n), tag[:n]]
    return out


def likelihood(params: list[np.ndarray], flat: list[np.ndarray], gold: np.ndarray, mask: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Log-likelihood of the gold tags (rows x words x tags, 0 beyond each row's end) and its gradient.

    ``params`` are the weights of a word's, its predecessor's and its successor's features, of transitions
    and of starts; ``flat`` the features, (rows * words) x features.
    """
    n, m, k = gold.shape

    def lse(a, axis):
        top = a.max(axis=axis, keepdims=True)
        return np.squeeze(top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True)), axis)

    e = sum(q @ p for q, p in zip(flat, params[:3], strict=True)).reshape(n, m, k)
    trans, start = params[3], params[4]
    alpha, beta = np.zeros((n, m, k)), np.zeros((n, m, k))
    alpha[:, 0] = e[:, 0] + start
    for t in range(1, m):
        nxt = lse(alpha[:, t - 1, :, None] + trans[None], 1) + e[:, t]
        alpha[:, t] = np.where(mask[:, t, None], nxt, alpha[:, t - 1])
    for t in range(m - 2, -1, -1):
        prv = lse(trans[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where(mask[:, t + 1, None], prv, 0)
    z = lse(alpha[:, -1], 1)
    p = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
    d = (gold - p).reshape(-1, k)
    grads = [q.T @ d for q in flat]
    pair = mask[:, 1:, None, None]
    expect = (np.exp(np.clip(alpha[:, :-1, :, None] + trans[None, None] + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None], -700, 0)) * pair).sum(axis=(0, 1))
    seen = (gold[:, :-1, :, None] * gold[:, 1:, None, :]).sum(axis=(0, 1))
    grads += [seen - expect, (gold[:, 0] - p[:, 0]).sum(axis=0)]
    score = (gold * e).sum() + (seen * trans).sum() + (gold[:, 0] * start).sum()
    return float(score - z.sum()), grads


def train(rows: list[tuple[list[bytes], list[str]]], rounds: int = 200, l2: float = 0.01, rate: float = 0.1) -> Field:
    """Penalised maximum likelihood by Adam; forward-backward over the padded table."""
    feats = [[features(w) for w in words] for words, _ in rows]
    names: dict[str, int] = {}
    for s in feats:
        for f in s:
            for x in f:
                names.setdefault(x, len(names))
    k, n, m = len(TAGS), len(rows), max(len(w) for w, _ in rows)
    nf = len(names)
    x = np.zeros((n, m + 2, nf), np.float32)  # one blank before and after
    y = np.zeros((n, m), np.int64)
    mask = np.zeros((n, m), bool)
    for i, (s, (_, tags)) in enumerate(zip(feats, rows, strict=True)):
        for t, f in enumerate(s):
            x[i, t + 1, [names[q] for q in f]] = 1
        y[i, : len(tags)] = [TAGS.index(g) for g in tags]
        mask[i, : len(tags)] = True
    xs = [x[:, 1:-1], x[:, :-2], x[:, 2:]]
    w = [np.zeros((nf, k)) for _ in range(3)]
    trans, start = np.zeros((k, k)), np.zeros(k)
    params = [*w, trans, start]
    mom, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    gold = np.zeros((n, m, k))
    gold[np.arange(n)[:, None], np.arange(m)[None], y] = 1
    gold *= mask[:, :, None]
    flat = [q.reshape(-1, nf) for q in xs]

    for step in range(1, rounds + 1):
        _, grads = likelihood(params, flat, gold, mask)
        for j, (q, g) in enumerate(zip(params, grads, strict=True)):
            g = g - l2 * q * (5 if j >= 3 else 1)
            mom[j] = 0.9 * mom[j] + 0.1 * g
            var[j] = 0.999 * var[j] + 0.001 * g * g
            q += rate * (mom[j] / (1 - 0.9**step)) / (np.sqrt(var[j] / (1 - 0.999**step)) + 1e-8)
    return Field(names, *params)


_keyword_hashes = T.words([" ".join(k + e for k in KEYWORDS for e in ("", ":"))]).hash
_SPECIAL = np.zeros(256, np.int32)
_SPECIAL[48:58] = _SPECIAL[[64, 61]] = 1


def plain_codes(w: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """(code of every word as if plain, is it another: one with a digit, @ or =, or 16 capitals or more)."""
    total = np.concatenate(([0], np.cumsum(_SPECIAL[w.buf])))
    special = total[w.end] > total[w.start]
    long = np.flatnonzero(w.end - w.start >= 16)
    if len(long):
        total = np.concatenate(([0], np.cumsum((w.buf >= 65) & (w.buf <= 90))))
        special[long] |= total[w.end[long]] - total[w.start[long]] >= 16
    a, z = w.buf[w.start], w.buf[w.end - 1]
    code = ((a >= 65) & (a <= 90)).astype(np.int64)
    code |= (~(((z | 32) >= 97) & ((z | 32) <= 122) | (z >= 128))).astype(np.int64) << 1
    code |= np.isin(w.hash, _keyword_hashes).astype(np.int64) << 2
    return code, special


def features(word: bytes) -> list[str]:
    w = T.words([word.decode("utf-8", "replace")])
    code, special = plain_codes(w)
    return shape_features(word) if special[0] else plain_features(int(code[0]))


class Tagger:
    """Tags batches; remembers the weights of shapes it has met."""

    def __init__(self, field: Field, limit: int = 200_000):
        self.field, self.limit = field, limit
        self._reset()

    def _reset(self) -> None:
        self.at: dict[bytes, int] = {}
        self.weights = np.stack([self.field.vector(plain_features(c)) for c in range(8)])

    def codes(self, w: T.Words) -> np.ndarray:
        if len(self.at) > self.limit:
            self._reset()
        code, special = plain_codes(w)
        raw = w.buf.tobytes()
        found, new, base = [], [], len(self.weights)
        sel = np.flatnonzero(special)
        for a, b in zip(w.start[sel].tolist(), w.end[sel].tolist(), strict=True):
            word = raw[a:b]
            key, eq, value = word.rpartition(b"=")
            shape = (key.lower() if eq else b"") + eq + (b"AKIA" if b"AKIA" in value else b"") + value.translate(_CLASS)
            i = self.at.get(shape)
            if i is None:
                i = self.at[shape] = base + len(new)
                new.append(self.field.vector(shape_features(word)))
            found.append(i)
        code[sel] = found
        if new:
            self.weights = np.concatenate((self.weights, np.stack(new)))
        return code

    def tag(self, w: T.Words, cut: bool = True) -> np.ndarray:
        """Best tag of every word; ``cut=False`` decodes whole documents."""
        n = len(w)
        if not n:
            return np.zeros(0, np.int64)
        f = self.field
        code = self.codes(w)
        first = np.zeros(n + 1, bool)
        first[w.first] = True
        before = np.where(first[:n], -1, np.concatenate(([-1], code[:-1])))
        after = np.where(first[1:], -1, np.concatenate((code[1:], [-1])))
        table = np.concatenate((self.weights, np.zeros((1, *self.weights.shape[1:]))))  # -1: nothing there
        if cut:
            lead = table[:, :, 0] - table[:, :, 1:].max(axis=2)
            here = table[:, 0, 0] - (table[:, 0] + f.give)[:, 1:].max(axis=1)
            sure = here[code] + lead[before, 1] + lead[after, 2] > 0
        else:
            sure = np.zeros(n, bool)
        tags = np.zeros(n, np.int64)
        todo = np.flatnonzero(~sure)
        if not len(todo):
            return tags
        # a stretch takes the sure word on either side along: it is O there, and its transitions count
        take = ~sure
        take[:-1] |= ~sure[1:] & ~first[1:n]
        take[1:] |= ~sure[:-1] & ~first[1:n]
        idx = np.flatnonzero(take)
        emission = table[code[idx], 0] + table[before[idx], 1] + table[after[idx], 2]
        new = np.ones(len(idx), bool)
        new[1:] = (np.diff(idx) != 1) | first[idx[1:]]
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(idx)))
        # only a document's first word has a start weight; elsewhere the stretch begins in O
        head = first[idx[begin]]
        emission[begin[head]] += f.start
        tags[idx] = viterbi(emission, begin, size, f.trans, np.zeros(len(TAGS)))
        return tags


_TRIM = {
    "EMAIL": (re.compile(r"^[^0-9A-Za-z]+"), re.compile(r"[^0-9A-Za-z]+$")),
    "PHONE": (re.compile(r"^[^0-9+(]+"), re.compile(r"[^0-9]+$")),
    "SECRET": (re.compile(r"^[^0-9A-Za-z]+"), re.compile(r"[^0-9A-Za-z]+$")),
}
_DIGITS = (re.compile(r"^[^0-9]+"), re.compile(r"[^0-9]+$"))


def findings(texts: list[str | None], tagger: Tagger) -> list[tuple[int, int, int, str]]:
    """(row, start, end, kind) of every finding, in order."""
    w = T.words(texts)
    tags = tagger.tag(w)
    hit = np.flatnonzero(tags)
    out = []
    if not len(hit):
        return out
    doc = w.doc[hit]
    kind = (tags[hit] - 1) // 2
    inner = (tags[hit] - 1) % 2 == 1
    new = np.ones(len(hit), bool)
    new[1:] = ~(inner[1:] & (np.diff(hit) == 1) & (kind[1:] == kind[:-1]) & (doc[1:] == doc[:-1]))
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(hit)) - 1
    lead = np.concatenate(([0], np.cumsum((w.buf & 0xC0) != 0x80)))  # characters before each byte
    base = lead[w.doc_start[doc[a]]]
    for d, k, s, e in zip(doc[a].tolist(), kind[a].tolist(), (lead[w.start[hit[a]]] - base).tolist(), (lead[w.end[hit[z]]] - base).tolist(), strict=True):
        name = KINDS[k]
        part = texts[d][s:e]
        if name == "SECRET" and "=" in part:
            s += part.rindex("=") + 1 if part.rstrip("=\"'").rfind("=") < 0 else part.rstrip("=\"'").rindex("=") + 1
            part = texts[d][s:e]
        left, right = _TRIM.get(name, _DIGITS)
        s += len(part) - len(part := left.sub("", part))
        e -= len(part) - len(right.sub("", part))
        if s < e:
            out.append((d, s, e, name))
    return out


@functools.cache
def model() -> Field:
    """The field trained from the labelled table; the same on every run."""
    return train(labelled_rows(TAGS))


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(field or model())

    def run(batches):
        tagger = Tagger(shared.value)
        for c in T.slices(batches, 1000):
            ids = c.column(0).to_pylist()
            found = list(dict.fromkeys((ids[d], s, e, k) for d, s, e, k in findings(c.column(1).to_pylist(), tagger)))
            cols = list(zip(*found, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["doc_id", "start", "end", "kind"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
    return texts.mapInArrow(run, "doc_id bigint, start int, end int, kind string").distinct()


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with each finding replaced by ``<KIND>``; an ``n_chars`` column follows the new text."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(field or model())

    def run(batches):
        tagger = Tagger(shared.value)
        for c in T.slices(batches, 1000):
            place = c.schema.get_field_index("text")
            texts = c.column(place).to_pylist()
            for d, found in itertools.groupby(findings(texts, tagger), lambda x: x[0]):
                parts, at = [], 0
                for _, s, e, k in found:
                    parts += [texts[d][at:s], f"<{k}>"]
                    at = e
                texts[d] = "".join([*parts, texts[d][at:]])
            yield c.set_column(place, c.schema.field(place), pa.array(texts, c.schema.field(place).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
