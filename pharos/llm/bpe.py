"""Byte-level BPE encoding and decoding by recursive SQL.

Each task runs an in-memory DuckDB. Texts are split into pieces (``pieces.py``); each distinct piece
becomes rows (piece, position, token), one for each byte, which a recursive query joins with the merge
table: in every round each piece contracts its leftmost pair of least rank, until no piece has a pair
that can be merged. Decoding joins tokens with the vocabulary and aggregates their bytes in order.

The rounds of a piece grow with its length, so pieces of more than ``LONG`` bytes (scripts without blanks,
sequences) are contracted in stretches. Tokens in a row are the encoding of their bytes if and only if
each two neighbours are that of theirs; where two stretches meet in a pair that isn't, both are
contracted anew as one, until no such place is left. Stretches that grow beyond ``WIDE`` bytes, as
only periodic texts let them, contract their best pair at all its places in a round: what contracting
the leftmost again and again comes to, because a contraction never makes a pair of lower rank.

Result of ``encode``: ``doc_id, n_tokens, tokens`` for each row of the input, and ``round_trip``: do
the tokens decode to the text?

Defined results: a null text gives nulls; an empty one an empty list; a null doc_id stays null;
repeated rows are encoded each; other columns are ignored; an empty table stays empty. Special tokens'
strings are ordinary text. Of equal ranks the leftmost pair goes first.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pharos.llm import pieces as P
from pharos.llm import textkit as T
from pharos.runtime import ship, table

TOKENIZERS = "/opt/tokenizers"
#: Bytes of distinct pieces in one recursive query.
CHUNK = 150_000
#: What a Python worker's memo and its database may hold.
MEMO_BYTES, DATABASE_MB = 48 << 20, 160

#: Longer pieces are contracted in stretches of so many bytes; longer stretches at all places of their best pair in a round.
LONG, WIDE = 64, 1024
#: Pairs of tokens of which it is remembered whether they may stand side by side.
PAIRS = 100_000

LEFTMOST = """
WITH RECURSIVE bpe(w, pos, tok) USING KEY (w, pos) AS (
  SELECT w, pos, tok FROM start
  UNION
  SELECT w, unnest([b.pos, b.nxt]) AS pos, unnest([b.merged, NULL]) AS tok
  FROM (
    SELECT x.w, arg_min({'pos': x.pos, 'nxt': x.npos, 'merged': m.merged}, m.rank * 1048576::BIGINT + x.pos) AS b
    FROM (SELECT w, pos, tok, lead(tok) OVER line AS nxt, lead(pos) OVER line AS npos
          FROM recurring.bpe WHERE tok IS NOT NULL AND w IN (SELECT w FROM bpe)
          WINDOW line AS (PARTITION BY w ORDER BY pos)) x
    JOIN merges m ON m.l = x.tok AND m.r = x.nxt
    GROUP BY x.w))
SELECT w, tok FROM bpe WHERE tok IS NOT NULL ORDER BY w, pos
"""

EVERYWHERE = """
WITH RECURSIVE bpe(w, pos, tok) USING KEY (w, pos) AS (
  SELECT w, pos, tok FROM start
  UNION
  SELECT w, pos, CASE WHEN hit THEN merged WHEN gone THEN NULL ELSE tok END
  FROM (
    SELECT *, coalesce(lag(hit) OVER (PARTITION BY w ORDER BY pos), false) AS gone
    FROM (
      SELECT *, rank = best AND (l <> r OR (rn - run) % 2 = 0) AS hit
      FROM (
        SELECT *, max(CASE WHEN rank = best AND before IS DISTINCT FROM rank THEN rn END) OVER (PARTITION BY w ORDER BY pos) AS run
        FROM (
          SELECT *, min(rank) OVER (PARTITION BY w) AS best, lag(rank) OVER (PARTITION BY w ORDER BY pos) AS before
          FROM (
            SELECT x.w, x.pos, x.tok, x.rn, m.l, m.r, m.rank, m.merged
            FROM (SELECT w, pos, tok, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt,
                         row_number() OVER (PARTITION BY w ORDER BY pos) AS rn
                  FROM recurring.bpe WHERE tok IS NOT NULL AND w IN (SELECT w FROM bpe)) x
            LEFT JOIN merges m ON m.l = x.tok AND m.r = x.nxt))
        WHERE best IS NOT NULL))))
SELECT w, tok FROM bpe WHERE tok IS NOT NULL ORDER BY w, pos
"""


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes, as byte-level vocabularies write them."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(tokenizers: str) -> tuple[pa.Table, pa.Table]:
    """Merge table (l, r, rank, merged) and vocabulary (tok, hex)."""
    with open(os.path.join(tokenizers, "byte_bpe_50k.json"), encoding="utf-8") as f:
        model = json.load(f)["model"]
    alphabet, vocab = byte_alphabet(), model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    merges = pa.table({
        "l": pa.array([vocab[a] for a, _ in pairs], pa.int32()), "r": pa.array([vocab[b] for _, b in pairs], pa.int32()),
        "rank": pa.array(range(len(pairs)), pa.int32()), "merged": pa.array([vocab[a + b] for a, b in pairs], pa.int32()),
    })
    usable = {t: i for t, i in vocab.items() if all(c in alphabet for c in t)}
    words = pa.table({"tok": pa.array(usable.values(), pa.int32()), "hex": ["".join(f"{alphabet[c]:02X}" for c in t) for t in usable]})
    return merges, words


class Recursive:
    """One DuckDB with the merge table and the vocabulary."""

    def __init__(self, merges: pa.Table, words: pa.Table, chunk: int = CHUNK):
        import duckdb

        self.chunk = chunk
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{DATABASE_MB}MB", "temp_directory": ""})
        self._table("merges", merges)
        self._table("vocab", words)
        self.bytes = {t: bytes.fromhex(h) for t, h in zip(words["tok"].to_pylist(), words["hex"].to_pylist(), strict=True)}
        self.fit: dict[tuple[int, int], bool] = {}
        one = words.filter(pc.equal(pc.utf8_length(words["hex"]), 2))
        self.byte = np.zeros(256, np.int32)
        self.byte[[int(h, 16) for h in one["hex"].to_pylist()]] = one["tok"].to_numpy()

    def _table(self, name: str, data: pa.Table) -> None:
        self.db.register("incoming", data)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def encode(self, found: list[bytes]) -> list[np.ndarray]:
        size = np.array([len(x) for x in found], np.int64)
        out: list = [None] * len(found)
        for way, chosen in ((self._pieces, np.flatnonzero(size <= LONG)), (self._stretches, np.flatnonzero(size > LONG))):
            for i, tokens in zip(chosen.tolist(), way([found[i] for i in chosen.tolist()]), strict=True):
                out[i] = tokens
        return out

    def _pieces(self, found: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(found)
        size = np.array([len(x) for x in found], np.int64)
        for query, chosen in ((LEFTMOST, np.flatnonzero(size <= WIDE)), (EVERYWHERE, np.flatnonzero(size > WIDE))):
            if len(chosen):
                for i, tokens in zip(chosen.tolist(), self._contract(query, [found[i] for i in chosen.tolist()]), strict=True):
                    out[i] = tokens
        return out

    def _stretches(self, found: list[bytes]) -> list[np.ndarray]:
        owner = [i for i, x in enumerate(found) for _ in range(0, len(x), LONG)]
        raw = [x[s : s + LONG] for x in found for s in range(0, len(x), LONG)]
        tokens = self._pieces(raw)
        while bad := self._unfit(owner, tokens):
            keep, last, joined = [], -1, {}
            for k in bad:
                if k > last:  # not where the stretch before has just been joined
                    joined[k], last = raw[k] + raw[k + 1], k + 1
            new = dict(zip(joined, self._pieces([*joined.values()]), strict=True))
            for k in range(len(raw)):
                if k in new:
                    raw[k], tokens[k] = joined[k], new[k]
                if k - 1 not in new:
                    keep.append(k)
            owner, raw, tokens = ([x[k] for k in keep] for x in (owner, raw, tokens))
        cuts = np.searchsorted(owner, np.arange(len(found) + 1))
        return [np.concatenate(tokens[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def _unfit(self, owner: list[int], tokens: list[np.ndarray]) -> list[int]:
        """Places k where the last token of stretch k and the first of the next can't stand side by side."""
        meet = {k: (int(tokens[k][-1]), int(tokens[k + 1][0])) for k in range(len(owner) - 1) if owner[k] == owner[k + 1]}
        if len(self.fit) > PAIRS:
            self.fit.clear()
        new = [*{p for p in meet.values() if p not in self.fit}]
        got = self._pieces([self.bytes[a] + self.bytes[b] for a, b in new])
        self.fit |= {p: x.tolist() == [*p] for p, x in zip(new, got, strict=True)}
        return [k for k, p in meet.items() if not self.fit[p]]

    def _contract(self, query: str, found: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(found)
        size = np.array([len(x) for x in found], np.int64)
        self.db.execute(f"SET memory_limit = '{DATABASE_MB + int(size.max()) * 400 // 10**6}MB'")  # one longest text must fit
        order = np.argsort(size, kind="stable")  # pieces of one length end in about the same round
        found, size = [found[i] for i in order.tolist()], size[order]
        part = np.cumsum(size) // self.chunk
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(found)]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            n = size[a:b]
            raw = np.frombuffer(b"".join(found[a:b]), np.uint8)
            w = np.repeat(np.arange(b - a, dtype=np.int32), n)
            pos = (np.arange(len(raw)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            self._table("start", pa.table({"w": w, "pos": pos, "tok": self.byte[raw]}))
            got = self.db.execute(query).fetchnumpy()
            for i, tokens in zip(order[a:b].tolist(), np.split(np.asarray(got["tok"], np.int32), np.searchsorted(got["w"], np.arange(1, b - a))), strict=True):
                out[i] = tokens
        return out

    def decode(self, rows: np.ndarray, tokens: np.ndarray, n: int) -> list[bytes]:
        """Bytes of ``n`` rows from their tokens in order; unknown tokens are an error."""
        self._table("given", pa.table({"d": rows.astype(np.int32), "i": np.arange(len(tokens), dtype=np.int32), "tok": tokens}))
        got = self.db.execute("SELECT d, count(hex) = count(*), string_agg(hex, '' ORDER BY i) FROM given LEFT JOIN vocab USING (tok) GROUP BY d").fetchall()
        out = [b""] * n
        for d, known, h in got:
            if not known:
                raise ValueError("a token is not in the vocabulary")
            out[d] = bytes.fromhex(h)
        return out


_kept: list[tuple[pa.Table, Recursive, P.Memo]] = []


def _engine(merges: pa.Table, words: pa.Table) -> tuple[Recursive, P.Memo]:
    """The database and the memo of this Python worker, kept from task to task while the merges are the same."""
    if not _kept or not _kept[0][0].equals(merges):
        db = Recursive(merges, words)
        _kept[:] = [(merges, db, P.Memo(db.encode, limit=MEMO_BYTES))]
    return _kept[0][1:]


def encode(docs: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    ship(docs.sparkSession)
    merges, words = load(tokenizers)

    def run(batches):
        db, memo = _engine(merges, words)
        for c in T.slices(batches):
            texts = c.column(1).to_pylist()
            p = P.pieces(texts)
            tokens, n = memo.tokens(p)
            counts = P.by_doc(p, n, len(texts))
            ends = np.concatenate(([0], np.cumsum(counts)))
            back = db.decode(np.repeat(np.arange(len(texts)), counts), tokens, len(texts))
            same = [None if t is None else t.encode() == x for t, x in zip(texts, back, strict=True)]
            null = np.array([t is None for t in texts], bool)
            valid = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
            lists = pa.Array.from_buffers(pa.list_(pa.int32()), len(texts), [valid, pa.py_buffer(ends.astype(np.int32))], children=[pa.array(tokens, pa.int32())])
            yield pa.RecordBatch.from_arrays([c.column(0), pa.array(counts.astype(np.int32), mask=null), lists, pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "tokens", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, n_tokens int, tokens array<int>, round_trip boolean")


def decode(encoded: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, text) of rows (doc_id, tokens)."""
    ship(encoded.sparkSession)
    merges, words = load(tokenizers)

    def run(batches):
        db, _ = _engine(merges, words)
        for b in batches:
            lists = b.column(1)
            n = np.diff(lists.offsets.to_numpy())
            back = db.decode(np.repeat(np.arange(b.num_rows), n), lists.flatten().to_numpy(), b.num_rows)
            text = [x.decode("utf-8", "replace") if ok else None for x, ok in zip(back, lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "tokens").mapInArrow(run, "doc_id bigint, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
