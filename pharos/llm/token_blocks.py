"""Token-ID output in patched frame-of-reference blocks.

A document's token ids (public 50k byte-level BPE) are cut into blocks of 128. Each block stores its
minimum and the differences from it, packed at a width that fits ``PERCENTILE`` per cent of them;
the high bits of larger ones (outliers) go to an exception list of the block. ``block_starts`` gives
the byte offset of each block, so token i is read from block i // 128 alone.

Block: minimum (u32), width (u8), exceptions (u8), tokens - 1 (u8), 16 * width bytes of packed
differences (little-endian bits, 128 places), exception places (u8 each), exception high bits (u32 each).

Result: ``doc_id, n_tokens, blocks, block_starts``, one row for each row of the input.

Defined results: a null text gives null blocks and null counts; an empty one no block; a null doc_id
stays null; repeated rows are encoded each; other columns are ignored; an empty table stays empty;
in a block of equal ids the width is 0.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pharos.llm import pieces as P
from pharos.llm import textkit as T
from pharos.runtime import ship, table

TOKENIZERS = "/opt/tokenizers"
BLOCK, PERCENTILE = 128, 90
HEAD = 7


def bit_length(x: np.ndarray) -> np.ndarray:
    out = np.zeros(x.shape, np.int64)
    x = x.astype(np.int64)
    for b in (16, 8, 4, 2, 1):
        big = x >> b > 0
        out += np.where(big, b, 0)
        x = np.where(big, x >> b, x)
    return out + (x > 0)


def pack(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of several documents: (bytes, byte offset of every block and the end, blocks by document)."""
    blocks = -(-counts // BLOCK)
    total = int(blocks.sum())
    if not total:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), blocks
    owner = np.repeat(np.arange(len(counts)), blocks)
    nth = np.arange(total) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = np.repeat(np.cumsum(counts) - counts, blocks) + nth * BLOCK
    n = np.minimum(BLOCK, counts[owner] - nth * BLOCK)
    place = begin[:, None] + np.minimum(np.arange(BLOCK)[None, :], n[:, None] - 1)  # a last block is padded with its last token
    m = tokens[place].astype(np.int64)
    low = m.min(axis=1)
    d = m - low[:, None]
    ranked = np.sort(d, axis=1)
    width = bit_length(ranked[:, -(-BLOCK * PERCENTILE // 100) - 1])
    out = (d >> width[:, None] > 0) & (np.arange(BLOCK)[None, :] < n[:, None])
    excess = out.sum(axis=1)
    size = HEAD + 16 * width + 5 * excess
    at = np.concatenate(([0], np.cumsum(size)))
    buf = np.zeros(int(at[-1]), np.uint8)
    head = np.zeros((total, HEAD), np.uint8)
    head[:, :4] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    head[:, 4], head[:, 5], head[:, 6] = width, excess, n - 1
    buf[at[:-1, None] + np.arange(HEAD)] = head
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        if w:
            bits = (d[rows][:, :, None] >> np.arange(w) & 1).astype(np.uint8).reshape(len(rows), -1)
            buf[at[rows, None] + HEAD + np.arange(16 * w)] = np.packbits(bits, axis=1, bitorder="little")
    row, col = np.nonzero(out)
    if len(row):
        first = np.cumsum(excess) - excess
        k = np.arange(len(row)) - first[row]
        base = at[row] + HEAD + 16 * width[row]
        buf[base + k] = col
        high = (d[row, col] >> width[row]).astype("<u4").view(np.uint8).reshape(-1, 4)
        buf[(base + excess[row] + 4 * k)[:, None] + np.arange(4)] = high
    return buf, at, blocks


def unpack_block(raw: bytes, start: int = 0) -> np.ndarray:
    """Token ids of the block that begins at ``start``."""
    buf = np.frombuffer(raw, np.uint8)
    low = int(buf[start : start + 4].view("<u4")[0])
    width, excess, n = int(buf[start + 4]), int(buf[start + 5]), int(buf[start + 6]) + 1
    at = start + HEAD
    bits = np.unpackbits(buf[at : at + 16 * width], bitorder="little").reshape(BLOCK, width).astype(np.int64)
    d = bits @ (1 << np.arange(width, dtype=np.int64)) if width else np.zeros(BLOCK, np.int64)
    at += 16 * width
    high = np.frombuffer(raw[at + excess : at + 5 * excess], "<u4").astype(np.int64)
    d[buf[at : at + excess]] |= high << width
    return (d[:n] + low).astype(np.int32)


def unpack(raw: bytes | None, starts: list[int] | None) -> np.ndarray | None:
    if raw is None:
        return None
    return np.concatenate([np.zeros(0, np.int32), *(unpack_block(raw, s) for s in starts)])


def token_at(raw: bytes, starts: list[int], i: int) -> int:
    return int(unpack_block(raw, starts[i // BLOCK])[i % BLOCK])


def encoder(tokenizers: str):
    import tiktoken

    with open(os.path.join(tokenizers, "byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    core = tiktoken.Encoding("byte_bpe_50k", pat_str=r"[\s\S]", mergeable_ranks=ranks, special_tokens={})._core_bpe
    return lambda found: [core.encode_single_piece(x) for x in found]


def encode(docs: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    ship(docs.sparkSession)

    def run(batches):
        memo = P.Memo(encoder(tokenizers))
        for c in T.slices(batches, 500):
            texts = c.column(1).to_pylist()
            p = P.pieces(texts)
            tokens, n = memo.tokens(p)
            counts = P.by_doc(p, n, len(texts))
            buf, at, blocks = pack(tokens, counts)
            ends = np.concatenate(([0], np.cumsum(blocks)))
            offsets = at[ends].astype(np.int32)
            null = np.array([t is None for t in texts], bool)
            valid = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
            blob = pa.Array.from_buffers(pa.binary(), len(texts), [valid, pa.py_buffer(offsets), pa.py_buffer(buf)])
            inner = pa.array((at[:-1] - np.repeat(at[ends[:-1]], blocks)).astype(np.int32))
            starts = pa.Array.from_buffers(pa.list_(pa.int32()), len(texts), [valid, pa.py_buffer(ends.astype(np.int32))], children=[inner])
            yield pa.RecordBatch.from_arrays([c.column(0), pa.array(counts.astype(np.int32), mask=null), blob, starts], ["doc_id", "n_tokens", "blocks", "block_starts"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, n_tokens int, blocks binary, block_starts array<int>")


def decode(encoded: DataFrame) -> DataFrame:
    """(doc_id, tokens) of ``encode``'s rows."""

    def run(batches):
        for b in batches:
            rows = [unpack(x, s) for x, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "tokens"])

    return encoded.select("doc_id", "blocks", "block_starts").mapInArrow(run, "doc_id bigint, tokens array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
