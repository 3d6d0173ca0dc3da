"""BPE by recursive SQL, token blocks, and the pipeline."""

import base64
import random

import numpy as np
import pytest

import corpus_pipeline
import public_tokenizers as public
import tiktoken
from pharos.llm import bpe, pieces, token_blocks
from pharos.llm import jaccard_join as J
from pharos.llm import queries
from tests.conftest import SF

TEXTS = [
    "", None, "Hello world, it's  we'll 're ''s  \n\n x\t y  ", "a" * 900 + " " * 70 + "=" * 300, "  lead", "I'M 12ab³ é　ü   z", "漢字 🙂🙂 ok", "'s's't'", "x\n", " ", "tail   ", "don't'll",
    "<|endoftext|>", "pneumonoultramicroscopicsilicovolcanoconiosis " * 3,
]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    e = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda t: e.encode_ordinary(t)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, [1], True) for i, t in enumerate(texts)] + [(None, "no id", [1], True), (0, "again", [1], True)], "doc_id long, text string, tokens array<int>, round_trip boolean")


def test_pieces(reference):
    import regex

    rng = random.Random(1)
    alphabet = ["a", "B", "1", " ", "  ", "\n", "'", "s", "ll", "re", ".", "é", "字", " ", "_"]
    texts = TEXTS + ["".join(rng.choices(alphabet, k=rng.randrange(25))) for _ in range(800)]
    p = pieces.pieces(texts)
    raw = p.buf.tobytes()
    got = [[] for _ in texts]
    for a, b, d in zip(p.start.tolist(), p.end.tolist(), p.doc.tolist(), strict=True):
        got[d].append(raw[a:b].decode())
    pattern = regex.compile(public.PATTERN)
    assert got == [pattern.findall(t or "") for t in texts]


def test_bpe(spark, reference):
    docs = frame(spark, TEXTS)
    out = bpe.encode(docs)
    got = [(r.doc_id, r.tokens, r.n_tokens, r.round_trip) for r in out.collect()]
    want = [(i, None if t is None else reference(t)) for i, t in [*enumerate(TEXTS), (None, "no id"), (0, "again")]]
    assert sorted(got, key=repr) == sorted(((i, x, None if x is None else len(x), None if x is None else True) for i, x in want), key=repr)
    back = sorted(((r.doc_id, r.text) for r in bpe.decode(out).collect()), key=repr)
    assert back == sorted([*enumerate(TEXTS), (None, "no id"), (0, "again")], key=repr)
    assert bpe.encode(docs.where("false")).count() == 0


def test_both_recursions_agree():
    db = bpe.Recursive(*bpe.load(bpe.TOKENIZERS))
    rng = random.Random(2)
    found = [bytes(rng.choices(b"abcab \xc3\xa9th", k=rng.randrange(1, 40))) for _ in range(200)]
    found += [bytes(rng.choices(b"abcthe", k=rng.randrange(65, 200))) for _ in range(40)]
    a, b = db._contract(bpe.LEFTMOST, found), db._contract(bpe.EVERYWHERE, found)
    assert [x.tolist() for x in a] == [x.tolist() for x in b]


def test_long_pieces_in_stretches(monkeypatch):
    db, whole = bpe.Recursive(*bpe.load(bpe.TOKENIZERS)), token_blocks.encoder(bpe.TOKENIZERS)
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    found = ["".join(rng.choices(letters, k=rng.choice([65, 127, 128, 129, 200, 700]))).encode() for _ in range(60)]
    found += ["".join(rng.choices("eatinos", k=400)).encode() for _ in range(15)] + [("a" * n).encode() for n in (63, 64, 65, 128, 129, 1500)] + [("abc" * n).encode() for n in (30, 700)]
    found += [("the" * 50 + "x" + "ing" * 60).encode(), ("é" * 300).encode(), bytes(rng.randrange(256) for _ in range(900)), "".join(rng.choices("ACGT", k=3000)).encode(), ("日本語" * 200).encode()]
    want = whole(found)
    assert [x.tolist() for x in db.encode(found)] == want
    monkeypatch.setattr(bpe, "WIDE", 150)  # what two stretches make goes to the other recursion
    monkeypatch.setattr(bpe, "PAIRS", 50)
    assert [x.tolist() for x in db.encode(found)] == want


def test_a_very_long_piece():
    import time

    db = bpe.Recursive(*bpe.load(bpe.TOKENIZERS))
    piece = "".join(random.Random(5).choices("abcdefghijklmnopqrstuvwxyz", k=200_000)).encode()
    began = time.time()
    assert db.encode([piece])[0].tolist() == token_blocks.encoder(bpe.TOKENIZERS)([piece])[0]
    assert time.time() - began < 120
    again = b"ab" * 100_000  # periodic: its stretches grow together
    assert db.encode([again])[0].tolist() == token_blocks.encoder(bpe.TOKENIZERS)([again])[0]


def test_memo_is_bounded_by_bytes():
    calls = []
    memo = pieces.Memo(lambda found: (calls.append(len(found)), [[len(x)] for x in found])[1], limit=10 * pieces.ENTRY)
    for i in range(6):
        tokens, n = memo.tokens(pieces.pieces([" ".join(f"w{chr(97 + i)}{chr(97 + j)}" for j in range(8))]))
        assert len(n) == 8 and memo.held() <= 19 * (pieces.ENTRY + 4)
    assert sum(calls) == 48


def plain_unpack(raw, start):
    """The block at ``start``, bit by bit, from the format's description."""
    low, width, excess, n = int.from_bytes(raw[start : start + 4], "little"), raw[start + 4], raw[start + 5], raw[start + 6] + 1
    bits = int.from_bytes(raw[start + 7 : start + 7 + 16 * width], "little")
    out = [bits >> width * i & (1 << width) - 1 for i in range(128)]
    at = start + 7 + 16 * width
    for e in range(excess):
        high = raw[at + excess + 4 * e : at + excess + 4 * e + 4]
        out[raw[at + e]] |= int.from_bytes(high, "little") << width
    return [low + x for x in out[:n]]


def test_blocks_by_an_independent_decoder():
    rng = np.random.default_rng(9)
    docs = [rng.integers(0, 50257, 1), rng.integers(0, 50257, 300), np.where(rng.random(4000) < 0.08, 50_000, rng.integers(5, 40, 4000)), np.full(129, 3), rng.integers(0, 1 << 31, 260)]
    counts = np.array([len(d) for d in docs])
    buf, at, _ = token_blocks.pack(np.concatenate(docs), counts)
    got = [x for a in at[:-1].tolist() for x in plain_unpack(buf.tobytes(), a)]
    assert got == np.concatenate(docs).tolist()
    # widths are those of the percentile: at most a tenth of a block are exceptions
    assert all(buf[a + 5] <= 128 - -(-128 * token_blocks.PERCENTILE // 100) for a in at[:-1].tolist())


def test_blocks(spark, reference):
    docs = frame(spark, [*TEXTS, "word " * 1000, "1 " * 700])
    out = token_blocks.encode(docs)
    back = {(r.doc_id, tuple(r.tokens) if r.tokens is not None else None) for r in token_blocks.decode(out).collect()}
    assert back == {(i, None if t is None else tuple(reference(t))) for i, t in [*enumerate([*TEXTS, "word " * 1000, "1 " * 700]), (None, "no id"), (0, "again")]}
    for r in out.where("n_tokens > 130").collect():
        want = reference(dict(enumerate([*TEXTS, "word " * 1000, "1 " * 700]))[r.doc_id])
        assert [token_blocks.token_at(r.blocks, r.block_starts, i) for i in (0, 127, 128, r.n_tokens - 1)] == [want[i] for i in (0, 127, 128, len(want) - 1)]
    assert token_blocks.encode(docs.where("false")).count() == 0


def test_block_round_trip():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50257, n) for n in (0, 1, 127, 128, 129, 1000)] + [np.full(300, 7), np.where(rng.random(500) < 0.05, 50000, rng.integers(10, 20, 500))]
    counts = np.array([len(d) for d in docs])
    buf, at, blocks = token_blocks.pack(np.concatenate(docs), counts)
    ends = np.concatenate(([0], np.cumsum(blocks)))
    for d, a, z in zip(docs, ends[:-1], ends[1:], strict=True):
        assert token_blocks.unpack(buf[at[a] : at[z]].tobytes(), (at[a:z] - at[a]).tolist()).tolist() == d.tolist()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "PII", "byte-level BPE"]
    step, seen = docs, []
    for _, f in corpus_pipeline.STAGES[:-1]:
        step = f(spark, step, SF)
        assert step.columns == docs.columns
        seen.append({r.doc_id for r in step.select("doc_id").collect()})
    # brute force: each stage's decisions from its own operator, on the driver
    text = {r.doc_id: r.text for r in docs.collect()}
    from pharos.llm import langid, pii
    from tests.llm.test_joins import brute_hits, brute_pairs

    m = langid.fit(docs)
    best, bits, _ = m.judge(list(text.values()))
    known = {i for i, b, x in zip(text, best, bits, strict=True) if b >= 0 and x <= langid.MAX_BITS}
    assert seen[0] == known
    root = {i: i for i in known}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b, _ in brute_pairs([(i, text[i]) for i in known], J.THRESHOLD):
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert seen[1] == {i for i in known if find(i) == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    small = [(i, text[i]) for i in seen[1] if len(text[i]) < 4000]
    dirty = {h[0] for h in brute_hits(small, items[:12], 8)}
    assert not dirty & seen[2] and seen[2] <= seen[1]
    tagger = pii.Tagger(pii.model())
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(final) == seen[3] == seen[2] and all(r.round_trip for r in final.values())
    redacted = {r.doc_id: r.text for r in step.collect()}
    some = [i for i in seen[2] if not pii.findings([text[i]], tagger)]
    assert some and all(redacted[i] == text[i] for i in some)


def test_pipeline_edge_cases(spark, tmp_path, reference):
    """Null ids, labels and texts, empty texts, repeated rows and ids, a very long text, clashing columns, an empty table."""
    base = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(150).collect()]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    prose = next(t for _, t, la in base if la == "en" and len(t) > 300)
    long = random.Random(1).choices([w for _, t, la in base if la == "en" for w in t.split() if w.isalpha()], k=60_000)
    rows = [*base, base[0], (None, prose + " of its own kind", "en"), (None, item, "en"), (9001, None, "en"), (9002, "", None), (9003, prose, None), (9003, item, "en"), (9004, " ".join(long), "en")]
    sf = str(tmp_path)
    docs = spark.createDataFrame([(i, t, la, "s", 0, 1, "b") for i, t, la in rows], "doc_id long, text string, lang string, source string, n_chars int, size int, block string")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{sf}/benchmark.parquet")
    kept = spark.read.parquet(f"{sf}/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.materialise(f(spark, kept, sf))
        assert kept.columns == docs.columns, name
    left = [(r.doc_id, r.text) for r in kept.collect()]
    ids = [i for i, _ in left]
    assert 9001 not in ids and 9002 not in ids and ids.count(None) == 1 and 9004 in ids  # no text; no text; the item's row of two without an id
    assert all(item not in (t or "") for _, t in left)
    out = {(r.doc_id, tuple(r.tokens)) for r in corpus_pipeline.run(spark, sf).collect()}
    assert out == {(i, tuple(reference(t))) for i, t in left}
    docs.where("false").write.mode("overwrite").parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_pipeline_benchmark_and_tokens(spark, reference):
    words = lambda t: "".join(c if c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split()
    spans = lambda t: {tuple(w[i : i + 8]) for w in [words(t)] for i in range(len(w) - 7)}
    kept = spark.read.parquet(f"{SF}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:2]:
        kept = corpus_pipeline.materialise(f(spark, kept, SF))
    text = {r.doc_id: r.text for r in kept.collect()}
    shared = set().union(*(spans(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()))
    clean = {i for i, t in text.items() if not spans(t) & shared}
    assert 0 < len(clean) < len(text)
    clear = {r.doc_id: r.text for r in corpus_pipeline.without_personal_data(spark, kept, SF).collect()}
    final = {r.doc_id: (r.n_tokens, r.tokens) for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(final) == clean
    assert all(final[i] == (len(want), want) for i in clean for want in [reference(clear[i])])


def test_registered_queries(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
