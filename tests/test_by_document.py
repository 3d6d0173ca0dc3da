"""Operators over the words of whole documents, against brute force."""

import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from pharos.operators import by_document as B
from pharos.operators import index as I
from pharos.search import Index
from pharos.settings import Settings
from tests.conftest import rows

STOP = frozenset(["the"])


@pytest.fixture(scope="module")
def made(spark):
    """Documents of two fields, ids in several rows with different texts and with copies, empty and missing texts; their tokens."""
    r = random.Random(5)
    words = ["the", "a", "ab", "abc", "abcd", "abcde", "été", "ünder", "x1", "日本語", "b"]
    text = lambda: "".join(r.choice(words) + r.choice([" ", " ", " ", ". "]) for _ in range(r.randint(0, 40)))
    data = [(r.randint(0, 25), text(), r.choice([None, "", text()])) for _ in range(40)]
    df = spark.createDataFrame(data + data[:5], "doc_id long, u string, v string").repartition(5)
    ix = Index(df, Settings(searchable=("u", "v"), stop_words=STOP, exact_attributes=("v",)))
    return ix, [r for r in ix.tokens.select("doc_id", "fid", "pos", "word").collect()]


def pairs(tokens):
    lines, out = defaultdict(list), {}
    for d, f, p, w in tokens:
        lines[d, f].append((p, w))
    for (d, _), line in lines.items():
        for p, a in line:
            for q, b in line:
                if 1 <= q - p <= 7:
                    out[a, b, d] = min(q - p, out.get((a, b, d), 9))
    return out


def prefixes(tokens, least):
    all_ = {(w[:k], w) for *_, w in tokens for k in range(1, 5) if len(w) >= k and len(w[:k].encode()) <= 4}
    n = Counter(p for p, _ in all_)
    return {(p, w) for p, w in all_ if n[p] >= least}


def sources(ix):
    return (ix.lines, STOP), (ix.tokens.repartition(3, "word"), frozenset())


def test_pairs(made):
    ix, tokens = made
    want = pairs(tokens)
    for frame, stop in sources(ix):
        assert rows(I.word_pairs(frame, stop).select("w1", "w2", "doc_id", "prox")) == sorted(((*k, v) for k, v in want.items()), key=repr)
        counts = Counter((k[2], v) for k, v in want.items())
        assert {(r.doc_id, r.prox): r.pairs for r in I.word_pair_counts(frame, stop).collect()} == counts


@pytest.mark.parametrize("forward", [True, False])
def test_prefix_pairs(made, forward):
    ix, tokens = made
    want, common = {}, prefixes(tokens, 3)
    for (a, b, d), prox in pairs(tokens).items():
        known, other = (a, b) if forward else (b, a)
        for p, w in common:
            if w == other:
                want[known, p, d] = min(prox, want.get((known, p, d), 9))
    for frame, stop in sources(ix):
        got = I.prefix_pairs(frame, 3, forward=forward, stop_words=stop).select("word", "prefix", "doc_id", "prox")
        assert rows(got) == sorted(((*k, v) for k, v in want.items()), key=repr)
        counted = {(r.prefix, r.prox): r.n for r in I.prefix_pair_counts(frame, 3, forward=forward, stop_words=stop).collect()}
        assert counted == Counter((k[1], v) for k, v in want.items())


def test_postings(made):
    ix, tokens = made
    want = {(w, d): ({f for e, f, _, x in tokens if (e, x) == (d, w)}) for d, _, _, w in tokens}
    common = prefixes(tokens, 3)
    for frame, stop in sources(ix):
        assert {(r.word, r.doc_id): {f for f, x in enumerate((r.loose, r.exact)) if x} for r in I.postings(frame, stop).collect()} == want
        assert {r.word: r.df for r in I.document_counts(frame, stop).collect()} == Counter(w for w, _ in want) == {r.word: r.df for r in ix.vocabulary.collect()}
        assert rows(I.prefix_postings(frame, 3, stop_words=stop).select("prefix", "doc_id")) == sorted({(p, d) for w, d in want for p, x in common if x == w}, key=repr)


def test_what_needs_whole_documents_shuffles_texts_only(made):
    """No window and no hash table over words or pairs: neither grows with a table."""
    ix, _ = made
    for df in (I.word_pairs(ix.lines), I.word_pair_counts(ix.lines), I.postings(ix.lines)):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "Window" not in plan and "Aggregate" not in plan and plan.index("regexp_extract_all") < plan.index("RepartitionByExpression" if "RepartitionByExpression" in plan else "Exchange")


def test_pieces_are_whole_documents(monkeypatch):
    monkeypatch.setattr(B, "WORDS", 10)
    docs = [1] * 3 + [2] + [3] * 9 + [4, 5, 6]
    t = pa.table({"doc_id": docs, "n": list(range(len(docs))), "words": [["w"] * 4] * len(docs)})
    for size in (1, 2, 5, 100):
        got = list(B._pieces(iter(t.to_batches(max_chunksize=size))))
        assert [x for p in got for x in p["n"].to_pylist()] == list(range(len(docs)))
        ids = [set(p["doc_id"].to_pylist()) for p in got]
        assert all(not a & b for i, a in enumerate(ids) for b in ids[i + 1 :]) and len(got) >= 3


def test_no_documents(spark):
    ix = Index(spark.createDataFrame([], "doc_id string, text string"))
    for df in (I.word_pairs(ix.lines), I.postings(ix.lines), I.prefix_pairs(ix.lines), I.prefix_postings(ix.lines), I.word_pair_counts(ix.lines)):
        assert df.count() == 0
    one = Index(spark.createDataFrame([(None, "red fox"), ("a", "...")], "doc_id string, text string"))
    assert I.word_pairs(one.lines).count() == 0 and rows(I.postings(one.lines).select("word", "doc_id")) == [("fox", None), ("red", None)]


def test_typos_are_sought_among_few_words(made):
    """The filter on the words goes below the vocabulary's aggregation, with the same words found."""
    from pharos.plans.derive import misspelt, typos

    ix, tokens = made
    leaves = [(0, "abcdx", False, 1), (1, "bbcde", True, 2)]
    df = misspelt(ix.vocabulary, leaves)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("levenshtein", plan.rindex("Aggregate")) > 0
    words = {w for *_, w in tokens}
    assert rows(df) == sorted(((n, w, t) for n, q, p, b in leaves for w in words if (t := typos(q, w, p, b))), key=repr)
