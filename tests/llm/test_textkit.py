import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pharos.llm import textkit as T

ODD = ["", None, "one", "a b c d e f g h", "  lead", "x" * 5000 + " y", "É é É", "tab\tnew\nline", "same same same same same same same", " nbsp ", "🙂 🙂🙂"]


def test_words():
    w = T.words(ODD, "raw")
    raw = w.buf.tobytes()
    for d, t in enumerate(ODD):
        got = [raw[w.start[i] : w.end[i]].decode() for i in range(w.first[d], w.first[d + 1])]
        assert got == [x for x in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    assert len(T.words([], "raw")) == 0
    n = T.words(["Hello, WORLD-9 x_y é"], "norm")
    assert [n.buf.tobytes()[a:b].decode() for a, b in zip(n.start, n.end, strict=True)] == ["hello", "world", "9", "x", "y", "é"]


def test_hash_depends_on_the_word_only():
    a, b = T.words(["alpha beta gammagammagamma", "zz gammagammagamma alpha"]), T.words(["beta"])
    assert a.hash[0] == a.hash[5] and a.hash[2] == a.hash[4] and a.hash[1] == b.hash[0] and len(set(a.hash.tolist())) == 4


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=30), max_size=4), st.integers(1, 4), st.integers(1, 6))
def test_winnowing_by_definition(docs, k, window):
    w = T.words([" ".join(d) for d in docs])
    at, h = T.winnow(w, k, window)
    want = set()
    for d in range(len(docs)):
        a, z = w.first[d], w.first[d + 1]
        g, gh = T.grams(w, k)
        mine = [(int(i), int(x)) for i, x in zip(g, gh, strict=True) if a <= i < z]
        for s in range(max(1, len(mine) - window + 1)) if mine else ():
            part = mine[s : s + window]
            least = min(x for _, x in part)
            want.add([i for i, x in part if x == least][-1])
    assert set(at.tolist()) == want


def test_guarantee():
    rng = random.Random(3)
    shared = [f"w{rng.randrange(9)}" for _ in range(8)]
    for _ in range(50):
        a = [f"a{rng.randrange(99)}" for _ in range(rng.randrange(30))] + shared + [f"a{rng.randrange(99)}" for _ in range(rng.randrange(30))]
        b = [f"b{rng.randrange(99)}" for _ in range(rng.randrange(30))] + shared
        (_, x), (_, y) = (T.winnow(T.words([" ".join(t)]), 5, 4) for t in (a, b))
        assert set(x.tolist()) & set(y.tolist())


def test_argmin():
    a = np.array([3, 1, 1, 2, 0, 5], np.uint64)
    assert T.sliding_argmin(a, 3).tolist() == [2, 2, 4, 4]
