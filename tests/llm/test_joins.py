"""Near duplicates, repeated passages and contamination: edge cases and brute force."""

import random

import pytest

from pharos.llm import decontaminate as D
from pharos.llm import jaccard_join as J
from pharos.llm import suffix_dedup as S
from tests.conftest import rows

SCHEMA = "doc_id long, text string, size int, gram string, a int, hash long"  # extra columns with clashing names


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "g", 2, 3) for i, t in texts], SCHEMA)


def family(seed=1, n=40):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(300)}" for _ in range(rng.choice([2, 3, 4, 6, 12, 40, 90]))] for _ in range(8)]
    out = []
    for i in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            t[rng.randrange(len(t))] = f"w{rng.randrange(300)}"
        out.append((i, " ".join(t)))
    return out


def grams(t, n=3):
    w = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "").lower()).split()
    return frozenset() if not w else frozenset([" ".join(w)]) if len(w) < n else frozenset(" ".join(w[i : i + n]) for i in range(len(w) - n + 1))


def brute_pairs(texts, t):
    sets = {}
    for i, x in texts:
        if i is not None and x is not None:
            sets[i] = sets.get(i, frozenset()) | grams(x)
    first, out = {}, []
    for i in sorted(sets):
        if sets[i]:
            if sets[i] in first:
                out.append((first[sets[i]], i, 1.0))
            first.setdefault(sets[i], i)
    reps = sorted(first.values())
    for x, i in enumerate(reps):
        for j in reps[x + 1 :]:
            s = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if s >= t:
                out.append((i, j, s))
    return sorted(out, key=repr)


@pytest.mark.parametrize("light", [None, 0, 5, 1000])
def test_jaccard_brute_force(spark, light):
    texts = [*family(), (900, None), (901, ""), (902, "..."), (None, "w1 w2 w3"), (903, "one"), (904, "ONE!"), (905, "one two"), (906, "same " * 400), (907, "same " * 9)]
    for t in (0.5, 0.8):
        assert rows(J.similar_pairs(frame(spark, texts), threshold=t, light=light)) == brute_pairs(texts, t)


def test_jaccard_repeated_rows_and_empty_tables(spark):
    texts = family(2, 12)
    assert rows(J.similar_pairs(frame(spark, texts + texts))) == brute_pairs(texts, 0.5)
    assert rows(J.similar_pairs(frame(spark, []))) == []
    assert rows(J.similar_pairs(frame(spark, [(1, None), (2, "")]))) == []


def test_all_pairs_of_copies(spark):
    rng = random.Random(4)
    texts = family(3, 30)
    texts = [(i, t) for i, (_, t) in enumerate(rng.sample([*texts, *texts[:12], *texts[:6]], 48))] + [(90, None), (91, ""), (None, texts[0][1])]
    sets = {i: grams(t) for i, t in texts if i is not None and grams(t)}
    share = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    want = sorted(((i, j, share(i, j)) for i in sets for j in sets if i < j and share(i, j) >= 0.5), key=repr)
    found = J.similar_pairs(frame(spark, texts))
    assert rows(J.all_pairs(found)) == want and len(want) > found.count()
    assert rows(J.all_pairs(J.similar_pairs(frame(spark, [])))) == []


def brute_classes(texts, t):
    sets = {}
    for i, x in texts:
        if i is not None and grams(x):
            sets[i] = sets.get(i, frozenset()) | grams(x)
    near = {i: {j for j in sets if j != i and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= t} for i in sets}
    out = []
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        if near[i]:
            out.append((i, min(seen), len(near[i])))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("light", "split", "pairs"), [(None, 4096, 200_000), (0, 3, 10), (1000, 5, 7)])
def test_classes_by_brute_force(spark, monkeypatch, light, split, pairs):
    monkeypatch.setattr(J, "SPLIT", split)
    monkeypatch.setattr(J, "PAIRS", pairs)
    monkeypatch.setattr(J, "STEP", 50)
    texts = [*family(7, 60), *((i + 200, t) for i, t in family(7, 25)), (900, None), (901, ""), (None, "w1 w2 w3"), (903, "one"), (904, "ONE!"), (905, "one two"), (906, "same " * 400), (907, "w5 " * 300 + "w6")]
    for t in (0.5, 0.7):
        assert rows(J.classes(frame(spark, texts), threshold=t, light=light)) == brute_classes(texts, t)
        assert rows(J.similar_pairs(frame(spark, texts), threshold=t, light=light)) == brute_pairs(texts, t)


def test_classes_of_repeated_rows_ties_and_empty_tables(spark):
    texts = family(2, 12)
    several = [*texts, *texts, (3, "another text of document three"), (50, "another text of document three")]
    assert rows(J.classes(frame(spark, several))) == brute_classes(several, 0.5)
    assert rows(J.classes(frame(spark, several).repartition(5, "text"))) == brute_classes(several, 0.5)
    assert rows(J.classes(frame(spark, []))) == [] and rows(J.classes(frame(spark, [(1, None), (2, "")]))) == []


def test_long_texts_and_a_hot_gram(spark):
    rng = random.Random(8)
    long = [f"w{rng.randrange(5000)}" for _ in range(60_000)]
    texts = [(1, " ".join(long)), (2, " ".join(long[:40_000])), (3, " ".join(long[:20_100])), *((i, "the hot gram " + f"x{i} y{i}") for i in range(10, 400))]
    assert rows(J.classes(frame(spark, texts))) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_light_sets_where_lists_are_long(spark):
    rng = random.Random(9)
    # short texts of a few common grams: lists are long, subsets of two are rare
    grams_ = [f"a{i} b{i} c{i}" for i in range(12)]
    texts = [(i, " ".join(rng.sample(grams_, 2) + [f"u{i}"] * (i % 2))) for i in range(1200)]
    found = J._prefixes(J.gram_table(frame(spark, texts), 3, 0.5).withColumn("n", J.F.lit(1)))
    costs = J.costs(found, 0.5)
    by = {}
    for r in found.collect():
        by.setdefault((r.doc_id, r.size), []).append(r)
    small = {k: v for k, v in by.items() if k[1] > 2}
    subs = {k: [(x.block, y.block) for i, x in enumerate(sorted(v, key=lambda r: r.block)) for y in sorted(v, key=lambda r: r.block)[i:] if x is not y or x.n > 1] for k, v in small.items()}
    for size, made, met, listed in costs:
        upto = [(k, set(s), {r.block for r in small[k] if not r.extra}) for k, s in subs.items() if k[1] <= size]
        top = [x for x in upto if x[0][1] == size]
        assert made == sum(len(s) for k, s in subs.items() if k[1] == size)
        both = [(x, y) for i, x in enumerate(upto) for y in upto[i + 1 :] if x in top or y in top]
        assert met == sum(len(x[1] & y[1]) for x, y in both) and listed == sum(len(x[2] & y[2]) for x, y in both)
    assert J.boundary(costs) > 2  # some sets are light by cost alone
    assert rows(J.classes(frame(spark, texts))) == brute_classes(texts, 0.5)


def test_one_of_each_group_stays(spark):
    texts = [(5, "a b c d e f g h"), (3, "a b c d e f g h"), (9, "a b c d e f g x"), (1, "quite another text of words"), (7, None), (8, "")]
    kept = J.keep_one(frame(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 7, 8] and kept.columns == frame(spark, []).columns
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 30)], "doc_id long, partner_id long")
    assert {r.group_id for r in J.groups(chain).collect()} == {1}


def test_stored_levels_are_as_one_batch(spark, tmp_path):
    rng = random.Random(6)
    word = lambda: f"v{rng.randrange(900)}"
    passages = [[word() for _ in range(30)] for _ in range(4)]
    texts = [(i, " ".join([word() for _ in range(rng.randrange(25))] + rng.choice(passages)[rng.randrange(6) :] + [word() for _ in range(9)])) for i in rng.sample(range(100), 40)]
    ix = S.SuffixIndex(spark, str(tmp_path / "i"), length=20, k=5, batch=30)
    sizes = []
    for a in range(0, 40, 8):
        ix.add(frame(spark, texts[a : a + 8]))
        sizes.append([n for _, n in ix.levels()])
        assert rows(ix.spans()) == brute_spans(texts[: a + 8], 20)
    assert sizes == [[8], [16], [16, 8], [32], [32, 8]]
    with pytest.raises(ValueError, match="already"):
        ix.add(frame(spark, texts[:1]))
    ix.add(frame(spark, []))
    assert rows(ix.spans()) == brute_spans(texts, 20)


def test_several_texts_of_one_id_and_a_long_text(spark):
    rng = random.Random(10)
    word = lambda: f"v{rng.randrange(3000)}"
    passage = [word() for _ in range(40)]
    long = [word() for _ in range(30_000)] + passage + [word() for _ in range(5000)]
    texts = [(1, "b " + " ".join(passage)), (1, "a " + " ".join(passage[:30])), (2, " ".join(long)), (2, " ".join(long)), (3, " ".join(passage[5:]))]
    one = [(1, "a " + " ".join(passage[:30]) + " b " + " ".join(passage)), (2, " ".join(long)), (3, " ".join(passage[5:]))]
    assert rows(S.repeated_spans(frame(spark, texts), length=20, k=5)) == brute_spans(one, 20)


def brute_spans(texts, length):
    win = {}
    for i, t in {(i, t) for i, t in texts if i is not None and t is not None}:
        w = t.split()
        for p in range(len(w) - length + 1):
            win.setdefault(tuple(w[p : p + length]), set()).add((i, p))
    hits = {}
    for places in win.values():
        if len(places) > 1:
            for i, p in places:
                hits[i, p] = min(x for x, _ in places)
    out = []
    for i, p in sorted(hits):
        if (i, p - 1) not in hits:
            q = p
            while (i, q + 1) in hits:
                q += 1
            out.append((i, p, q - p + length, min(hits[i, x] for x in range(p, q + 1))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batch", [7, 100_000])
def test_repeated_passages(spark, batch):
    rng = random.Random(5)
    word = lambda: f"v{rng.randrange(2000)}"
    passage, other = [word() for _ in range(40)], [word() for _ in range(20)]
    texts = [(i, " ".join([word() for _ in range(rng.randrange(60))] + (passage[: rng.choice([0, 19, 20, 30, 40])]) + [word() for _ in range(9)] + rng.choice([[], other]))) for i in range(30)]
    texts += [(40, "x " * 60), (41, None), (42, ""), (43, "short"), (None, " ".join(passage)), (44, " ".join(passage * 3)), texts[3], texts[3], (45, "y" * 3000 + " z")]
    got = rows(S.repeated_spans(frame(spark, texts), length=20, k=5, batch=batch))
    assert got == brute_spans(texts, 20)


def test_repeated_passages_of_nothing(spark):
    assert rows(S.repeated_spans(frame(spark, []))) == []
    assert rows(S.repeated_spans(frame(spark, [(1, "no repeats here"), (2, None)]))) == []


def test_levels_grow_geometrically():
    import numpy as np

    f = S.SuffixFamily(1)
    for i in range(64):
        keys = np.array([b"%04d" % (i * 10 + j) for j in range(10)], "S4")
        f.add(keys, np.full(10, i), np.arange(10))
    sizes = [len(x[0]) for x in f.levels]
    assert sum(sizes) == 640 and len(sizes) <= 7 and all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))


def bench(spark, items):
    return spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")


def brute_hits(texts, items, least):
    norm = lambda t: "".join(c if c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split()
    out = set()
    for i, t in texts:
        for j, s in items:
            if None in (i, t, j, s):
                continue
            a, b = norm(t), norm(s)
            for p in range(len(a)):
                for q in range(len(b)):
                    if a[p] == b[q] and not (p and q and a[p - 1] == b[q - 1]):
                        n = 0
                        while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n]:
                            n += 1
                        if n >= least:
                            out.add((i, j, p, q, n))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_contamination(spark, limit):
    rng = random.Random(7)
    words = lambda n: [f"t{rng.randrange(500)}" for _ in range(n)]
    items = [(i, " ".join(words(25))) for i in range(6)] + [(6, None), (7, ""), (None, "x " * 20), (8, "too short"), (0, " ".join(words(25))), (9, "rep " * 15)]
    texts = [(i, " ".join(words(30) + (items[i % 6][1].upper().split()[i % 9 : i % 9 + rng.choice([7, 8, 15])]) + words(10))) for i in range(25)]
    texts += [(90, None), (91, ""), (None, items[0][1]), texts[0], (92, "rep " * 20), (93, items[1][1].replace(" ", " - "))]
    got = rows(D.contamination(frame(spark, texts), bench(spark, items), broadcast_bytes=limit))
    assert got == brute_hits(texts, items, D.K + D.WINDOW - 1)


def test_contamination_of_nothing(spark):
    for limit in (1 << 20, 0):
        assert rows(D.contamination(frame(spark, []), bench(spark, [(1, "a b c d e f g h i")]), broadcast_bytes=limit)) == []
        assert rows(D.contamination(frame(spark, [(1, "a b c d e f g h i")]), bench(spark, []), broadcast_bytes=limit)) == []
    docs = frame(spark, [(1, "a b c d e f g h i"), (2, "clean text of its own"), (3, None), (None, "A b c, d e f g h i!"), (None, "also clean"), (2, "x a b c d e f g h i")])
    for limit in (1 << 20, 0):
        kept = D.decontaminate(docs, bench(spark, [(1, "z a b c d e f g h i")]), broadcast_bytes=limit)
        assert rows(kept.select("doc_id", "text")) == sorted([(2, "clean text of its own"), (3, None), (None, "also clean")], key=repr) and kept.columns == docs.columns


def test_repetitive_texts_meet_repetitive_items(spark, monkeypatch):
    texts, items = [(1, "rep " * 300), (2, "la li " * 150), (3, "rep " * 9 + "end")], [(1, "rep " * 40), (2, "li la " * 30 + "rep rep")]
    want = brute_hits(texts, items, 8)
    assert rows(D.contamination(frame(spark, texts), bench(spark, items))) == want
    monkeypatch.setattr(D, "HITS", 100)
    assert rows(D.contamination(frame(spark, texts), bench(spark, items))) == want
    big = D.contamination(frame(spark, [(1, "rep " * 100_000)]), bench(spark, [(1, "rep " * 60)]))
    assert big.count() == 100_000 + 60 - 1 - 2 * 7  # one maximal span a diagonal, of at least 8 words
