import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pharos.functions.tokenizer import analyse
from pharos.plans import derive
from pharos.plans.criteria import CriterionError, Criterion, parse_criterion, parse_sort
from pharos.plans.query import And, Phrase, PhrasePart, Planner, Query, Word, branches, maximum_proximity, maximum_typo, primitive


def tree(text, strategy="last", **kw):
    stop = kw.pop("stop_words", frozenset())
    return Planner(**({"split_words": False} | kw)).build(primitive(text, stop), strategy)


def test_primitive():
    assert primitive("hello wor") == [Word("hello"), Word("wor", True)]
    assert primitive("hello wor ") == [Word("hello"), Word("wor")]
    assert primitive('say "good  morning" now ') == [Word("say"), PhrasePart(("good", "morning")), Word("now")]
    assert primitive('"un closed') == [PhrasePart(("un", "closed"))]
    assert primitive('"one. two"') == [PhrasePart(("one",)), PhrasePart(("two",))]
    assert primitive("the cat the", frozenset(["the"])) == [Word("cat"), Word("the", True)]
    assert primitive('"the cat"', frozenset(["the"])) == [PhrasePart((None, "cat"))]
    assert len(primitive("a b c d e f g h i j k l")) == 10
    assert primitive("Été à Paris ") == [Word("ete"), Word("a"), Word("paris")]
    assert primitive("") == [] and primitive(" .. ") == []


def test_trees():
    assert str(tree("hey friends", "all")) == "OR(AND(Tolerant{typo: 0}{hey}, PrefixTolerant{typo: 1}{friends}), PrefixTolerant{typo: 1}{heyfriends})"
    assert str(tree("hey", "all")) == "PrefixTolerant{typo: 0}{hey}"
    assert str(tree("hello ", "all", authorize_typos=False)) == "Tolerant{typo: 0}{hello}"
    assert str(tree("hi ", "all", synonyms={"hi": ["hello", "good morning"]})) == "OR(Tolerant{typo: 0}{hi}, Exact{hello}, PHRASE[good morning])"
    assert tree('"hello world"', "all") == Phrase(("hello", "world"))
    t = tree("a b c ", "all")
    assert [len(s) for _, s in branches(t)] == [3, 2, 2, 1]


def test_strategies():
    kw = {"ngrams": False, "frequency": {"aa": 1, "bbb": 3, "c": 2}.get}
    words = lambda s: [tuple(u.word for u in b) for _, b in branches(tree("aa bbb c ", s, **kw))]
    assert words("last") == [("aa", "bbb", "c"), ("aa", "bbb"), ("aa",)]
    assert words("first") == [("aa", "bbb", "c"), ("bbb", "c"), ("c",)]
    assert words("size") == [("aa", "bbb", "c"), ("aa", "bbb"), ("bbb",)]
    assert words("frequency") == [("aa", "bbb", "c"), ("aa", "c"), ("aa",)]
    assert words("all") == [("aa", "bbb", "c")]
    assert words("any") == [("aa", "bbb", "c"), ("aa",), ("bbb",), ("c",)]
    with pytest.raises(ValueError):
        tree("a b ", "some")


def test_phrases_are_kept():
    forms = branches(tree('one "two three" four ', "last", ngrams=False))
    assert all(any(isinstance(u, Phrase) for u in s) for _, s in forms) and len(forms) == 3


def test_split():
    p = Planner(pair_frequency=lambda a, b: {("hot", "gear"): 4, ("hotg", "ear"): 4}.get((a, b), 0))
    assert p.split("hotgear") == Phrase(("hot", "gear"))
    assert p.split("x") is None


def test_budget():
    p = Planner(exact_words=frozenset(["goodbye"]))
    assert [p.typos(w) for w in ("four", "fiver", "eightchr", "ninechars", "goodbye")] == [0, 1, 1, 2, 0]


def test_maxima():
    op = And((Query("a", typos=1), Query("b", typos=2), Phrase(("c", "d"))))
    assert maximum_typo(op) == 3 and maximum_proximity(op) == 14


def test_derivations_by_definition():
    assert derive.typos("zealend", "zealand", False, 1) == 1
    assert derive.typos("sealand", "zealand", False, 1) is None
    assert derive.typos("sealand", "zealand", False, 2) == 2
    assert derive.typos("zealemd", "zealand", False, 2) == 2
    assert derive.typos("ze", "zealand", True, 0) == 0
    assert derive.typos("ze", "zealand", False, 0) is None
    assert derive.distance("abcd", "abdc") == 1
    assert derive.distance("ca", "abc", most=5) == 3


@settings(max_examples=100, deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_distance_is_symmetric_and_bounded(a, b):
    d = derive.distance(a, b, most=9)
    assert d == derive.distance(b, a, most=9) and abs(len(a) - len(b)) <= d <= max(len(a), len(b))
    assert derive.distance(a, b, True, 9) == min(derive.distance(a, b[:k], most=9) for k in range(len(b) + 1))


def test_derivations_on_columns(spark):
    vocab = ["zealand", "zealend", "sealand", "zeal", "zoo", "worthless", "wortless", "wrothless", "clown", "clowns"]
    df = spark.createDataFrame([(w, 1) for w in vocab], "word string, df long")
    leaves = [(0, "zealand", False, 1), (1, "zealand", False, 2), (2, "ze", True, 0), (3, "worthles", True, 2), (4, "clwon", True, 1)]
    got = sorted((r.leaf, r.word, r.typo) for r in derive.found(df, df, leaves).collect())
    want = sorted((i, w, t) for (i, q, p, b), w in itertools.product(leaves, vocab) if (t := derive.typos(q, w, p, b)) is not None)
    assert got == want


def test_criteria():
    assert parse_criterion("words") == Criterion("words")
    assert parse_criterion("price:asc") == Criterion("asc", "price")
    assert parse_sort("_geoPoint(1, 2.5):desc").point == (1.0, 2.5)
    for bad in ("nothing", "price", "price:up", "_geoPoint(1):asc", "_geoPoint(91, 0):asc", "_geoRadius(1,2,3):asc", "_geo:asc", ":asc"):
        with pytest.raises(CriterionError):
            parse_sort(bad)
    with pytest.raises(CriterionError):
        parse_criterion("_geoPoint(1, 2):asc")


def test_analyse():
    assert [(t.kind, t.lemma) for t in analyse("Hé, you_two")] == [("word", "he"), ("hard", ", "), ("word", "you"), ("soft", "_"), ("word", "two")]
