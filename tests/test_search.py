"""The engine against a brute-force scorer and by hand."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pharos.functions import tokenizer as Z
from pharos.operators import index as I
from pharos.operators.facet_counts import FacetError, distribution
from pharos.plans.criteria import CriterionError
from pharos.plans.filters import FilterError
from pharos.plans.query import Phrase, branches
from pharos.plans.derive import typos
from pharos.search import Index, fetch
from pharos.settings import RESET, Settings, SettingsError


def places(text):
    """Positions of the words of one text, by definition."""
    out, pos, started = [], -1, False
    step = 1
    for t in Z.analyse(text):
        if t.kind in ("word", "stop"):
            pos = 0 if not started else pos + step
            started, step = True, 1
            out.append((pos, t.lemma))
        elif started and t.kind == "hard":
            step = 8
    return out


@pytest.mark.parametrize("text", ["", "...", "Hello, World! foo bar.baz", "  ,lead (and) trail; ", "été à l'école\n\nneuf", "a" * 300 + " b", "x|y [z]"])
def test_positions(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = sorted((r.pos, r.word) for r in I.tokens(df, ["text"]).collect())
    assert got == [p for p in places(text) if len(p[1].encode()) <= 250]


def test_text_of_nested_values(spark):
    df = spark.createDataFrame([(1, ["a b", "c"], ("x", 2))], "doc_id int, l array<string>, s struct<k:string,n:int>")
    got = sorted((r.fid, r.pos, r.word) for r in I.tokens(df, ["l", "s"]).collect())
    assert got == [(0, 0, "a"), (0, 1, "b"), (0, 9, "c"), (1, 0, "k"), (1, 1, "x"), (1, 9, "n"), (1, 10, "2")]


def brute(docs, forms, fields):
    """words, typo, proximity and attribute of every hit, from the definitions."""
    out = {}
    for d in docs:
        occ = [(f, p, w) for f, name in enumerate(fields) for p, w in places(d[name] or "")]

        def unit(u, occ=occ):
            if isinstance(u, Phrase):
                return [(f, p, p + len(u.words) - 1, 0) for f, p, _ in occ if all((f, p + i, w) in occ for i, w in enumerate(u.words))]
            return [(f, p, p, t) for f, p, w in occ if (t := typos(u.word, w, u.prefix, u.typos)) is not None]

        best = None
        for k, seq in forms:
            ev = [unit(u) for u in seq]
            if not all(ev):
                continue
            typo = sum(min(t for *_, t in e) for e in ev)
            prox = 0
            for a, b in zip(ev, ev[1:], strict=False):
                dist = [y[1] - x[2] if y[1] > x[1] else x[1] - y[2] + 1 for x in a for y in b if x[0] == y[0] and x[1] != y[1]]
                prox += min(7, max(0, min([8, *dist]) - 1))
            pos = sorted(min(f * 65536 + p for f, p, *_ in e) for e in ev)
            attr = sum(max(0, p - i) for i, p in enumerate(pos)) * 2520 // len(pos)
            if best is None or k < best[0]:
                best = (k, typo, prox, attr)
            elif k == best[0]:
                best = (k, min(best[1], typo), min(best[2], prox), min(best[3], attr))
        if best:
            out[d["id"]] = best
    return out


def test_against_brute_force(spark):
    rng = random.Random(102)
    vocab = ["hello", "hullo", "world", "wordl", "cruel", "america", "good", "day", "helloworld", "the"]
    docs = [{"id": i, "title": " ".join(rng.choices(vocab, k=rng.randint(0, 4))), "body": rng.choice([", ", " "]).join(rng.choices(vocab, k=rng.randint(1, 9)))} for i in range(60)]
    ix = Index(spark.createDataFrame(docs, "id int, title string, body string").cache(), Settings(searchable=("title", "body"), synonyms={"america": ["good day"]}), key="id")
    for q in ("hello world amer", "world hello ", 'cruel "good day" ', "helo america "):
        for strategy in ("last", "any"):
            s = ix.search(q).terms_matching_strategy(strategy).expand(True, False).criteria("words", "typo", "proximity", "attribute")
            got = {r["id"]: (r["words"], r["typo"], r["proximity"], r["attribute"]) for r in s.candidates().collect()}
            assert got == brute(docs, branches(s.tree()), ("title", "body")), (q, strategy)


FIXTURE = [
    ("A", "hell o", "word of the american"), ("B", "hello", "nothing else"), ("G", "hello world day", "x"), ("H", "world hello day", "x"),
    ("J", "hello cruel world", "x"), ("M", "hello world america", "x"), ("N", "hello world america now", "x"), ("Q", "x", "hello world"),
]


def test_hand_ranked(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(FIXTURE)], "n int, id string, title string, body string")
    ix = Index(df, Settings(searchable=("title", "body"), sortable=("id",)), key="n")
    got = [r.id for r in ix.search("hello world america ").execute().collect()]
    assert got[:2] == ["M", "N"]  # all words; M equals the query, N starts with it
    assert got.index("G") < got.index("J") and got.index("G") < got.index("H")  # proximity
    assert got.index("G") < got.index("Q")  # attribute
    assert got[-1] in ("B",) and set(got) >= {"A", "B", "G", "H", "J", "M", "N", "Q"}
    assert [r.id for r in ix.search("hello").criteria("words", "sort").sort_criteria("id:desc").limit(2).execute().collect()] == ["Q", "N"]
    with pytest.raises(CriterionError):
        ix.search("hello").criteria("words").sort_criteria("id:desc").execute()
    with pytest.raises(CriterionError):
        ix.search("hello").sort_criteria("title:asc").execute()
    with pytest.raises(FilterError):
        ix.search("hello").filter("title = x").execute()


def test_stop_words_and_exact_attributes(spark):
    df = spark.createDataFrame([(1, "the cat", "clown"), (2, "a dog", "clwon")], "doc_id int, t string, u string")
    ix = Index(df, Settings(searchable=("t", "u"), stop_words=frozenset(["the"]), exact_attributes=("u",)))
    assert {r.doc_id for r in ix.search("clown ").expand(False, False).candidates().collect()} == {1}
    assert {r.doc_id for r in ix.search("the cat ").expand(False, False).candidates().collect()} == {1}


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "cat", 9), (2, "cat dog", 8)], "doc_id int, text string, words int")
    out = Index(df, Settings(searchable=("text",))).search("cat dog ").expand(False, False).execute().collect()
    assert [(r.doc_id, r.words, r._words) for r in out] == [(2, 8, 0), (1, 9, 1)]


def test_sort_of_values(spark):
    df = spark.createDataFrame([(1, [3, 9]), (2, [5]), (3, []), (4, None), (5, [1, 20])], "doc_id int, v array<int>")
    ix = Index(df, Settings(searchable=(), sortable=("v",)))
    assert [r.doc_id for r in ix.search().sort_criteria("v:asc").execute().collect()] == [5, 1, 2, 3, 4]
    assert [r.doc_id for r in ix.search().sort_criteria("v:desc").execute().collect()] == [5, 1, 2, 3, 4]


def test_distinct(spark):
    df = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "a", ["y"]), (3, None, None), (4, None, ["z"]), (5, "b", ["x"])], "doc_id int, s string, m array<string>")
    ix = Index(df, Settings(searchable=()))
    assert [r.doc_id for r in ix.search().distinct("s").execute().collect()] == [1, 3, 4, 5]
    assert [r.doc_id for r in ix.search().distinct("m").execute().collect()] == [1, 3, 4]
    assert [r.doc_id for r in ix.search().distinct("m").offset(1).limit(1).execute().collect()] == [3]
    assert ix.search().distinct("nothing").execute().count() == 0


def test_facets(spark):
    df = spark.createDataFrame([(1, " Red", 2.0), (2, "red", 2.5), (3, "blue", None)], "doc_id int, c string, n double")
    got = {(r.field, r.value): r["count"] for r in distribution(df, ["c", "n"]).collect()}
    assert got == {("c", " Red"): 2, ("c", "blue"): 1, ("n", "2"): 1, ("n", "2.5"): 1}
    assert distribution(df, ["c"], max_values=1).count() == 1
    with pytest.raises(FacetError):
        distribution(df, ["c"], facetable={"n"})


def test_fetch(spark):
    ix = Index(spark.range(5).withColumnRenamed("id", "doc_id"), Settings(searchable=()))
    assert fetch(ix, [1, 3]).count() == 2
    with pytest.raises(KeyError):
        fetch(ix, [1, 99])


def test_geo_sort_and_missing(spark):
    df = spark.createDataFrame([(1, (0.0, 10.0)), (2, None), (3, (0.0, 1.0))], "doc_id int, _geo struct<lat:double,lng:double>")
    ix = Index(df, Settings(searchable=(), sortable=("_geo",)))
    assert [r.doc_id for r in ix.search().sort_criteria("_geoPoint(0, 0):asc").execute().collect()] == [3, 1, 2]


def test_topk_plan(spark):
    df = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("cat").alias("text"))
    hits, orders = Index(df, Settings(searchable=("text",))).search("cat ").expand(False, False).ranked()
    assert "TakeOrderedAndProject" in hits.orderBy(*orders).limit(20)._jdf.queryExecution().executedPlan().toString()


def test_typo_search_plan(spark, tmp_path):
    """Words reach the scan of the stored tokens, above which no Python runs, and the filter goes before the ranking."""
    docs = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(["worthless clown", "worthles crown", "a clwon", "nothing", "zebra clowns"])], "doc_id long, text string, even int")
    plain = Index(docs, Settings(searchable=("text",), filterable=("even",)))
    I.stored(plain.tokens).write.parquet(str(tmp_path / "t"))
    plain.vocabulary.write.parquet(str(tmp_path / "v"))
    ix = Index(docs, plain.settings, tokens=spark.read.parquet(str(tmp_path / "t")), vocabulary=spark.read.parquet(str(tmp_path / "v")))
    s = ix.search("worthlass clwon ").expand(False, False).terms_matching_strategy("any").criteria("words", "typo")
    plan = s.candidates()._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan parquet" in x and "word" in x)
    assert "Python" not in plan and "ArrowEval" not in plan
    assert "worthles" in scan.split("PushedFilters")[1] and "FileScan" in scan
    want = sorted(tuple(r) for r in plain.search("worthlass clwon ").expand(False, False).terms_matching_strategy("any").criteria("words", "typo").candidates().collect())
    assert sorted(tuple(r) for r in s.candidates().collect()) == want and {r[0] for r in want} == {0, 1, 2}
    filtered = s.filter("even = 0")
    assert sorted(tuple(r) for r in filtered.candidates().collect()) == [r for r in want if r[0] % 2 == 0]
    text = filtered.candidates()._jdf.queryExecution().executedPlan().toString()
    assert text.index("HashAggregate") < text.index("LeftSemi")  # printed from the top: the semi-join is below the ranking


def test_many_misspelt_words_are_joined(spark, monkeypatch):
    from pharos.plans import derive

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["worthless clown", "worthles crown", "a clwon", "worthlessly wrothless"])], "doc_id long, text string")
    s = Index(docs, Settings(searchable=("text",))).search("worthlass clwon ").expand(False, False).terms_matching_strategy("any").criteria("words", "typo")
    want = sorted(tuple(r) for r in s.candidates().collect())
    monkeypatch.setattr(derive, "NAMED", 1)
    assert sorted(tuple(r) for r in s.candidates().collect()) == want


def test_pages_end_at_the_cap(spark):
    ix = Index(spark.range(30).withColumnRenamed("id", "doc_id"), Settings(searchable=(), pagination_max_total_hits=12))
    assert ix.search().limit(20).execute().count() == 12 and ix.search().offset(10).limit(20).execute().count() == 2 and ix.search().offset(15).execute().count() == 0


def test_dotted_and_missing_searchable_fields(spark):
    df = spark.createDataFrame([(1, ("red", [("fox", [("jumps",)])]), "lit word")], "doc_id int, a struct<b:string,c:array<struct<d:string,e:array<struct<f:string>>>>>, `x.y` string")
    got = sorted((r.fid, r.word) for r in I.tokens(df, ["a.b", "a.c.d", "a.c.e.f", "x.y", "a.zz", "none"]).collect())
    assert got == [(0, "red"), (1, "fox"), (2, "jumps"), (3, "lit"), (3, "word")]


def test_settings():
    s, again = Settings().update(searchable=["a"], stop_words=["x"], synonyms={"a": ["b"]})
    assert again and Settings.from_json(s.to_json()) == s
    assert s.update(searchable=RESET)[0].searchable is None
    assert not s.update(max_values_per_facet=5)[1] and s.update(filterable=["f"])[1]
    with pytest.raises(SettingsError):
        s.update(one_typo=9, two_typos=3)
    with pytest.raises(SettingsError):
        s.update(nothing=1)
    with pytest.raises(SettingsError):
        Settings(primary_key="id").update(has_documents=True, primary_key="other")
    assert json.loads(s.to_json())["stop_words"] == ["x"]
