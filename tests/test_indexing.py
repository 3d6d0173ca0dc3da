"""A stored index over time."""

import io
import json

import pytest
from pyspark.sql import functions as F

import pharos
from pharos import cli
from pharos.indexing import Aborted, IndexDocumentsConfig, IndexerConfig, StoredIndex
from pharos.operators.lifecycle import DocumentError
from pharos.settings import RESET, SettingsError

SCHEMA = "id long, name string, age int"


def words(ix):
    return {r["word"]: r["df"] for r in ix.index().vocabulary.collect()}


def names(ix):
    return sorted((r["id"], r["name"], r["age"]) for r in ix.documents().collect())


def test_documents_come_change_and_go(spark, tmp_path):
    ix = StoredIndex(spark, str(tmp_path / "i"))
    assert ix.number_of_documents() == 0 and ix.documents().count() == 0
    steps = []
    assert ix.add_documents(spark.createDataFrame([(1, "kevin red", 5), (2, "bob red", None), (2, "bob blue", 7)], SCHEMA), progress=steps.append) == {"given": 2, "indexed": 2, "unchanged": 0}
    assert ix.primary_key == "id" and steps[0] == "reading" and steps[-1] == "publishing"
    before = {r["_extid"]: r["_docid"] for r in ix.external_ids().collect()}
    # one row as it is, one replaced, one new
    assert ix.add_documents(spark.createDataFrame([(1, "kevin red", 5), (2, "bob", None), (3, "ann red", 1)], SCHEMA)) == {"given": 3, "indexed": 2, "unchanged": 1}
    after = {r["_extid"]: r["_docid"] for r in ix.external_ids().collect()}
    assert names(ix) == [(1, "kevin red", 5), (2, "bob", None), (3, "ann red", 1)] and after["1"] == before["1"] and after["2"] != before["2"]
    # age isn't searchable text of an absent value; numbers are
    assert words(ix) == {"kevin": 1, "red": 2, "5": 1, "bob": 1, "3": 1, "1": 2, "2": 1, "ann": 1}
    assert sorted(r["id"] for r in ix.search("red ").execute().collect()) == [1, 3]
    assert ix.add_documents(spark.createDataFrame([(3, None, 2), (2, None, None)], SCHEMA), IndexDocumentsConfig("update")) == {"given": 2, "indexed": 1, "unchanged": 1}
    assert names(ix) == [(1, "kevin red", 5), (2, "bob", None), (3, "ann red", 2)]
    assert ix.delete_documents([1, 77]) == 1 and ix.delete_documents(["77"]) == 0 and ix.number_of_documents() == 2
    assert [r["id"] for r in ix.search("red ").execute().collect()] == [3] and "kevin" not in words(ix)
    assert {r["field"]: r["n"] for r in ix.field_distribution().collect()} == {"id": 2, "name": 2, "age": 1} and ix.fields() == {"id": 0, "name": 1, "age": 2} and ix.size() > 0
    meta = ix.meta
    assert ix.clear() == 2 and ix.number_of_documents() == 0 and ix.primary_key == "id" and meta["created_at"] <= ix.meta["updated_at"]


def test_a_new_field_in_a_later_batch(spark, tmp_path):
    ix = StoredIndex(spark, str(tmp_path / "i"), IndexerConfig(most_folders=2))
    for i in range(4):
        ix.add_documents(spark.createDataFrame([(i, f"n{i}", "x")], f"id long, name string, extra{i % 2} string"))
    assert ix.number_of_documents() == 4 and len(ix.meta["tables"]["documents"]) <= 2
    assert sorted(r["id"] for r in ix.search("x ").execute().collect()) == [0, 1, 2, 3]
    assert {r["field"]: r["n"] for r in ix.field_distribution().collect()} == {"id": 4, "name": 4, "extra0": 2, "extra1": 2}


def test_bad_batches_leave_the_index_as_it_was(spark, tmp_path):
    ix = StoredIndex(spark, str(tmp_path / "i"))
    ix.add_documents(spark.createDataFrame([(1, "a", 1)], SCHEMA))
    for bad in (spark.createDataFrame([("a b", 1)], "id string, n int"), spark.createDataFrame([(None, 1)], "id string, n int"), spark.createDataFrame([("5", ("x", 1.0))], "id string, _geo struct<lat:string,lng:double>")):
        with pytest.raises(DocumentError):
            ix.add_documents(bad)
    with pytest.raises(Aborted):
        ix.add_documents(spark.createDataFrame([(2, "b", 1)], SCHEMA), should_abort=lambda: True)
    assert names(ix) == [(1, "a", 1)]
    made = StoredIndex(spark, str(tmp_path / "j"))
    assert made.add_documents(spark.createDataFrame([("x",), ("y",)], "title string"), IndexDocumentsConfig(autogenerate=True))["indexed"] == 2
    assert made.primary_key == "id" and made.documents().where("id is null or length(id) < 30").count() == 0


def test_settings_are_executed(spark, tmp_path):
    ix = StoredIndex(spark, str(tmp_path / "i"))
    ix.add_documents(spark.createDataFrame([(i, f"red n{i}", i) for i in range(6)], SCHEMA))
    assert ix.update_settings(searchable=("name",), stop_words=("red",), filterable=("age",)) and words(ix) == {f"n{i}": 1 for i in range(6)}
    assert not ix.update_settings(max_values_per_facet=4, pagination_max_total_hits=3)
    assert ix.facets(["age"]).count() == 4 and ix.search().execute().count() == 3
    assert ix.search().filter("age > 3").candidates().count() == 2
    assert ix.update_settings(stop_words=RESET) and words(ix)["red"] == 6
    with pytest.raises(SettingsError):
        ix.update_settings(primary_key="name")


def test_tombstones_and_rebuilt_index_agree(spark, tmp_path):
    a, b = (StoredIndex(spark, str(tmp_path / n), IndexerConfig(tombstone_bytes=t)) for n, t in (("a", 1 << 30), ("b", 0)))
    rows = spark.range(40).select("id", F.concat(F.lit("w"), F.col("id") % 5, F.lit(" w"), F.col("id") % 7).alias("name"), (F.col("id") % 3).cast("int").alias("age"))
    for ix in (a, b):
        ix.add_documents(rows)
        ix.delete_documents(list(range(0, 12)))
    assert a.meta["tables"]["tombstones"] and not b.meta["tables"]["tombstones"]
    assert words(a) == words(b)
    found = [sorted((r["id"], r["words"], r["typo"], r["exactness"]) for r in ix.search("w1 w2 ").terms_matching_strategy("any").candidates().collect()) for ix in (a, b)]
    assert found[0] == found[1] and found[0]


def test_command_line(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"id": 1, "title": "red fox", "year": 3}\n{"id": 2, "title": "blue fox", "year": 4}\n')
    run = lambda *a: (out := io.StringIO(), cli.run(spark, [str(tmp_path / "i"), *a], out), out.getvalue())[2]
    assert json.loads(run("add", str(tmp_path / "d.jsonl")))["indexed"] == 2
    assert json.loads(run("settings", 'filterable=["year"]', 'sortable=["year"]'))["filterable"] == ["year"]
    lines = [json.loads(x) for x in run("search", "fox ", "--filter", "year > 2", "--sort", "year:desc").splitlines()]
    assert [x["id"] for x in lines] == [2, 1] and set(lines[0]) == {"id", "title", "year"}
    assert json.loads(run("delete", "1"))["deleted"] == 1 and json.loads(run("stats"))["documents"] == 1
    assert json.loads(run("clear"))["deleted"] == 1


def test_public_names():
    assert all(getattr(pharos, n) is not None for n in pharos.__all__)
    with pytest.raises(AttributeError):
        pharos.nothing  # noqa: B018
