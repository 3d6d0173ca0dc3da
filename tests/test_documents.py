import pytest
from pyspark.sql import functions as F

from pharos.functions import formatting as fm
from pharos.indexing import StoredIndex
from pharos.operators import lifecycle as lc
from pharos.plans.query import Planner, primitive
from pharos.runtime import materialise
from pharos.sources import readers as rd
from pharos.streaming.ingest import ingest


def test_primary_key():
    assert lc.infer_primary_key(["name", "objectId"]) == "objectId"
    assert lc.infer_primary_key(["name"], autogenerate=True) == "id"
    for cols in (["name"], ["aid", "bid"]):
        with pytest.raises(lc.DocumentError):
            lc.infer_primary_key(cols)


def test_ids(spark):
    df = spark.createDataFrame([(("a-1",),), (("b c",),), ((None,),)], "o struct<id:string>")
    ids = lc.with_ids(df, "o.id")
    assert [r.ext_id for r in ids.collect()] == ["a-1", "b c", None] and lc.invalid_ids(ids).count() == 2
    assert lc.with_ids(df, "o.id", autogenerate=True).where("ext_id is null").count() == 0


def test_geo_errors(spark):
    df = spark.createDataFrame([(1, ("1.5", 2.0)), (2, ("x", 2.0)), (3, (None, 1.0)), (4, None), (5, ("1", float("inf")))], "id int, _geo struct<lat:string,lng:double>")
    assert {r.id for r in lc.geo_errors(df).collect()} == {2, 3, 5}


def test_upserts(spark):
    old = spark.createDataFrame([("1", "kevin", 5), ("2", "bob", None)], "ext_id string, name string, age int")
    new = spark.createDataFrame([("1", None, 6, 0), ("3", "jim", 1, 1), ("3", "jane", None, 2)], "ext_id string, name string, age int, seq int")
    assert {tuple(r) for r in lc.upsert_replace(old, new).collect()} == {("1", None, 6), ("2", "bob", None), ("3", "jane", None)}
    assert {tuple(r) for r in lc.upsert_update(old, new).collect()} == {("1", "kevin", 6), ("2", "bob", None), ("3", "jane", 1)}
    assert lc.changed(old, old.limit(1)).count() == 0


def test_allocation(spark):
    used = spark.createDataFrame([(0,), (2,), (5,)], "doc_id long")
    new = spark.createDataFrame([(c,) for c in "dcbae"], "k string")
    got = {r.k: r.doc_id for r in lc.allocate(used, new, "k").collect()}
    assert got == {"a": 1, "b": 3, "c": 4, "d": 6, "e": 7}
    assert {r.doc_id for r in lc.allocate(used.where("false"), new, "k").collect()} == {0, 1, 2, 3, 4}


def test_numbering_of_more_rows_than_are_sampled(spark):
    """Bounds are sampled and partitions joined by size: rows counted and rows numbered must be of one run."""
    df = spark.range(0, 400_000, 1, 4).select(F.col("id").cast("string").alias("k"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 3).alias("pay"))
    got = materialise(lc.number(df, "k", "n"))
    assert got.agg(F.count("*"), F.count_distinct("n"), F.min("n"), F.max("n")).first()[:] == (400_000, 400_000, 0, 399_999)


def test_store(spark, tmp_path):
    store = lc.Store(spark, str(tmp_path / "s"))
    assert store.version() is None
    with pytest.raises(lc.DocumentError):
        store.read()
    first = store.write(spark.range(5), '{"a": 1}')
    second = store.write(store.read().where("id > 2"))
    assert store.version() == second and store.read().count() == 2 and store.read(first).count() == 5 and store.size() > 0
    store.copy_to(str(tmp_path / "t"), 1)
    assert lc.Store(spark, str(tmp_path / "t")).read().count() == 2
    store.clear()
    assert store.read().count() == 0
    assert lc.should_soft_delete(10, 3, 100.0) and not lc.should_soft_delete(2, 3, 1.0)


def test_typed_csv(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text('id:number,field:string,a:b\n1,"x, ""y""",u\n2.5,,\n')
    got = [tuple(r) for r in rd.typed_csv(spark, str(f)).orderBy("id").collect()]
    assert got == [(1.0, 'x, "y"', "u"), (2.5, None, None)]
    f.write_text("id:number,n:number\n1,1.0\n-7,3\n")
    whole = rd.typed_csv(spark, str(f))
    assert dict(whole.dtypes) == {"id": "bigint", "n": "double"} and sorted(tuple(r) for r in whole.collect()) == [(-7, 3.0), (1, 1.0)]
    f.write_text("id:number\n12d\n")
    with pytest.raises(rd.SourceError, match="12d.*a.csv"):
        rd.typed_csv(spark, str(f))
    assert rd.typed_header("a:b:number") == ("a:b", "number") and rd.typed_header("a:b") == ("a:b", "string")


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n{"a": {"b": [1, {"c": 2}], "d": {}}}\n')
    assert rd.json_array(spark, str(tmp_path / "a.json")).count() == 2
    v = rd.variant_lines(spark, str(tmp_path / "b.jsonl")).withColumn("doc_id", F.monotonically_increasing_id())
    got = {(r.field, r.value) for r in rd.flatten_variant(v).collect()}
    assert {("a", "1"), ("a.b", "1"), ("a.b.c", "2"), ("a.d", None)} <= got
    assert rd.json_objects(spark, [{"x": 1}]).count() == 1


def test_flatten(spark):
    df = spark.createDataFrame([(1, ("u", ("v",)), [("p",), ("q",)], "lit")], "id int, a struct<b:string,c:struct<d:string>>, l array<struct<e:string>>, `a.b` string")
    out = rd.flatten(df)
    assert set(out.columns) == {"id", "a.b", "a.c.d", "l.e"} and rd.needs_flattening(df.schema) and not rd.needs_flattening(out.schema)
    row = out.first()
    assert sorted(row["a.b"]) == ["lit", "u"] and row["l.e"] == ["p", "q"]


def matcher(query, **kw):
    return fm.Matcher(Planner(split_words=False, ngrams=False).build(primitive(query), "any"), **kw)


def test_formatting():
    m = matcher('"split the" world')
    text = "Natalie risk her future to build a world with the boy, split the worlds apart."
    assert m.format(text, fm.FormatOptions(highlight=True)) == "Natalie risk her future to build a <em>world</em> with the boy, <em>split the</em> <em>world</em>s apart."
    crop = m.format(text, fm.FormatOptions(highlight=True, crop=4))
    assert crop.startswith("…") and "<em>split the</em> <em>world</em>s" in crop
    assert m.format("", fm.FormatOptions(True, 5)) == "" and m.format("no", fm.FormatOptions(True, 5)) == "no"
    assert matcher("ete ").bounds("un Été, été") == [(3, 5), (10, 5)]
    assert fm.FormatOptions(True).merge(fm.FormatOptions(crop=3)) == fm.FormatOptions(True, 3)
    assert (fm.index_proximity(1, 3), fm.index_proximity(3, 1), fm.positions_proximity((0, 1), (1, 2)), fm.path_proximity([(0, 1), (0, 2), (0, 1)])) == (2, 3, 8, 3)
    assert fm.is_faceted("a.b", {"a"}) and not fm.is_faceted("ab", {"a"})


def test_streaming(spark, tmp_path):
    src, ix = str(tmp_path / "src"), StoredIndex(spark, str(tmp_path / "index"))
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema("id int, v string").parquet(src)
    ingest(stream(), ix, str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string").coalesce(1).write.mode("append").parquet(src)
    ingest(stream(), ix, str(tmp_path / "cp")).awaitTermination()
    assert {tuple(r) for r in ix.documents().select("id", "v").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert ix.meta["batch"] == 1
