import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pharos.plans import filters as fl


@pytest.mark.parametrize(
    ("text", "printed"),
    [
        ("channel = Ponce", "{channel} = {Ponce}"),
        ("NOT subscribers = 1", "NOT ({subscribers} = {1})"),
        ("NOT NOT a = 1", "{a} = {1}"),
        ("a 10 TO 20", "{a} {10} TO {20}"),
        ("a EXISTS", "{a} EXISTS"),
        ("a NOT EXISTS", "NOT ({a} EXISTS)"),
        ("colour IN [green, 'light blue',]", "{colour} IN[{green}, {light blue}]"),
        ("colour NOT IN []", "NOT ({colour} IN[])"),
        ("a = 1 OR b = 2 AND c = 3", "OR[{a} = {1}, AND[{b} = {2}, {c} = {3}]]"),
        ("(a = 1 OR b = 2) AND c = 3", "AND[OR[{a} = {1}, {b} = {2}], {c} = {3}]"),
        ("'a b' = \"c \\\" d\"", '{a b} = {c " d}'),
        ("_geoRadius(12, 13.5, 14)", "_geoRadius(12, 13.5, 14)"),
        ("a.b != x-y", "{a.b} != {x-y}"),
    ],
)
def test_grammar(text, printed):
    assert str(fl.parse(text)) == printed


@pytest.mark.parametrize("text", ["a =", "a", "= 1", "a = 'x", "(a = 1", "a = 1)", "a IN [b", "a IN b", "_geoRadius(1, 2)", "_geoRadius(91, 0, 1)", "_geoPoint(1, 2) = 3", "a = OR", "a = 1 b = 2", "_geoRadius = 1", "a # 1"])
def test_errors(text):
    with pytest.raises(fl.FilterError):
        fl.parse(text)


def test_depth():
    with pytest.raises(fl.FilterError):
        fl.parse("(" * 300 + "a = 1" + ")" * 300)


def test_array():
    assert str(fl.parse_array([["a = 1", "b = 2"], "c = 3", " "])) == "AND[OR[{a} = {1}, {b} = {2}], {c} = {3}]"
    assert fl.parse_array([]) is None


def frame(spark):
    return spark.createDataFrame(
        [(1, "Red ", [1.0, 5.0], None), (2, "blue", [], (1.0, 2.0)), (3, None, None, (50.0, 3.0)), (4, "7", [7.0], None)],
        "id int, tag string, n array<double>, _geo struct<lat:double,lng:double>",
    )


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        ("tag = RED", [1]), ("tag != red", [2, 3, 4]), ("NOT tag = red", [2, 3, 4]), ("n > 4", [1, 4]), ("n <= 1", [1]), ("n 6 TO 8", [4]), ("n 8 TO 6", []),
        ("tag = 7", [4]), ("n = 5", [1]), ("n = five", []), ("tag IN [red, BLUE]", [1, 2]), ("tag IN []", []), ("tag NOT IN []", [1, 2, 3, 4]), ("unknown = 1", []),
        ("unknown != 1", [1, 2, 3, 4]), ("unknown NOT EXISTS", [1, 2, 3, 4]), ("n EXISTS", [1, 2, 4]), ("_geoRadius(1, 2, 10)", [2]), ("NOT _geoRadius(1, 2, 10)", [1, 3, 4]), ("tag > 3", []),
    ],
)
def test_evaluation(spark, text, ids):
    df = frame(spark)
    for strict in (True, False):
        assert [r.id for r in df.where(fl.compile(fl.parse(text), df, strict=strict)).orderBy("id").collect()] == ids


def test_never_null(spark):
    df = frame(spark)
    for t in ("tag = x", "n > 1", "_geoRadius(0, 0, 1)", "tag EXISTS"):
        assert df.where(fl.compile(fl.parse(t), df).isNull()).count() == 0


def test_guards(spark):
    df = frame(spark)
    with pytest.raises(fl.FilterError, match="filterable"):
        fl.compile(fl.parse("tag = 1"), df, {"n"})
    with pytest.raises(fl.FilterError, match="number"):
        fl.compile(fl.parse("n > 12d"), df)
    with pytest.raises(fl.FilterError):
        fl.compile(fl.parse("n < NaN"), df)


def test_pushdown(spark, tmp_path):
    spark.range(10).select(F.col("id"), (F.col("id") * 2).cast("double").alias("v")).write.parquet(str(tmp_path / "x"))
    df = spark.read.parquet(str(tmp_path / "x"))
    plan = df.where(fl.compile(fl.parse("v >= 4 AND id = 3"), df, strict=False))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(v" in plan


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab =!<>()[],'\"\\ANDORTINEXS_0.1-", max_size=40))
def test_parser_raises_only_its_error(text):
    try:
        fl.parse(text)
    except fl.FilterError:
        pass
