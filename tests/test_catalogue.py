"""Every registered query with an oracle, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from pharos import catalogue
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def canon(records):
    out = []
    for r in records:
        out.append(tuple(round(v, 6) if isinstance(v, float) else v for v in r))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    found = canon(tuple(r) for r in got.select(*[f"`{c}`" for c in cols]).collect())
    if name not in catalogue.SQL:
        return
    rel = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({catalogue.SQL[name]})")
    assert found == canon(rel.fetchall())


def test_flagship(spark):
    df = catalogue.flagship(spark, SF)
    assert 0 < df.count() <= 20
    assert {"doc_id", "words", "typo", "proximity", "attribute", "exactness"} <= set(df.columns)


def test_strings_then_missing_without_a_limit(spark, duck):
    """The page of sort_strings_then_missing ends before the missing values of larger tables; the order goes on to them."""
    from pyspark.sql import functions as F

    from pharos.search import Index
    from pharos.settings import Settings

    path = "/root/testdata/sf0.1/part.parquet"
    p = spark.read.parquet(path).withColumn("p_type", F.when(F.col("p_size") % 3 != 0, F.col("p_type")))
    ix = Index(p, Settings(searchable=("p_name",), sortable=("p_type",)), key="p_partkey")
    got = [r.p_partkey for r in ix.search().sort_criteria("p_type:desc").limit(2_000_000_000).execute().select("p_partkey").collect()]
    sql = catalogue.SQL["sort_strings_then_missing"].replace(" LIMIT 1500", "").replace("FROM part ", f"FROM read_parquet('{path}') ")
    assert got == [r[0] for r in duck.execute(sql).fetchall()] and len(got) == 20_000
