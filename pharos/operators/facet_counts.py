"""Facet distribution: documents by value of each facet field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pharos.operators.index import facets


class FacetError(ValueError):
    pass


def number_text(x: Column) -> Column:
    """A double as people write it: no fraction on whole numbers, no exponent."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(whole, F.floor(x).cast("bigint").cast("string")).otherwise(x.cast("string"))


def distribution(df: DataFrame, names: list[str], key: str = "doc_id", max_values: int = 100, facetable: set[str] | None = None) -> DataFrame:
    """(field, value, count), for each field its first ``max_values`` values: numbers in order, then
    strings. Counts are exact; a string is shown as the document of least id spells it."""
    if facetable is not None and (bad := [n for n in names if n not in facetable]):
        raise FacetError(f"not facets: {', '.join(bad)}; facets are: {', '.join(sorted(facetable)) or 'none'}")
    f = facets(df, names, key)
    counted = f.groupBy("field", "num", "norm").agg(F.count_distinct("doc_id").alias("count"), F.min_by("orig", "doc_id").alias("orig"))
    place = F.row_number().over(Window.partitionBy("field").orderBy(F.col("num").asc_nulls_last(), F.col("norm").asc_nulls_first()))
    return counted.withColumn("r", place).where(F.col("r") <= max_values).select("field", F.coalesce(number_text(F.col("num")), F.col("orig")).alias("value"), "count")


def min_max(df: DataFrame, names: list[str], key: str = "doc_id") -> DataFrame:
    """(field, least, greatest) of the numeric values."""
    return facets(df, names, key).where("num is not null").groupBy("field").agg(F.min("num").alias("least"), F.max("num").alias("greatest"))
