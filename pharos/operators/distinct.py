"""Distinct attribute: the best-ranked document of each value stays; documents without one all stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_hits(hits: DataFrame, orders: list[Column], value: Column, array: bool, start: int, size: int, key: str) -> DataFrame:
    """A page of ``hits`` in order. Single values are ranked within their group; of array values, a kept
    document excludes all that share any of its values, which is decided one after the other."""
    if not array:
        alone = F.when(value.isNull(), F.col(key))  # documents without a value are groups of their own, not one group
        best = F.row_number().over(Window.partitionBy(value, alone).orderBy(*orders))
        out = hits.withColumn("_best", best).where(value.isNull() | (F.col("_best") == 1)).drop("_best").orderBy(*orders)
        return (out.offset(start) if start else out).limit(size)
    # greedy: stream the ranking to the driver, narrow rows only, until the page is full
    spark = hits.sparkSession
    kept, taken = [], set()
    for row in hits.orderBy(*orders).select(key, value.alias("v")).toLocalIterator():
        values = {x for x in row["v"] or [] if x is not None}
        if values & taken:
            continue
        taken |= values
        kept.append(row[key])
        if len(kept) >= start + size:
            break
    page = kept[start:]
    places = spark.createDataFrame(list(enumerate(page)), f"_place int, {key} {hits.schema[key].dataType.simpleString()}")
    return hits.join(F.broadcast(places), key).orderBy("_place").drop("_place")  # a page: bounded by the request
