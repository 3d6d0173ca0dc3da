"""Frames of documents as the operators on several documents read them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pharos.runtime import materialise


def by_id(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(doc_id, texts) with each doc_id once and its distinct texts in order, and whether any has several.

    Rows without id or text are left out. Ids are counted without their texts; only texts of ids that occur
    more than once are shuffled.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
    several = materialise(texts.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    one = texts.select("doc_id", F.array("text").alias("texts"))
    if not several.limit(1).count():
        return one, False
    merged = texts.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_set("text")).alias("texts"))
    return one.join(several, "doc_id", "left_anti").unionByName(merged), True
