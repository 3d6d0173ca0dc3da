"""The corpus pipeline: documents in, token ids of clean documents out.

Language ID drops what is written in no known language; of each group of near duplicates one document
stays; documents that share a span with the benchmark go; personal data is replaced by its kind; what
is left is encoded. Each stage sees all that the one before kept, written to Parquet in between. All
stages but the last return the columns of documents; the last gives doc_id, n_tokens, tokens and
round_trip, one row a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pharos.llm import bpe, decontaminate, jaccard_join, langid, pii
from pharos.runtime import materialise, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs)


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("PII", without_personal_data),
    ("byte-level BPE", encoded),
]

#: Neither the language model nor the tagger can be expressed in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
