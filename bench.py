"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from pyspark.sql import functions as F

from pharos import catalogue
from pharos.functions import formatting
from pharos.operators import index
from pharos.runtime import materialise, table
from pharos.search import Index
from pharos.settings import Settings

REPEAT = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda df: df.write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}

    def clock(name: str, f, repeat: int = REPEAT) -> None:
        best = None
        for _ in range(repeat):
            t = time.time()
            f()
            best = min(best or 1e9, time.time() - t)
        times[name] = round(best, 3)

    docs = table(spark, sf_dir, "documents")
    settings = Settings(searchable=("text",), filterable=("lang", "source", "n_chars"), sortable=("n_chars",))
    plain = Index(docs, settings)
    tokens = materialise(index.stored(plain.tokens))
    stored = Index(docs, settings, tokens=tokens)
    ix = Index(docs, settings, tokens=tokens, vocabulary=materialise(stored.vocabulary), lengths=materialise(stored.lengths))
    # indexing: what a search needs, from raw documents
    clock("indexing_tokens", lambda: run(plain.tokens))
    clock("indexing_sorted_tokens", lambda: materialise(index.stored(plain.tokens)), 1)
    clock("indexing_vocabulary", lambda: run(stored.vocabulary))
    # searches over the persisted index
    for name, s in {
        "search_words": ix.search("worthless clown ").criteria("words"),
        "search_typo": ix.search("worthlass clwon ").criteria("words", "typo"),
        "search_proximity": ix.search("worthless clown idiot ").authorize_typos(False).criteria("words", "proximity"),
        "search_default": ix.search("worthless clown idio"),
        "search_prefix_one_letter": ix.search("w").criteria("words"),
        "search_quoted": ix.search('"of the in"').criteria("words"),
        "search_filtered": ix.search("worthless clown ").filter("lang = en AND n_chars 500 TO 5000"),
        "search_sorted": ix.search("worthless ").sort_criteria("n_chars:desc"),
        "placeholder_sorted": ix.search().sort_criteria("n_chars:asc"),
    }.items():
        clock(name, lambda s=s: run(s.expand(False, False).execute()))
    page = ix.search("worthless clown ").authorize_typos(False).expand(False, False)
    shown = lambda: run(page.execute().select("doc_id", formatting.Matcher(page.tree()).formatted(F.col("text"), formatting.FormatOptions(highlight=True, crop=20))))
    clock("search_highlighted_and_cropped", shown)
    for name in (
        "filter_between", "filter_and_or_not", "filter_large", "geo_radius", "geo_sort_asc", "geo_sort_desc", "sort_desc", "distinct_attribute", "facet_distribution",
        "facet_distribution_filtered", "facet_minmax", "upsert_replace", "upsert_update", "delete_documents", "index_documents", "highlight", "crop", "word_pair_proximity",
    ):
        clock(name, lambda name=name: run(catalogue.QUERIES[name](spark, sf_dir)), 1)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1], "documents": docs.count()}))


if __name__ == "__main__":
    main()
