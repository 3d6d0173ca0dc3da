"""Streaming ingestion: each micro-batch of documents is added to a stored index as a new version.

A batch writes files of its own documents only. A micro-batch that Spark repeats after a failure is
recognised by its number, which travels in the version's manifest, and is not applied twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pharos.indexing import IndexDocumentsConfig, StoredIndex


def ingest(stream: DataFrame, index: StoredIndex, checkpoint: str, config: IndexDocumentsConfig | None = None, seq: str | None = None) -> StreamingQuery:
    """Run until the source is used up. ``seq`` orders rows of one id within a batch; without it the order
    in which Spark reads them does, which isn't the order of arrival across files."""

    def apply(batch: DataFrame, number: int) -> None:
        if index.meta.get("batch", -1) < number:
            index.add_documents(batch, config, seq, batch=number)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
