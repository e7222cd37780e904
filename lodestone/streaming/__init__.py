"""Ingest as a stream of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestone.plans.ingest import ingest_batch
from lodestone.sources.store import Store


def ingest_stream(store: Store, documents: DataFrame, checkpoint: str, **options) -> StreamingQuery:
    """Add every micro-batch of a streaming (collection_id, id, text, metadata, pos) frame.

    Documents are keyed by id, so a micro-batch that is replayed after a
    failure writes the same documents again.
    """

    def add(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            ingest_batch(store, batch, **options)

    return (
        documents.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
