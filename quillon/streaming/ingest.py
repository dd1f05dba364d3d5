"""Continuous ingestion: a stream of rows becomes delta shards of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame


def ingest(stream: DataFrame, uri: str, checkpoint: str, available_now: bool = True):
    """Start a query that appends each micro-batch to the index as one delta.

    The newest generation is opened for every batch, so other writers may publish between batches. A batch that is run again
    after a failure replaces its rows: they are deleted and inserted, which is idempotent by id.
    """
    from quillon.operators.index import VectorIndex

    def put(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        VectorIndex.open(batch.sparkSession, uri).update(batch)

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
