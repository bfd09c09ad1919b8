"""Streaming ingestion into a store."""

from __future__ import annotations

import json

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..store import Store


def stream_id(checkpoint: str) -> str:
    """The id that Spark gave the stream of a checkpoint; a new checkpoint has a new one."""
    fs, path = pafs.FileSystem.from_uri(checkpoint)
    with fs.open_input_stream(f"{path}/metadata") as source:
        return json.loads(source.read())["id"]


def ingest(ops: DataFrame, store: Store, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Write a stream of (seq, key, value) to a store, a commit for each micro-batch; a batch repeated after a failure
    is skipped, and streams with checkpoints of their own don't hide each other's batches.

    interval: processing time between batches; None takes in what there is and ends. Flushing and compaction
    follow the store's options after each batch. seq must be larger than that of all earlier batches' rows of a key.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        store.write_batch(batch, batch_id, stream_id(checkpoint))

    writer = ops.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
