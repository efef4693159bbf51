"""Micro-batches as group commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..store import Store


def ingest(store: Store, ops: DataFrame, *, name: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start a stream of op_index, key, kind, value into the store.

    Each micro-batch is one atomic commit that also records its id under ``name``: a batch that is
    delivered again after a failure finds its id committed and changes nothing.
    """
    writer = ops.writeStream.queryName(name).option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda batch, batch_id: store.write_frame(batch, stream=(name, batch_id)) and None)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
