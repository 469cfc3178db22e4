"""Structured Streaming into stored collections: every micro-batch is one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from keyloom.sources.store import StoredCollection


def upsert_stream(rows: DataFrame, into: StoredCollection, checkpoint: str, sequence: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Overwrite ``into`` by each batch's rows; ``sequence`` tells the last row of a key within a batch.

    A batch that is delivered again after a failure writes the same rows again,
    so the collection ends up the same.
    """

    def commit(batch: DataFrame, _: int) -> None:
        into.upsert_overwrite(batch, sequence)

    out = rows.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()
