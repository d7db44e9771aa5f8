"""Rows that arrive as a stream: their keys become pending, and are sealed in bounded batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from trawl.sources.index import TextIndex


def ingest(index: TextIndex, stream: DataFrame, checkpoint: str, seal: bool = False, available_now: bool = True) -> StreamingQuery:
    """Appends the stream's keys to the index's pending rows, batch by batch; with ``seal``, each batch is sealed too.

    A batch that is tried again only repeats keys, which sealing removes.
    """

    def take(batch: DataFrame, _: int) -> None:
        index.append(batch.select(index.key_col))
        if seal:
            index.seal(wait=600)

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
