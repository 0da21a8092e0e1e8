"""Continuous ingest: micro-batches of data points put into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from chronolake.operators.ingest import Store
from chronolake.schema import Table


def save_data_points(stream: DataFrame, store: Store, table: Table, checkpoint: str, user: str | None = None, once: bool = False) -> StreamingQuery:
    """Put a stream's rows batch by batch; late rows replace their key in their own time partition.

    A batch that is run again after a failure puts the same keys again, which changes nothing. ``once``: process what
    is there and stop, resuming from the checkpoint next time.
    """

    def put(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.put(table, batch, user)

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
