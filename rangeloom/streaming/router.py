"""A stream of rows into a partitioned table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..manager import PartitionManager


def route_stream(stream: DataFrame, manager: PartitionManager, schema: str, table: str, checkpoint: str, keep_free: int | None = None, as_of: date | None = None, **trigger) -> StreamingQuery:
    """Appends each micro-batch through the router; `keep_free` adds partitions ahead of it first.

    A batch's number is published with its rows, under the checkpoint's name: a batch that comes again after
    a failure is not inserted again.
    """

    def batch(rows: DataFrame, number: int) -> None:
        if keep_free:
            manager.partition_add_up_to_nr_of_free_partitions(schema, table, keep_free, as_of)
        manager.insert(schema, table, rows, batch=(f"{checkpoint}:{schema}.{table}", number))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
