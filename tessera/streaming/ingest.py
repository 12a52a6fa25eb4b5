"""Load a stream into a table, batch by batch.

Each micro-batch is one load in a transaction of its own, so readers see whole
batches.  A batch that is run again after a failure is recognised by its number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import Database


def load_stream(database: Database, table: str, stream: DataFrame, order: Sequence[str], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start loading; with ``available_now`` the query ends when it has caught up."""
    marker = f"{checkpoint.rstrip('/')}/loaded-{table}"

    def add(batch: DataFrame, number: int) -> None:
        done = int(database._files.read(marker)) if database._files.exists(marker) else -1
        if number <= done:
            return
        with database.begin_transaction() as transaction:
            transaction.load(table, batch, order)
        database._files.replace(marker, str(number))

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
