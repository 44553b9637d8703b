"""Change-log streams into a store, and a running state of a stream itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kvlake.functions.keys import expires_at
from kvlake.store import KVStore


def into_store(
    ops: DataFrame, store: KVStore, checkpoint: str, name: str = "ops", every: str | None = None, flush_every: int = 4, order_by: list | None = None
) -> StreamingQuery:
    """Logs each micro-batch once, and maintains the store every ``flush_every`` batches.
    ``every`` is a trigger interval; None takes all that is there and stops."""

    def batch(rows: DataFrame, number: int) -> None:
        store.append(rows, order_by, (name, number))
        if (number + 1) % flush_every == 0:
            store.maintain()

    writer = ops.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def latest_state(ops: DataFrame) -> DataFrame:
    """The newest version of each key of a stream of log rows, kept in Spark's state store (update or complete mode)."""
    deleted = F.col("op") == "D"
    version = F.struct(
        "seq", F.when(~deleted, F.col("value")).alias("value"), F.when(deleted, F.lit(0)).otherwise(expires_at()).cast("bigint").alias("expires_at_ms"), deleted.alias("tombstone")
    )
    return ops.groupBy("key").agg(F.max_by(version, F.col("seq")).alias("v")).select("key", "v.value", "v.expires_at_ms", "v.tombstone", "v.seq")
