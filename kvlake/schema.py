"""The three row shapes of a store."""

from __future__ import annotations

from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

PUT, DELETE = "P", "D"

#: What is asked for: one row per operation, in the order of ``seq``.
CHANGE_LOG = StructType([
    StructField("seq", LongType(), False),
    StructField("op", StringType(), False),
    StructField("key", BinaryType(), False),
    StructField("value", BinaryType(), True),
    StructField("ttl_seconds", LongType(), False),
    StructField("ts_ms", LongType(), False),
])

#: A version of a key.  ``expires_at_ms`` 0 is never; a tombstone has no value.
VERSION = StructType([
    StructField("key", BinaryType(), False),
    StructField("value", BinaryType(), True),
    StructField("expires_at_ms", LongType(), False),
    StructField("tombstone", BooleanType(), False),
    StructField("seq", LongType(), False),
])
