"""The change log over ``events``, and one over ``orders``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.functions.keys import key_column
from kvlake.operators.merge import versions

#: As of when the registered queries read: the last event at scale 0.01.
NOW_MS = 1706659032194
SEGMENT_ROWS = 1000


def _millis(ts: str) -> str:
    """Milliseconds of a wall-clock timestamp read as UTC, whatever the session's zone."""
    return f"unix_millis(from_utc_timestamp(cast({ts} as timestamp), current_timezone()))"


def _padded(number: str, width: int) -> Column:
    """At least ``width`` digits; a longer number stays whole, so two never share a key."""
    text = F.col(number).cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors delete, everything else puts; views live for a day."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    deleted = F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("seq"),
        F.when(deleted, "D").otherwise("P").alias("op"),
        key_column(F.concat(F.lit("user-"), _padded("user_id", 5), F.lit("-"), (F.col("event_id") % 7).cast("string"))).alias("key"),
        F.when(~deleted, F.to_binary("props", F.lit("utf-8"))).alias("value"),
        F.when(F.col("event_type") == "view", 86400).otherwise(0).cast("bigint").alias("ttl_seconds"),
        F.expr(_millis("ts")).alias("ts_ms"),
    )


def with_segment(rows: DataFrame, n: int = SEGMENT_ROWS) -> DataFrame:
    return rows.withColumn("segment_id", F.floor(F.col("seq") / n))


def events_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(events_log(spark, sf_dir))


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A put per order, keyed by customer: the order key is the sequence."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(
        F.col("o_orderkey").alias("seq"), F.lit("P").alias("op"),
        key_column(F.concat(F.lit("customer-"), _padded("o_custkey", 9))).alias("key"),
        key_column("o_orderstatus").alias("value"), F.lit(0).cast("bigint").alias("ttl_seconds"), F.expr(_millis("o_orderdate")).alias("ts_ms"),
    )


LOG_SQL = f"""
WITH log AS (
  SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'D' ELSE 'P' END AS op,
    'user-' || lpad(CAST(user_id AS VARCHAR), greatest(5, CAST(length(CAST(user_id AS VARCHAR)) AS INTEGER)), '0') || '-' || CAST(event_id % 7 AS VARCHAR) AS key,
    CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value,
    CASE WHEN event_type = 'view' THEN 86400 ELSE 0 END AS ttl, epoch_ns(ts) // 1000000 AS ts_ms, event_id // {SEGMENT_ROWS} AS segment_id
  FROM events
), v AS (SELECT *, CASE WHEN op = 'P' AND ttl > 0 THEN ts_ms + ttl * 1000 ELSE 0 END AS expires_at_ms FROM log
), l AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1
), s AS (SELECT *, op = 'D' OR (expires_at_ms > 0 AND {NOW_MS} > expires_at_ms) AS gone FROM l
), vis AS (SELECT * FROM s WHERE NOT gone)
"""
