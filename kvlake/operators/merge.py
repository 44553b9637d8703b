"""Merge-on-read: versions, the latest of a key, and what is visible at a time.

The latest version is taken first and judged then.  The other way round, an expired or
deleted newest version would let an older one come back.  A filter on the key passes
below the ranking by itself, as the key is its partition; filters on values stay above.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvlake.functions.keys import expires_at, is_expired


def versions(log: DataFrame, *more: str) -> DataFrame:
    """Change-log rows as versions; ``more`` columns stay."""
    deleted = F.col("op") == "D"
    return log.select(
        "key",
        F.when(~deleted, F.col("value")).alias("value"),
        F.when(deleted, F.lit(0)).otherwise(expires_at()).cast("bigint").alias("expires_at_ms"),
        deleted.alias("tombstone"),
        "seq",
        *more,
    )


def latest(rows: DataFrame, by: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The newest version of each key, by arrival; ``by=("ts_ms", "seq")`` takes the time of
    writing instead, where rows have it.  The ranking is limited before the exchange too
    (a hot key sends one row per task), so no key gathers its versions in one task."""
    newest = Window.partitionBy("key").orderBy(*(F.col(c).desc() for c in by))
    return rows.withColumn("__rank", F.row_number().over(newest)).where("__rank = 1").drop("__rank")


def live(rows: DataFrame, now_ms: int) -> DataFrame:
    """Of latest rows, those neither deleted nor expired."""
    return rows.where(~F.col("tombstone") & ~is_expired(now_ms))


def visible(rows: DataFrame, now_ms: int) -> DataFrame:
    return live(latest(rows), now_ms)


def as_tombstones(rows: DataFrame, now_ms: int, *more: str) -> DataFrame:
    """Expired rows as tombstones, so that they go on hiding older versions; ``more`` columns stay."""
    gone = F.col("tombstone") | is_expired(now_ms)
    return rows.select(
        "key",
        F.when(~gone, F.col("value")).alias("value"),
        F.when(gone, F.lit(0)).otherwise(F.col("expires_at_ms")).cast("bigint").alias("expires_at_ms"),
        gone.alias("tombstone"),
        "seq",
        *more,
    )


def merge(*runs: DataFrame) -> DataFrame:
    """The newest version of each key over several runs."""
    return latest(reduce(DataFrame.unionByName, runs))
