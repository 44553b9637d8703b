"""Point, batched, range and count reads over versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlake.functions.keys import Key, encode, has_prefix, in_range, is_expired, is_valid

from .merge import latest, live, visible

#: Requests up to this many bytes are broadcast by size; larger ones are joined by key.
BROADCAST_KEYS_BYTES = 8 << 20


def point_get(rows: DataFrame, key: Key, now_ms: int) -> DataFrame:
    return visible(rows.where(F.col("key") == F.lit(bytearray(encode(key)))), now_ms)


def scan(rows: DataFrame, now_ms: int, start: Key | None = None, end: Key | None = None, ordered: bool = False) -> DataFrame:
    """Visible rows with start <= key < end; ``ordered`` by key."""
    out = visible(rows.where(in_range(start, end)), now_ms)
    return out.orderBy("key") if ordered else out


def entries(rows: DataFrame, start: Key | None = None, end: Key | None = None) -> DataFrame:
    """The newest version of each key with start <= key < end, whatever it says, in key order."""
    return latest(rows.where(in_range(start, end))).orderBy("key")


def prefix_scan(rows: DataFrame, prefix: Key, now_ms: int) -> DataFrame:
    return visible(rows.where(has_prefix(prefix)), now_ms)


def first_k(rows: DataFrame, k: int, now_ms: int, start: Key | None = None) -> DataFrame:
    """The first k visible rows in key order."""
    return scan(rows, now_ms, start).orderBy("key").limit(k)


def list_keys(rows: DataFrame, now_ms: int) -> DataFrame:
    """Visible keys; values are not read."""
    return live(latest(rows.select("key", "expires_at_ms", "tombstone", "seq")), now_ms).select("key")


def size(rows: DataFrame, now_ms: int) -> DataFrame:
    return list_keys(rows, now_ms).agg(F.count("*").alias("size"))


def multi_get(rows: DataFrame, keys: DataFrame, now_ms: int, small: bool = False) -> DataFrame:
    """One row per request (``key`` and any other columns), with status and value.

    The log is reduced to the wanted keys before it is ranked.  ``small`` says that the
    requests are known to fit ``BROADCAST_KEYS_BYTES``; Spark decides otherwise.
    """
    wanted = keys.select("key").where(valid_key()).distinct()
    found = visible(rows.join(F.broadcast(wanted) if small else wanted, "key", "left_semi"), now_ms)
    found = found.select(F.col("key").alias("__key"), "value", "expires_at_ms", "seq")
    status = F.when(~valid_key(), "INVALID_INPUT").when(F.col("__key").isNull(), "KEY_NOT_FOUND").otherwise("SUCCESS")
    return keys.join(found, F.col("key") == F.col("__key"), "left").withColumn("status", status).drop("__key")


def contains(rows: DataFrame, keys: DataFrame, now_ms: int, small: bool = False) -> DataFrame:
    """The requests and whether each key is visible."""
    return multi_get(rows, keys, now_ms, small).select(*keys.columns, (F.col("status") == "SUCCESS").alias("present"))


def valid_key() -> Column:
    return F.col("key").isNotNull() & (F.octet_length("key") > 0)


def deletable(rows: DataFrame, keys: DataFrame, now_ms: int) -> DataFrame:
    """Of the keys, those a delete would write a tombstone for: the readable ones."""
    wanted = keys.select("key").where(valid_key()).distinct()
    return wanted.join(list_keys(rows, now_ms), "key", "left_semi")


def expired(rows: DataFrame, now_ms: int) -> DataFrame:
    """Keys whose newest version is a put that has expired."""
    newest = latest(rows.select("key", "expires_at_ms", "tombstone", "seq"))
    return newest.where(~F.col("tombstone") & is_expired(now_ms)).select("key")


def validate(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) operations."""
    ok = F.coalesce(is_valid(), F.lit(False))
    return log.where(ok), log.where(~ok)
