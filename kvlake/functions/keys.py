"""Key encoding, ranges and row visibility as column expressions.

Keys are binary and ordered by unsigned bytes, a prefix before what it begins; Spark
orders ``BinaryType`` so, and pushes these comparisons down to Parquet.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Key = bytes | str


def encode(key: Key) -> bytes:
    return key.encode("utf-8") if isinstance(key, str) else bytes(key)


def key_column(text: Column | str) -> Column:
    """UTF-8 bytes of a string column."""
    return F.to_binary(F.col(text) if isinstance(text, str) else text, F.lit("utf-8"))


def shown(key: Column | str = "key") -> Column:
    """Binary as text, for the edge of a query."""
    return F.decode(F.col(key) if isinstance(key, str) else key, "utf-8")


def in_range(start: Key | None = None, end: Key | None = None, key: str = "key") -> Column:
    """start <= key < end; a bound that is None is open, and leaves nothing in the plan."""
    met = F.lit(True)
    if start is not None:
        met = met & (F.col(key) >= F.lit(bytearray(encode(start))))
    if end is not None:
        met = met & (F.col(key) < F.lit(bytearray(encode(end))))
    return met


def prefix_end(prefix: Key) -> bytes | None:
    """The least key above all that begin with ``prefix``; None if there is none."""
    p = encode(prefix).rstrip(b"\xff")
    return p[:-1] + bytes([p[-1] + 1]) if p else None


def has_prefix(prefix: Key, key: str = "key") -> Column:
    return in_range(encode(prefix), prefix_end(prefix), key)


def expires_at(ttl_seconds: str = "ttl_seconds", ts_ms: str = "ts_ms") -> Column:
    """Milliseconds at which a put expires; 0 (never) for a ttl of 0 or less."""
    return F.when(F.col(ttl_seconds) > 0, F.col(ts_ms) + F.col(ttl_seconds) * 1000).otherwise(F.lit(0)).cast("bigint")


def is_expired(now_ms: int) -> Column:
    """Strictly past: at the very millisecond a row is still live."""
    return (F.col("expires_at_ms") > 0) & (F.lit(now_ms) > F.col("expires_at_ms"))


def is_valid(op: str = "op") -> Column:
    """A key is neither null nor empty; a put has a value (an empty one is a value)."""
    key = F.col("key").isNotNull() & (F.octet_length("key") > 0)
    return key & ((F.col(op) != "P") | F.col("value").isNotNull())


# Bytes of an entry beside key and value, of a log record of a put beside both, of a delete beside the key.
ENTRY_HEADER = 16
PUT_HEADER = 25
DELETE_HEADER = 13


def entry_bytes() -> Column:
    """Key, a header, value."""
    return (F.octet_length("key") + ENTRY_HEADER + F.coalesce(F.octet_length("value"), F.lit(0))).cast("bigint")


def record_bytes() -> Column:
    """A record of the log."""
    put = PUT_HEADER + F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return F.when(F.col("op") == "P", put).otherwise(DELETE_HEADER + F.octet_length("key")).cast("bigint")
