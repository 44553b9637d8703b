"""Sharding by sampled splitters.

Records are ordered by a key: the hash of their text, then the hash of their id, so
that equal texts stand together and yet a text that fills a third of the corpus has
room for splitters.  A size-weighted sample of keys gives quantile boundaries, which
range-partition the records; a range that is overfull all the same (equal keys) is
subdivided by a hash of the row.  With the bytes before each range known, a running sum
inside a range gives every record its place in the whole order, and so a shard: shard
s holds what begins in the s-th of equal parts of all bytes.  Slots count on from a
shard's first record.

All of it is DataFrame operations on a narrow table (id, size, hashes), written once;
the texts are read once.  What the driver and the broadcasts hold is bounded by the
number of ranges, at most ``MAX_RANGES``.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_names

SHARDS = 16
#: Records that a range is to have, the least and the largest number of ranges, and sampled keys per range.
RANGE_ROWS = 250_000
MIN_RANGES = 64
MAX_RANGES = 1 << 16
PER_RANGE = 24
#: A range of more than so many times its share is subdivided.
OVERFULL = 3
_PREFIX_BITS = 10
_SCALE = 1 << 31


def order_key(text_hash: Column, id_hash: Column) -> Column:
    """63 bits: the upper 31 of the text's hash, then 32 of the id's."""
    return F.shiftleft(F.shiftrightunsigned(text_hash, 33), 32).bitwiseOR(F.shiftrightunsigned(id_hash, 32))


def splitters(keyed: DataFrame, ranges: int, total: int) -> list[int]:
    """Boundaries of ``ranges`` ranges of about equal bytes, from a size-weighted sample of keys.

    A record is drawn with a chance in proportion to its size (surely, where it is larger than
    a sampled share), so about ``PER_RANGE * ranges`` keys come to the driver.
    """
    share = max(total / (PER_RANGE * ranges), 1e-9)
    chance = F.least(F.lit(float(_SCALE)), F.col("size") / F.lit(share) * F.lit(float(_SCALE)))
    drawn = keyed.where(F.pmod(F.xxhash64(F.lit(23), "key", "row"), F.lit(_SCALE)) < chance)
    got = sorted((r["key"], max(r["size"], share)) for r in drawn.select("key", "size").toLocalIterator())
    weight, seen, out = sum(w for _, w in got), 0.0, []
    for key, w in got:
        seen += w
        if seen >= weight * (len(out) + 1) / ranges and len(out) < ranges - 1 and (not out or key > out[-1]):
            out.append(key)
    return out


def range_of(keyed: DataFrame, bounds: list[int]) -> DataFrame:
    """``keyed`` with ``range``: how many boundaries are at or below the key.  Boundaries are looked up
    by the key's leading bits in a broadcast table of 2^10 rows, then by bisection."""
    rows, at = [], 0
    for p in range(1 << _PREFIX_BITS):
        first = at
        while at < len(bounds) and bounds[at] >> (63 - _PREFIX_BITS) == p:
            at += 1
        rows.append({"p": p, "base": first, "b": bounds[first:at]})
    spark = keyed.sparkSession
    table = spark.range(1).select(
        F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<p:bigint,base:int,b:array<bigint>>>")).alias("t")
    ).select("t.*")
    found = F.expr("""
        base + aggregate(sequence(1, 17), named_struct('lo', 0, 'hi', size(b)), (s, x) ->
            if(s.lo >= s.hi, s, if(b[cast((s.lo + s.hi) div 2 as int)] <= key,
                named_struct('lo', cast((s.lo + s.hi) div 2 as int) + 1, 'hi', s.hi),
                named_struct('lo', s.lo, 'hi', cast((s.lo + s.hi) div 2 as int)))), s -> s.lo)
    """)
    leading = F.shiftrightunsigned("key", 63 - _PREFIX_BITS)
    return keyed.withColumn("p", leading).join(F.broadcast(table), "p").withColumn("range", found).drop("p", "base", "b")


def shard(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS, max_ranges: int = MAX_RANGES
) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row.

    A null text counts as empty (size 1); null ids, repeated rows and equal ids are rows like
    any other; other columns are ignored; an empty table has an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = cut(docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("crc"),
        order_key(F.xxhash64(text), F.xxhash64(F.col(id_col))).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    ))
    n, total = narrow.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = min(max(-(-n // range_rows), MIN_RANGES), max_ranges)
    ranged = range_of(narrow, splitters(narrow, ranges, total))

    # Overfull ranges are subdivided; the parts are again bounded in number.
    limit = max(1, OVERFULL * n // ranges, OVERFULL * 1000)
    sizes = ranged.groupBy("range").agg(F.count("*").alias("rows"))
    parts = sizes.where(F.col("rows") > limit).select("range", F.ceil(F.col("rows") / F.lit(max(1, limit // 2))).cast("int").alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64(F.lit(29), "row"), F.col("parts")).cast("int"), F.lit(0))
    placed = ranged.join(F.broadcast(parts), "range", "left").withColumn("part", part).drop("parts")
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("range", "part").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
        .select("range", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"))
    )
    inside = Window.partitionBy("range", "part").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.col("bytes_before") + F.sum("size").over(inside) - F.col("size")
    ordered = cut(
        placed.join(F.broadcast(offsets), ["range", "part"])
        .select(
            "id", "size", "crc",
            F.expr(f"cast({shards} as decimal(38,0))").alias("shards"),
            at.alias("at"),
            (F.col("rows_before") + F.count("*").over(inside) - 1).alias("place"),
        )
        .select("id", "size", "crc", "place", F.least(F.lit(shards - 1), F.floor(F.col("at") * F.col("shards") / F.lit(max(total, 1))).cast("int")).alias("shard"))
    )
    first = ordered.groupBy("shard").agg(F.min("place").alias("first"))
    return ordered.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("place") - F.col("first")).alias("slot")
    )


def write(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the documents themselves by shard (a folder each, in slot order within a file).

    Rows are numbered and the table is cut first, so ids may repeat or be null.  Columns of ``docs``
    named ``shard`` or ``slot`` are replaced.
    """
    docs = docs.drop("shard", "slot")
    row, own = free_names(docs, "__row", "__own")
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    plan = shard(numbered, shards, row, text_col).select(F.col(row).alias(own), "shard", "slot")
    out = numbered.join(plan, F.col(row) == F.col(own)).drop(row, own)
    out.repartition("shard", F.floor(F.col("slot") / F.lit(RANGE_ROWS))).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
