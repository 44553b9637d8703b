"""Segments: immutable Parquet folders of versions, sorted by key.

A segment is range-partitioned by key, so its files, row groups and pages have narrow
key ranges, and carries a Parquet Bloom filter on the key; the manifest has its bounds.
A segment of at most ``BLOOM_KEYS`` keys has a Bloom filter of its own beside its files,
which the driver probes, so that a lookup opens no segment that can't hold its key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.operators.bloom import Filter
from kvlake.schema import VERSION

from .filesystem import Files
from .manifest import Segment

#: A filter of so many keys takes 1.2 MB; beyond it Parquet's filters serve alone, a row group at a time.
BLOOM_KEYS = 1_000_000


def write(
    rows: DataFrame, root: str, segment_id: int, level: int, created_ms: int, expected_rows: int, rows_per_file: int, bloom_error: float = 0.01
) -> Segment | None:
    """Writes the rows as a segment; None, and nothing left, if there are none."""
    spark = rows.sparkSession
    path = f"{root.rstrip('/')}/segments/s{segment_id:012d}-{uuid.uuid4().hex[:8]}"
    files = max(1, -(-expected_rows // rows_per_file))
    placed = rows.repartitionByRange(files, "key") if files > 1 else rows.coalesce(1)
    (
        placed.sortWithinPartitions("key").write
        .option("parquet.bloom.filter.enabled#key", "true")
        .option("parquet.bloom.filter.expected.ndv#key", str(min(expected_rows, rows_per_file) or 1))
        .parquet(path)
    )
    stats = (
        read(spark, [path])
        .agg(
            F.count("*").alias("n"), F.sum(F.col("tombstone").cast("bigint")).alias("t"), F.min("key").alias("lo"), F.max("key").alias("hi"),
            F.min("seq").alias("first"), F.max("seq").alias("last"),
        )
        .first()
    )
    store = Files(spark, root)
    if not stats["n"]:
        store.delete(path)
        return None
    size, bloom = store.size(path), None
    if stats["n"] <= BLOOM_KEYS:
        bloom = f"{path}/_bloom.json"
        store.create(bloom, Filter.of(read(spark, [path]).select("key"), stats["n"], bloom_error).to_json())
    return Segment(
        segment_id, level, path, created_ms, stats["n"], stats["t"], size, bytes(stats["lo"]).hex(), bytes(stats["hi"]).hex(), stats["first"], stats["last"], bloom
    )


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema(VERSION).parquet(*paths) if paths else spark.createDataFrame([], VERSION)
