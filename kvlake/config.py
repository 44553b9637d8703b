"""Validated, immutable configuration."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass
from enum import Enum


class CompactionStrategy(Enum):
    THRESHOLD = "THRESHOLD"
    SIZE_TIERED = "SIZE_TIERED"


@dataclass(frozen=True)
class StoreConfig:
    """Limits and intervals of a store; every number is positive."""

    mem_table_max_size_bytes: int = 10 * 1024 * 1024
    data_directory: str = "./data"
    compaction_threshold: int = 4
    compaction_interval_minutes: int = 30
    cleanup_interval_minutes: int = 1
    flush_interval_seconds: int = 10
    compaction_strategy: CompactionStrategy = CompactionStrategy.THRESHOLD
    #: Size-tiered planning.
    min_threshold: int = 4
    max_threshold: int = 32
    bucket_low: float = 0.5
    bucket_high: float = 1.5
    #: Rows of one segment file; sizes the range partitions of a flush or compaction.
    rows_per_file: int = 2_000_000
    #: False-positive rate of a segment's Bloom filter.
    bloom_error: float = 0.01

    def __post_init__(self):
        for field in dataclasses.fields(self):
            value = getattr(self, field.name)
            if isinstance(value, (int, float)) and not value > 0:
                raise ValueError(f"{field.name} must be positive")
        if not self.bloom_error < 1:
            raise ValueError("bloom_error must be below 1")
        if not self.data_directory:
            raise ValueError("data_directory must not be empty")
        if not isinstance(self.compaction_strategy, CompactionStrategy):
            raise ValueError("compaction_strategy must be a CompactionStrategy")

    def replace(self, **changes) -> StoreConfig:
        return dataclasses.replace(self, **changes)
