"""A store on disk: log, segments and manifest behind one interface.

Batches are the unit of work: ``put_batch``, ``multi_get`` and ``scan`` are Spark jobs
over whole tables.  The single-key calls are there for completeness; each is a job too.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from enum import Enum

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .config import CompactionStrategy, StoreConfig
from .functions.keys import ENTRY_HEADER, Key, encode, entry_bytes, in_range, prefix_end
from .operators import merge, reads
from .operators.bloom import Filter
from .operators.compaction import compacted, may_drop_tombstones
from .operators.planning import Planner, SegmentInfo, SizeTieredPlanner, ThresholdPlanner
from .sources import segments
from .sources.manifest import Conflict, Manifest, Segment, Version
from .sources.wal import Batch, WriteAheadLog

#: How long readers may go on with what has been replaced.
GRACE_MS = 60 * 60 * 1000
#: Segments' filters that a store keeps at the driver, of 1.2 MB at most at the default rate.
KEPT_FILTERS = 64
OPS = "op string, key binary, value binary, ttl_seconds bigint, ts_ms bigint"


class Status(Enum):
    SUCCESS = "SUCCESS"
    INVALID_INPUT = "INVALID_INPUT"
    WAL_ERROR = "WAL_ERROR"
    MEMTABLE_FULL = "MEMTABLE_FULL"
    KEY_NOT_FOUND = "KEY_NOT_FOUND"


class KeyValueIterator:
    """(key, value) pairs in key order; ``peek`` shows the next key and takes nothing."""

    def __init__(self, rows: Iterator[Row]):
        self._rows, self._next = rows, next(rows, None)

    def __iter__(self):
        return self

    def has_next(self) -> bool:
        return self._next is not None

    def peek(self) -> bytes | None:
        return None if self._next is None else bytes(self._next["key"])

    def __next__(self) -> tuple[bytes, bytes]:
        if self._next is None:
            raise StopIteration
        row, self._next = self._next, next(self._rows, None)
        return bytes(row["key"]), bytes(row["value"])

    def close(self) -> None:
        self._rows, self._next = iter(()), None


def wall_clock_ms() -> int:
    return int(time.time() * 1000)


class KVStore:
    def __init__(self, spark: SparkSession, config: StoreConfig | str | None = None, planner: Planner | None = None):
        self.spark = spark
        self.config = StoreConfig(data_directory=config) if isinstance(config, str) else config or StoreConfig()
        self.root = self.config.data_directory
        self.log = WriteAheadLog(spark, self.root)
        self.manifest = Manifest(spark, self.root)
        c = self.config
        self.planner = planner or (
            ThresholdPlanner(c.compaction_threshold) if c.compaction_strategy is CompactionStrategy.THRESHOLD
            else SizeTieredPlanner(c.min_threshold, c.max_threshold, c.bucket_low, c.bucket_high)
        )
        self.last_error: Exception | None = None
        self._filters: dict[str, Filter] = {}

    # -- what is there -----------------------------------------------------

    def bloom(self, segment: Segment) -> Filter | None:
        """The segment's saved filter, if it has one; the last ``KEPT_FILTERS`` are kept."""
        if segment.bloom is None:
            return None
        if segment.bloom not in self._filters:
            while len(self._filters) >= KEPT_FILTERS:
                self._filters.pop(next(iter(self._filters)))
            self._filters[segment.bloom] = Filter.from_json(self.log.files.read(segment.bloom))
        return self._filters[segment.bloom]

    def candidates(self, key: Key, version: Version | None = None) -> list[Segment]:
        """The live segments that may hold ``key``, by their bounds and filters; no job."""
        k = encode(key)
        near = [s for s in (version or self.manifest.current()).segments if s.overlaps(k, k + b"\0")]
        return [s for s in near if s.bloom is None or self.bloom(s).might_contain(k)]

    def rows(self, start: bytes | None = None, end: bytes | None = None, version: Version | None = None, key: bytes | None = None) -> DataFrame:
        """All versions: live segments that may hold keys of [start, end), or ``key``, and the log's tail.
        Recovery is this union: what was logged and not flushed is read from the log."""
        # Log batches first: if a flush commits in between, a row is met twice, never missed.
        batches = self.log.batches()
        v = version or self.manifest.current()
        paths = [s.path for s in (self.candidates(key, v) if key else v.segments) if s.overlaps(start, end)]
        tail = [b for b in batches if b.last > v.flushed_seq]
        parts = []
        if paths:
            parts.append(segments.read(self.spark, paths))
        if tail or not parts:
            parts.append(merge.versions(self.log.read(v.flushed_seq, tail)))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def scan(self, start: Key | None = None, end: Key | None = None, now_ms: int | None = None, ordered: bool = False) -> DataFrame:
        """Visible (key, value, expires_at_ms, tombstone, seq) with start <= key < end."""
        low, high = (None if k is None else encode(k) for k in (start, end))
        return reads.scan(self.rows(low, high), self._now(now_ms), low, high, ordered)

    get_range = scan

    def prefix(self, prefix: Key, now_ms: int | None = None) -> DataFrame:
        return self.scan(encode(prefix), prefix_end(prefix), now_ms)

    def iterator(self, start: Key | None = None, end: Key | None = None, now_ms: int | None = None) -> KeyValueIterator:
        """A snapshot in key order; rows come a partition at a time."""
        return KeyValueIterator(self.scan(start, end, now_ms, ordered=True).select("key", "value").toLocalIterator())

    def entries(self, start: Key | None = None, end: Key | None = None) -> DataFrame:
        """The newest version of each key of a range in key order, tombstones and expired ones too."""
        low, high = (None if k is None else encode(k) for k in (start, end))
        return reads.entries(self.rows(low, high), low, high)

    def list_keys(self, now_ms: int | None = None) -> DataFrame:
        return reads.list_keys(self.rows(), self._now(now_ms))

    def multi_get(self, keys: DataFrame, now_ms: int | None = None) -> DataFrame:
        return reads.multi_get(self.rows(), keys, self._now(now_ms))

    def contains(self, keys: DataFrame, now_ms: int | None = None) -> DataFrame:
        return reads.contains(self.rows(), keys, self._now(now_ms))

    def get(self, key: Key | None, now_ms: int | None = None) -> bytes | None:
        if not key:
            return None
        k = encode(key)
        row = reads.point_get(self.rows(key=k), k, self._now(now_ms)).select("value").first()
        return None if row is None else bytes(row["value"])

    def contains_key(self, key: Key | None, now_ms: int | None = None) -> bool:
        return self.get(key, now_ms) is not None

    def size(self, now_ms: int | None = None) -> int:
        return reads.size(self.rows(), self._now(now_ms)).first()[0]

    def size_approx(self) -> int:
        """Entries of all runs, without looking for overwritten keys; from the manifest and batch names alone."""
        v = self.manifest.current()
        return sum(s.entry_count for s in v.segments) + sum(b.last - max(b.first - 1, v.flushed_seq) for b in self.log.batches() if b.last > v.flushed_seq)

    def segments_count(self) -> int:
        return len(self.manifest.current().segments)

    def tail(self, version: Version | None = None) -> list[Batch]:
        """Log batches with rows that no segment has."""
        batches = self.log.batches()
        flushed = (version or self.manifest.current()).flushed_seq
        return [b for b in batches if b.last > flushed]

    def tail_rows(self) -> DataFrame:
        """All versions of the log's tail, tombstones too: what a memory table would hold."""
        return merge.versions(self.log.read(self.manifest.current().flushed_seq, self.tail()))

    def segment_rows(self, segment_id: int, start: Key | None = None, end: Key | None = None) -> DataFrame:
        """All versions of one segment in a key range, tombstones too."""
        paths = [s.path for s in self.manifest.current().segments if s.segment_id == segment_id]
        return segments.read(self.spark, paths).where(in_range(start, end))

    def tail_bytes(self) -> int:
        return sum(b.bytes for b in self.tail())

    def is_full(self) -> bool:
        """Whether the log's tail has reached ``mem_table_max_size_bytes``."""
        return self.tail_bytes() >= self.config.mem_table_max_size_bytes

    # -- writes --------------------------------------------------------------

    def append(self, ops: DataFrame, order_by: list | None = None, stream: tuple[str, int] | None = None) -> int:
        """Logs valid operations (op, key, value, ttl_seconds, ts_ms); how many. ``stream`` (name, batch)
        is logged once, however often it is tried.  An entry larger than ``mem_table_max_size_bytes`` is not
        taken; once the tail has reached that size it is flushed, with expired rows as they are: no time is given
        here, and a read may be as of a time before the clock's."""
        accepted, _ = reads.validate(ops)
        accepted = accepted.where(entry_bytes() <= self.config.mem_table_max_size_bytes)
        if stream and self.manifest.current().streams.get(stream[0], -1) >= stream[1]:
            return 0
        batch = self.log.append(accepted, lambda: self.manifest.current().flushed_seq, order_by, f"{stream[0]}.{stream[1]}" if stream else None)
        if batch and self.is_full():
            try:
                self.flush(keep_expired=True)
            except Conflict:
                pass  # another writer has flushed
        return batch.last - batch.first + 1 if batch else 0

    def put_batch(self, rows: DataFrame, ttl_seconds: int = 0, now_ms: int | None = None, order_by: list | None = None) -> int:
        """Puts (key, value) rows; the later of equal keys wins."""
        ops = rows.select(
            *(c for c in rows.columns if c in (order_by or [])), F.lit("P").alias("op"), "key", "value",
            F.lit(ttl_seconds).cast("bigint").alias("ttl_seconds"), F.lit(self._now(now_ms)).alias("ts_ms"),
        )
        return self.append(ops, order_by)

    def ingest(self, rows: DataFrame, key: Column | str, value: Column | str, ttl_seconds: int = 0, now_ms: int | None = None, order_by: list | None = None) -> int:
        """Puts rows of any shape: ``key`` and ``value`` are columns or SQL expressions; text goes in as UTF-8."""
        made = [F.expr(c) if isinstance(c, str) else c for c in (key, value)]
        # Columns of ``rows`` named key or value give way; those to order by stay.
        kept = [c for c in rows.columns if c in (order_by or []) and c not in ("key", "value")]
        return self.put_batch(rows.select(*kept, made[0].cast("binary").alias("key"), made[1].cast("binary").alias("value")), ttl_seconds, now_ms, order_by)

    def put_batch_status(self, rows: DataFrame, ttl_seconds: int = 0, now_ms: int | None = None, order_by: list | None = None) -> DataFrame:
        """As ``put_batch``; the rows and what became of each. What the log refuses as a whole is WAL_ERROR."""
        logged = Status.SUCCESS
        try:
            self.put_batch(rows, ttl_seconds, now_ms, order_by)
        except (PySparkException, Py4JError, OSError) as e:
            self.last_error, logged = e, Status.WAL_ERROR
        status = F.when(~reads.valid_key() | F.col("value").isNull(), Status.INVALID_INPUT.value)
        return rows.withColumn("status", status.when(entry_bytes() > self.config.mem_table_max_size_bytes, Status.MEMTABLE_FULL.value).otherwise(logged.value))

    def put(self, key: Key | None, value: Key | None, ttl_seconds: int = 0, now_ms: int | None = None) -> bool:
        return self.put_status(key, value, ttl_seconds, now_ms) is Status.SUCCESS

    def put_status(self, key: Key | None, value: Key | None, ttl_seconds: int = 0, now_ms: int | None = None) -> Status:
        if not key or value is None:
            return Status.INVALID_INPUT
        if len(encode(key)) + ENTRY_HEADER + len(encode(value)) > self.config.mem_table_max_size_bytes:
            return Status.MEMTABLE_FULL
        return self._log([("P", encode(key), encode(value), ttl_seconds, self._now(now_ms))])

    def delete(self, key: Key | None, now_ms: int | None = None) -> bool:
        return self.delete_status(key, now_ms) is Status.SUCCESS

    def delete_status(self, key: Key | None, now_ms: int | None = None) -> Status:
        """A tombstone, only if the key is readable."""
        if not key:
            return Status.INVALID_INPUT
        if self.get(key, now_ms) is None:
            return Status.KEY_NOT_FOUND
        return self._log([("D", encode(key), None, 0, self._now(now_ms))])

    def delete_batch(self, keys: DataFrame, now_ms: int | None = None) -> int:
        """Tombstones for the readable ones of ``keys``; how many."""
        gone = reads.deletable(self.rows(), keys, self._now(now_ms))
        return self.append(gone.select(
            F.lit("D").alias("op"), "key", F.lit(None).cast("binary").alias("value"), F.lit(0).cast("bigint").alias("ttl_seconds"), F.lit(self._now(now_ms)).alias("ts_ms")
        ))

    def delete_batch_status(self, keys: DataFrame, now_ms: int | None = None) -> DataFrame:
        """As ``delete_batch``; the requests and what became of each, by what was readable before. Equal keys are one request."""
        now = self._now(now_ms)
        found = reads.contains(self.rows(), keys, now)
        logged = Status.SUCCESS
        try:
            self.delete_batch(keys, now)
        except (PySparkException, Py4JError, OSError) as e:
            self.last_error, logged = e, Status.WAL_ERROR
        status = F.when(~reads.valid_key(), Status.INVALID_INPUT.value).when(F.col("present"), logged.value).otherwise(Status.KEY_NOT_FOUND.value)
        return found.select(*keys.columns, status.alias("status"))

    def _log(self, ops: list[tuple]) -> Status:
        try:
            self.append(self.spark.createDataFrame([(o, bytearray(k), None if v is None else bytearray(v), t, n) for o, k, v, t, n in ops], OPS))
            return Status.SUCCESS
        except (PySparkException, Py4JError, OSError) as e:
            self.last_error = e
            return Status.WAL_ERROR

    # -- maintenance ---------------------------------------------------------

    def flush(self, now_ms: int | None = None, keep_expired: bool = False) -> Segment | None:
        """The log's tail as a level-0 segment, and the commit; its batches go with ``vacuum``.  An empty tail does nothing.
        Rows that have expired become tombstones, unless ``keep_expired`` leaves them to be judged by reads."""
        v = self.manifest.current()
        tail = self.tail(v)
        if not tail:
            return None
        rows = merge.latest(merge.versions(self.log.read(v.flushed_seq, tail)))
        if not keep_expired:
            rows = merge.as_tombstones(rows, self._now(now_ms))
        expected = sum(b.last - b.first + 1 for b in tail)
        made = segments.write(rows, self.root, v.next_segment_id, 0, self._now(now_ms), expected, self.config.rows_per_file, self.config.bloom_error)
        streams = dict(v.streams)
        for b in tail:
            if b.token:
                name, _, number = b.token.rpartition(".")
                streams[name] = max(streams.get(name, -1), int(number))
        last = max(b.last for b in tail)
        self._commit(v, made, next_segment_id=v.next_segment_id + 1, flushed_seq=last, streams=streams, segments=(*v.segments, *([made] if made else [])))
        return made

    switch_mem_table = flush

    def _commit(self, before: Version, made: Segment | None, **changes) -> None:
        """Commits; if another writer was first, what was made is of no use and goes."""
        try:
            self.manifest.commit(before, **changes)
        except Conflict:
            if made:
                self.log.files.delete(made.path)
            raise

    def compact(self, chosen_ids: list[int] | None = None, now_ms: int | None = None) -> Segment | None:
        """What the planner selects, or the segments named, as one segment."""
        v = self.manifest.current()
        infos = [SegmentInfo(s.segment_id, s.level, s.size_bytes, s.entry_count) for s in v.segments]
        if chosen_ids is None:
            if not self.planner.should_compact(infos):
                return None
            chosen_ids = [s.segment_id for s in self.planner.select(infos)]
        chosen = [s for s in v.segments if s.segment_id in chosen_ids]
        if not chosen:
            return None
        others = [s for s in v.segments if s.segment_id not in chosen_ids]
        level = self.planner.output_level([i for i in infos if i.segment_id in chosen_ids])
        rows = compacted(segments.read(self.spark, [s.path for s in chosen]), self._now(now_ms), may_drop_tombstones(chosen, others))
        made = segments.write(rows, self.root, v.next_segment_id, level, self._now(now_ms), sum(s.entry_count for s in chosen), self.config.rows_per_file, self.config.bloom_error)
        self._commit(v, made, next_segment_id=v.next_segment_id + 1, segments=(*others, *([made] if made else [])))
        return made

    def cleanup(self, now_ms: int | None = None) -> int:
        """Logs a tombstone for every key whose newest version has expired; how many."""
        now = self._now(now_ms)
        gone = reads.expired(self.rows(), now)
        return self.append(gone.select(
            F.lit("D").alias("op"), "key", F.lit(None).cast("binary").alias("value"), F.lit(0).cast("bigint").alias("ttl_seconds"), F.lit(now).alias("ts_ms")
        ))

    def vacuum(self, grace_ms: int = GRACE_MS, now_ms: int | None = None) -> int:
        """Deletes what only versions replaced more than ``grace_ms`` ago name; how many segments and batches.

        Whoever has opened a scan, an iterator or a stale listing of the log within that time can go on.
        """
        old, kept = self.manifest.superseded(wall_clock_ms() - grace_ms if now_ms is None else now_ms - grace_ms)
        held = {s.path for v in kept for s in v.segments}
        gone = {s.path for v in old for s in v.segments} - held
        flushed = min((v.flushed_seq for v in kept), default=-1)
        batches = [b for b in self.log.batches() if b.last <= flushed]
        for path in gone:
            self.log.files.delete(path)
        self.log.truncate(flushed)
        for v in old:
            self.manifest.forget(v)
        return len(gone) + len(batches)

    def maintain(self, now_ms: int | None = None) -> None:
        """A flush, then compaction if the planner asks for it, then what no reader can need goes."""
        self.flush(now_ms)
        self.compact(now_ms=now_ms)
        self.vacuum()

    def clear(self) -> None:
        """No rows from here on: a commit behind all that is logged."""
        v = self.manifest.current()
        batches = self.log.batches()
        self.manifest.commit(v, segments=(), flushed_seq=max([v.flushed_seq, *(b.last for b in batches)]))

    def close(self, now_ms: int | None = None) -> None:
        """Flushes what is logged."""
        self.flush(now_ms)

    shutdown = close

    @staticmethod
    def _now(now_ms: int | None) -> int:
        return wall_clock_ms() if now_ms is None else now_ms


