"""All registered queries of the store, each with SQL of the same result."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvlake.functions import keys as K
from kvlake.operators import bloom, merge, reads
from kvlake.config import StoreConfig
from kvlake.operators.compaction import compacted
from kvlake.operators.planning import SegmentInfo, SizeTieredPlanner, ThresholdPlanner
from kvlake.schema import VERSION
from kvlake.sources.filesystem import shared_folder
from kvlake.sources.wal import WriteAheadLog
from kvlake.store import KVStore
from kvlake.streaming.ingest import latest_state

from .changelog import LOG_SQL, NOW_MS, SEGMENT_ROWS, events_log, events_versions, orders_log, with_segment

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

PROBES = ("user-00001-0", "user-00001-1", "user-00002-2", "user-00003-3", "user-00007-5", "user-99999-0", "nobody", "", None)
PROBES_SQL = "(VALUES " + ", ".join("(NULL)" if p is None else f"('{p}')" for p in PROBES) + ") AS p(key)"


#: What begins SQL with a recursive part.
LEVELS_RECURSIVE = ", m AS (SELECT segment_id, segment_id % 3 AS level"


def query(sql: str | None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = (LOG_SQL.replace("WITH log", "WITH RECURSIVE log") if sql.startswith(LEVELS_RECURSIVE) else LOG_SQL) + sql
        return f

    return add


def rows_out(df: DataFrame, *more: str) -> DataFrame:
    """Binary columns as text."""
    return df.select(K.shown("key").alias("key"), K.shown("value").alias("value"), "seq", "expires_at_ms", *more)


def probes(spark: SparkSession) -> DataFrame:
    named = F.explode(F.array(*(F.lit(p).cast("string") for p in PROBES)))
    return spark.range(1).select(named.alias("k")).select(K.key_column("k").alias("key"))


STATE = "SELECT key, value, seq, expires_at_ms FROM vis"


@query(STATE)
def current_state(spark, d):
    """The visible rows."""
    return rows_out(merge.visible(events_versions(spark, d), NOW_MS))


GROUPS = """, g AS (SELECT CASE WHEN op = 'D' THEN 'deleted' WHEN gone THEN 'expired' ELSE 'live' END AS probe, min(key) AS key FROM s GROUP BY 1
  UNION ALL SELECT 'absent', 'nobody')"""


@query(GROUPS + " SELECT probe, g.key, vis.key IS NOT NULL AS found, vis.value, vis.seq FROM g LEFT JOIN vis ON g.key = vis.key")
def point_get(spark, d):
    """A key that is live, one that is deleted, one that has expired, each the first of its kind, and one that never was."""
    rows = events_versions(spark, d)
    kind = F.when(F.col("tombstone"), "deleted").when(K.is_expired(NOW_MS), "expired").otherwise("live")
    wanted = [(r["probe"], bytes(r["key"])) for r in merge.latest(rows).groupBy(kind.alias("probe")).agg(F.min("key").alias("key")).collect()]
    out = None
    for probe, key in [*wanted, ("absent", b"nobody")]:
        got = reads.point_get(rows, key, NOW_MS).select(K.shown("value").alias("value"), "seq", F.lit(True).alias("found"))
        one = spark.range(1).select(F.lit(probe).alias("probe"), F.lit(key.decode()).alias("key")).join(got, F.lit(True), "left")
        one = one.withColumn("found", F.coalesce("found", F.lit(False)))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""SELECT p.key, CASE WHEN p.key IS NULL OR p.key = '' THEN 'INVALID_INPUT' WHEN vis.key IS NULL THEN 'KEY_NOT_FOUND' ELSE 'SUCCESS' END AS status,
    vis.value, vis.seq FROM {PROBES_SQL} LEFT JOIN vis ON p.key = vis.key""")
def multi_get_status(spark, d):
    found = reads.multi_get(events_versions(spark, d), probes(spark), NOW_MS, small=True)
    return found.select(K.shown("key").alias("key"), "status", K.shown("value").alias("value"), "seq")


@query(f"SELECT p.key, vis.key IS NOT NULL AS present FROM {PROBES_SQL} LEFT JOIN vis ON p.key = vis.key")
def contains_keys(spark, d):
    return reads.contains(events_versions(spark, d), probes(spark), NOW_MS, small=True).select(K.shown("key").alias("key"), "present")


RANGES = {
    "range_scan": ("user-00010", "user-00020"),
    "range_open_start": (None, "user-00005"),
    "range_open_end": ("user-00012", None),
    "range_reversed_empty": ("user-00020", "user-00010"),
}
for _name, (_start, _end) in RANGES.items():
    _met = " AND ".join([*([f"key >= '{_start}'"] if _start else []), *([f"key < '{_end}'"] if _end else [])])
    query(f"{STATE} WHERE {_met}", _name)(lambda spark, d, a=_start, b=_end: rows_out(reads.scan(events_versions(spark, d), NOW_MS, a, b)))


@query(STATE + " WHERE starts_with(key, 'user-0001')")
def prefix_scan(spark, d):
    return rows_out(reads.prefix_scan(events_versions(spark, d), "user-0001", NOW_MS))


@query("SELECT key FROM vis")
def list_keys(spark, d):
    return reads.list_keys(events_versions(spark, d), NOW_MS).select(K.shown("key").alias("key"))


@query("SELECT count(*) AS size FROM vis")
def size_exact(spark, d):
    return reads.size(events_versions(spark, d), NOW_MS)


@query("SELECT key, value, seq, expires_at_ms FROM vis ORDER BY key LIMIT 10")
def first_k_keys(spark, d):
    return rows_out(reads.first_k(events_versions(spark, d), 10, NOW_MS))


@query("SELECT key, seq FROM l WHERE op = 'D'")
def tombstones_only(spark, d):
    return merge.latest(events_versions(spark, d)).where("tombstone").select(K.shown("key").alias("key"), "seq")


@query(f"SELECT key, seq, expires_at_ms FROM l WHERE op = 'P' AND expires_at_ms > 0 AND {NOW_MS} > expires_at_ms")
def expired_only(spark, d):
    rows = merge.latest(events_versions(spark, d))
    return rows.where(~F.col("tombstone") & K.is_expired(NOW_MS)).select(K.shown("key").alias("key"), "seq", "expires_at_ms")


@query("SELECT key, seq, true AS live_at, false AS live_after FROM l WHERE op = 'P' AND expires_at_ms > 0")
def ttl_boundary(spark, d):
    """Rows that expire, at their very millisecond and one later."""
    rows = merge.latest(events_versions(spark, d)).where("not tombstone and expires_at_ms > 0")

    at = F.col("expires_at_ms")
    return rows.select(K.shown("key").alias("key"), "seq", (~K.is_expired(at)).alias("live_at"), (~K.is_expired(at + 1)).alias("live_after"))


def _before(spark, d, *columns: str) -> DataFrame:
    """Log rows with the op and expiry of the key's version before."""
    w = Window.partitionBy("key").orderBy("seq")
    rows = events_versions(spark, d).withColumn("op", F.when(F.col("tombstone"), "D").otherwise("P"))
    return rows.select("key", "seq", "op", "expires_at_ms", F.lag("op").over(w).alias("op_before"), F.lag("expires_at_ms").over(w).alias("expires_before"), F.lead("seq").over(w).isNull().alias("newest"))


BEFORE = """, b AS (SELECT *, lag(op) OVER w AS op_before, lag(expires_at_ms) OVER w AS expires_before, lead(seq) OVER w IS NULL AS newest
  FROM v WINDOW w AS (PARTITION BY key ORDER BY seq))"""


@query(BEFORE + " SELECT key, seq FROM b WHERE newest AND op = 'P' AND op_before = 'D'")
def delete_then_put(spark, d):
    return _before(spark, d).where("newest and op = 'P' and op_before = 'D'").select(K.shown("key").alias("key"), "seq")


@query(BEFORE + " SELECT key, seq, expires_before FROM b WHERE newest AND op = 'P' AND expires_at_ms = 0 AND expires_before > 0")
def ttl_override_by_newer_put(spark, d):
    return _before(spark, d).where("newest and op = 'P' and expires_at_ms = 0 and expires_before > 0").select(K.shown("key").alias("key"), "seq", "expires_before")


@query(BEFORE + " SELECT key, seq FROM b WHERE op = 'D' AND (op_before IS NULL OR op_before = 'D')")
def delete_absent_is_noop(spark, d):
    """Deletes that find nothing to delete."""
    return _before(spark, d).where("op = 'D' and (op_before is null or op_before = 'D')").select(K.shown("key").alias("key"), "seq")


@query("""SELECT key, seq, NOT (key IS NULL OR key = '' OR (op = 'P' AND value IS NULL)) AS accepted
  FROM (SELECT key, value, op, seq FROM log UNION ALL VALUES (NULL, 'v', 'P', -1), ('', 'v', 'P', -2), ('k', NULL, 'P', -3), ('k', '', 'P', -4), (NULL, NULL, 'D', -5))""")
def reject_invalid_input(spark, d):
    bad = [(None, "v", "P", -1), ("", "v", "P", -2), ("k", None, "P", -3), ("k", "", "P", -4), (None, None, "D", -5)]
    extra = spark.range(1).select(F.explode(F.array(*(
        F.struct(F.lit(k).cast("string").cast("binary").alias("key"), F.lit(v).cast("string").cast("binary").alias("value"), F.lit(o).alias("op"), F.lit(s).cast("bigint").alias("seq")) for k, v, o, s in bad
    ))).alias("r")).select("r.*")
    ok, no = reads.validate(events_log(spark, d).select("key", "value", "op", "seq").union(extra))
    both = ok.withColumn("accepted", F.lit(True)).union(no.withColumn("accepted", F.lit(False)))
    return both.select(K.shown("key").alias("key"), "seq", "accepted")


# Where a log or a run is cut in two: by its last sequence number.
FIRST_PART = "(SELECT max(seq) * 2 // 5 FROM log)"
TAIL = "(SELECT max(seq) * 9 // 10 FROM log)"
HALF = "(SELECT max(segment_id) // 2 FROM log)"


def _last(spark, d, column: str = "seq") -> int:
    return with_segment(events_log(spark, d)).agg(F.max(column)).first()[0] or 0


@query(f""", r AS (SELECT * FROM v WHERE seq <= {FIRST_PART} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)
  SELECT key, value, seq, expires_at_ms FROM r WHERE op = 'P' AND NOT (expires_at_ms > 0 AND {NOW_MS} > expires_at_ms)""")
def wal_replay_prefix(spark, d):
    """The state after the first two fifths of the log."""
    return rows_out(merge.visible(events_versions(spark, d).where(F.col("seq") <= _last(spark, d) * 2 // 5), NOW_MS))


ROTATE = 64 * 1024


@query(f""", n AS (SELECT seq, CASE WHEN op = 'P' THEN 25 + strlen(key) + strlen(value) ELSE 13 + strlen(key) END AS bytes FROM log),
  f AS (SELECT seq, bytes, (CAST(sum(bytes) OVER (ORDER BY seq) AS BIGINT) - 1) // {ROTATE} AS file FROM n)
  SELECT file, count(*) AS records, CAST(sum(bytes) AS BIGINT) AS bytes, min(seq) AS first_seq, max(seq) AS last_seq FROM f GROUP BY file""")
def wal_file_estimate(spark, d):
    """Files of about 64 KB in log order.  Sums per block of the log come first, so that only
    these, one row per block, are summed up in one place."""
    rows = events_log(spark, d).select("seq", K.record_bytes().alias("bytes"), F.floor(F.col("seq") / SEGMENT_ROWS).alias("block"))
    sums = rows.groupBy("block").agg(F.sum("bytes").alias("own"))
    sums = sums.select("block", F.coalesce(F.sum("own").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("block").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("inside", F.sum("bytes").over(inside)).join(sums, "block")
    file = F.floor((F.col("before") + F.col("inside") - 1) / ROTATE)
    return placed.groupBy(file.alias("file")).agg(F.count("*").alias("records"), F.sum("bytes").alias("bytes"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("SELECT op, count(*) AS records FROM log GROUP BY op")
def wal_record_counts(spark, d):
    return events_log(spark, d).groupBy("op").agg(F.count("*").alias("records"))


@query("SELECT max(seq) AS max_seq FROM log")
def max_seq(spark, d):
    return events_log(spark, d).agg(F.max("seq").alias("max_seq"))


def _log(spark, d, parts: int = 1) -> WriteAheadLog:
    """A log on disk with all events, in so many batches."""
    log = WriteAheadLog(spark, f"{shared_folder(spark)}/log-{uuid.uuid4().hex}")
    for rows in _parts(spark, d, parts):
        log.append(rows, -1, ["seq"])
    return log


def _parts(spark, d, parts: int) -> list[DataFrame]:
    """The log by sequence numbers, in so many parts."""
    log, step = events_log(spark, d), -(-(_last(spark, d) + 1) // max(parts, 1))
    return [log.where((F.col("seq") >= i * step) & (F.col("seq") < (i + 1) * step)) for i in range(parts)]


@query(f"SELECT seq, op, key, value, ttl AS ttl_seconds, ts_ms FROM log WHERE seq > {TAIL} ORDER BY seq")
def wal_scan_tail(spark, d):
    """Records of a log on disk behind a sequence number, in order."""
    rows = _log(spark, d, 2).read(_last(spark, d) * 9 // 10).orderBy("seq")
    return rows.select("seq", "op", K.shown("key").alias("key"), K.shown("value").alias("value"), "ttl_seconds", "ts_ms")


@query("SELECT op, key, value, ttl AS ttl_seconds, ts_ms FROM log")
def store_two_writers(spark, d):
    """Two writers append at once, each having seen the same log: every record is there once."""
    root = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    met = threading.Barrier(2)
    failed: list[BaseException] = []

    def write(rows: DataFrame) -> None:
        first = [True]

        def claim() -> None:
            if first.pop() if first else False:
                met.wait(120)

        try:
            WriteAheadLog(spark, root).append(rows, -1, ["seq"], claim=claim)
        except BaseException as e:  # noqa: BLE001 - raised below, in the caller's thread
            failed.append(e)
            met.abort()

    writers = [threading.Thread(target=write, args=(rows,)) for rows in _parts(spark, d, 2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    if failed:
        raise failed[0]
    rows = KVStore(spark, root).log.checked()
    return rows.select("op", K.shown("key").alias("key"), K.shown("value").alias("value"), "ttl_seconds", "ts_ms")


@query("""SELECT segment_id, count(*) AS rows, count(DISTINCT key) AS keys, CAST(sum(CASE WHEN op = 'D' THEN 1 ELSE 0 END) AS BIGINT) AS tombstones, min(key) AS min_key,
  max(key) AS max_key, min(seq) AS min_seq, max(seq) AS max_seq, CAST(sum(strlen(key) + 16 + coalesce(strlen(value), 0)) AS BIGINT) AS bytes FROM log GROUP BY segment_id""")
def segment_stats(spark, d):
    """By segment: per key first, so no distinct keys gather in one place."""
    rows = with_segment(events_versions(spark, d)).withColumn("bytes", K.entry_bytes())
    per_key = rows.groupBy("segment_id", "key").agg(
        F.count("*").alias("n"), F.sum(F.col("tombstone").cast("bigint")).alias("t"), F.min("seq").alias("a"), F.max("seq").alias("b"), F.sum("bytes").alias("bytes")
    )
    return per_key.groupBy("segment_id").agg(
        F.sum("n").alias("rows"), F.count("*").alias("keys"), F.sum("t").alias("tombstones"), K.shown(F.min("key")).alias("min_key"), K.shown(F.max("key")).alias("max_key"),
        F.min("a").alias("min_seq"), F.max("b").alias("max_seq"), F.sum("bytes").alias("bytes"),
    )


def _segment_latest(spark, d) -> DataFrame:
    """The newest version of each key within each segment."""
    w = Window.partitionBy("key", "segment_id").orderBy(F.col("seq").desc())
    return with_segment(events_versions(spark, d)).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


SEGMENT_LATEST = ", sl AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY key, segment_id ORDER BY seq DESC) = 1)"
_GONE = f"(op = 'D' OR (expires_at_ms > 0 AND {NOW_MS} > expires_at_ms))"


@query(SEGMENT_LATEST + f""" SELECT segment_id, key, CASE WHEN {_GONE} THEN NULL ELSE value END AS value, CASE WHEN {_GONE} THEN 0 ELSE expires_at_ms END AS expires_at_ms,
  {_GONE} AS tombstone, seq FROM sl""")
def flush_latest_per_segment(spark, d):
    """What a flush of each run writes: expired rows as tombstones."""
    return rows_out(merge.as_tombstones(_segment_latest(spark, d), NOW_MS, "segment_id"), "tombstone", "segment_id")


@query("SELECT key, value, seq, expires_at_ms, op = 'D' AS tombstone FROM l")
def merge_runs(spark, d):
    """The log as two runs, an older and a newer one, merged: the newer row of a key wins."""
    rows, half = events_versions(spark, d), _last(spark, d) // 2
    runs = [merge.latest(rows.where(F.col("seq") <= half)), merge.latest(rows.where(F.col("seq") > half))]
    return rows_out(merge.merge(*runs), "tombstone")


@query("SELECT segment_id, min(key) AS min_key, max(key) AS max_key FROM log GROUP BY segment_id HAVING min(key) <= 'user-00003-3' AND max(key) >= 'user-00003-3'")
def segment_prune_minmax(spark, d):
    """The segments a key may be in, by their bounds."""
    bounds = with_segment(events_versions(spark, d)).groupBy("segment_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    key = F.lit(bytearray(b"user-00003-3"))
    return bounds.where((F.col("lo") <= key) & (F.col("hi") >= key)).select("segment_id", K.shown("lo").alias("min_key"), K.shown("hi").alias("max_key"))


@query("SELECT segment_id, max(key) AS floor_key FROM log WHERE key <= 'user-00005' GROUP BY segment_id")
def index_floor_lookup(spark, d):
    """By segment, the greatest key at or below a probe."""
    rows = with_segment(events_versions(spark, d)).where(F.col("key") <= F.lit(bytearray(b"user-00005")))
    return rows.groupBy("segment_id").agg(K.shown(F.max("key")).alias("floor_key"))


@query(STATE)
def compact_full(spark, d):
    """All segments into one: no tombstone is needed, and the state is unchanged."""
    return rows_out(compacted(_segment_latest(spark, d).drop("segment_id"), NOW_MS, drop_tombstones=True))


@query(STATE)
def compact_partial_keeps_tombstones(spark, d):
    """The newer half compacted with its tombstones, and read over the older half."""
    rows, half = _segment_latest(spark, d), _last(spark, d, "segment_id") // 2
    newer = compacted(rows.where(F.col("segment_id") >= half).drop("segment_id"), NOW_MS, drop_tombstones=False)
    return rows_out(merge.visible(rows.where(F.col("segment_id") < half).drop("segment_id").unionByName(newer), NOW_MS))


@query(f", r AS (SELECT * FROM v WHERE segment_id >= {HALF} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) SELECT count(*) AS entries, CAST(sum(CASE WHEN {_GONE} THEN 1 ELSE 0 END) AS BIGINT) AS tombstones FROM r")
def compact_drops_expired(spark, d):
    """Entries of the newer half compacted; expired ones have become tombstones."""
    half = _last(spark, d, "segment_id") // 2
    rows = compacted(_segment_latest(spark, d).where(F.col("segment_id") >= half).drop("segment_id"), NOW_MS, drop_tombstones=False)
    return rows.agg(F.count("*").alias("entries"), F.sum(F.col("tombstone").cast("bigint")).alias("tombstones"))


LEVELS = """, m AS (SELECT segment_id, segment_id % 3 AS level, CAST(sum(strlen(key) + 16 + coalesce(strlen(value), 0)) AS BIGINT) AS size_bytes
  FROM log GROUP BY segment_id)"""


def _manifest(spark, d) -> DataFrame:
    """A manifest over the log's segments, levels given by number."""
    rows = with_segment(events_versions(spark, d)).withColumn("b", K.entry_bytes())
    return rows.groupBy("segment_id").agg(F.sum("b").alias("size_bytes")).select("segment_id", (F.col("segment_id") % 3).alias("level"), "size_bytes")


def _planned(spark, manifest: DataFrame, planner) -> DataFrame:
    """What a planner selects of a manifest, which is the driver's: a row per segment."""
    infos = [SegmentInfo(r["segment_id"], r["level"], r["size_bytes"]) for r in manifest.orderBy("segment_id").collect()]
    chosen = planner.select(infos)
    level = planner.output_level(chosen)
    return spark.createDataFrame([(s.segment_id, s.level, s.size_bytes, level) for s in chosen], "segment_id bigint, level bigint, size_bytes bigint, output_level bigint")


@query(LEVELS + ", c AS (SELECT level, count(*) AS n FROM m GROUP BY level HAVING count(*) >= 2 ORDER BY n DESC, level LIMIT 1) SELECT segment_id, level, size_bytes, level + 1 AS output_level FROM m JOIN c USING (level)")
def plan_threshold(spark, d):
    """The segments of the fullest level."""
    return _planned(spark, _manifest(spark, d), ThresholdPlanner())


SIZE_TIERED = """, t AS (SELECT segment_id, level, CASE WHEN segment_id % 4 = 0 THEN size_bytes * 10 ELSE size_bytes END AS size_bytes FROM m),
  o AS (SELECT *, row_number() OVER (ORDER BY size_bytes, segment_id) AS i FROM t),
  f(i, buckets, place) AS (
    SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(total BIGINT, n BIGINT)[]), CAST(0 AS BIGINT)
    UNION ALL
    SELECT i, CASE WHEN hit > 0 THEN list_transform(buckets, lambda b, k: CASE WHEN k = hit THEN {'total': b.total + size_bytes, 'n': b.n + 1} ELSE b END)
        ELSE list_append(buckets, {'total': size_bytes, 'n': CAST(1 AS BIGINT)}) END, CASE WHEN hit > 0 THEN hit ELSE len(buckets) + 1 END
    FROM (SELECT o.i, f.buckets, o.size_bytes, coalesce(list_position(list_transform(f.buckets,
        lambda b: (b.total // b.n) * 0.5 <= o.size_bytes AND o.size_bytes <= (b.total // b.n) * 1.5), true), 0) AS hit
      FROM f JOIN o ON o.i = f.i + 1)
  ), p AS (SELECT o.*, f.place FROM o JOIN f USING (i)),
  best AS (SELECT place FROM p GROUP BY place HAVING count(*) >= 4 ORDER BY count(*) DESC, place LIMIT 1),
  c AS (SELECT segment_id, level, size_bytes FROM p JOIN best USING (place) ORDER BY segment_id LIMIT 32)
  SELECT segment_id, level, size_bytes, (SELECT max(level) + 1 FROM c) AS output_level FROM c"""


@query(LEVELS + SIZE_TIERED)
def plan_size_tiered(spark, d):
    """The oldest segments of the largest bucket of like-sized ones."""
    tenfold = F.when(F.col("segment_id") % 4 == 0, F.col("size_bytes") * 10).otherwise(F.col("size_bytes"))
    return _planned(spark, _manifest(spark, d).withColumn("size_bytes", tenfold), SizeTieredPlanner())


@query(LEVELS + " SELECT max(level) + 1 AS output_level FROM m")
def output_level(spark, d):
    return _manifest(spark, d).agg((F.max("level") + 1).alias("output_level"))


_BITS = "greatest(8, CAST(ceil(floor(-n * ln(0.01) / (ln(2) ** 2)) / 8) * 8 AS BIGINT))"
BLOOM = f""", n AS (SELECT segment_id, count(DISTINCT key) AS n FROM log GROUP BY segment_id), z AS (SELECT segment_id, n, {_BITS} AS bits FROM n),
  y AS (SELECT *, greatest(1, CAST(floor(bits / greatest(n, 1) * ln(2) + 0.5) AS BIGINT)) AS hashes FROM z)"""


def _bloom(spark, d) -> tuple[DataFrame, DataFrame]:
    """(segment_id, key) and the sized segments."""
    own = with_segment(events_versions(spark, d)).select("segment_id", "key").distinct()
    return own, bloom.sizes(own.groupBy("segment_id").agg(F.count("*").alias("n")))


@query(BLOOM + " SELECT segment_id, n, bits, hashes FROM y")
def bloom_build_sizes(spark, d):
    return _bloom(spark, d)[1]


@query("SELECT segment_id, count(DISTINCT key) AS keys, CAST(0 AS BIGINT) AS misses FROM log GROUP BY segment_id")
def bloom_no_false_negative(spark, d):
    """Every key of a segment is found in its filter."""
    own, sized = _bloom(spark, d)
    own = own.join(sized, "segment_id")
    found = bloom.might_contain(own, bloom.build(own, "segment_id"), "segment_id")
    return found.groupBy("segment_id").agg(F.count("*").alias("keys"), F.sum((~F.col("maybe")).cast("bigint")).alias("misses"))


_HEX = "CAST(concat('0x', substr(md5(k), {}, 8)) AS BIGINT)"


@query(BLOOM + f""", own AS (SELECT DISTINCT segment_id, key AS k FROM log), pos AS (SELECT segment_id, k, bits, hashes, {_HEX.format(1)} AS h1, {_HEX.format(9)} AS h2 FROM own JOIN y USING (segment_id)),
  f AS (SELECT DISTINCT segment_id, (h1 + i * h2) % bits AS at FROM (SELECT *, unnest(range(0, hashes)) AS i FROM pos)),
  probe AS (SELECT DISTINCT 'absent-' || key AS k FROM log), pr AS (SELECT segment_id, k, bits, {_HEX.format(1)} AS h1, {_HEX.format(9)} AS h2, hashes FROM probe, y),
  pp AS (SELECT segment_id, k, (h1 + i * h2) % bits AS at FROM (SELECT *, unnest(range(0, hashes)) AS i FROM pr)),
  r AS (SELECT pp.segment_id, pp.k, bool_and(f.at IS NOT NULL) AS maybe FROM pp LEFT JOIN f ON pp.segment_id = f.segment_id AND pp.at = f.at GROUP BY pp.segment_id, pp.k)
  SELECT segment_id, count(*) AS probes, CAST(sum(CASE WHEN maybe THEN 1 ELSE 0 END) AS BIGINT) AS false_positives FROM r GROUP BY segment_id""")
def bloom_fpr(spark, d):
    """Keys that no segment holds, and how many each filter lets through."""
    # By segment at once: distinct keys, sizes and filters need no further exchange of all rows.
    keys = with_segment(events_versions(spark, d)).select("segment_id", "key")
    own = keys.repartition("segment_id").distinct()
    sized = bloom.sizes(own.groupBy("segment_id").agg(F.count("*").alias("n")))
    filters = bloom.build(own.join(sized, "segment_id"), "segment_id")
    absent = keys.select(F.concat(K.key_column(F.lit("absent-")), "key").alias("key")).distinct()
    found = bloom.hits(absent, filters, sized, "segment_id")
    return found.crossJoin(absent.agg(F.count("key").alias("probes"))).select("segment_id", "probes", F.col("hits").alias("false_positives"))


@query("SELECT key, count(*) AS versions, CAST(sum(strlen(key) + 16 + coalesce(strlen(value), 0)) AS BIGINT) AS bytes, max(seq) AS newest FROM log GROUP BY key")
def versions_per_key(spark, d):
    rows = events_versions(spark, d).withColumn("b", K.entry_bytes())
    return rows.groupBy("key").agg(F.count("*").alias("versions"), F.sum("b").alias("bytes"), F.max("seq").alias("newest")).withColumn("key", K.shown("key"))


@query("""SELECT key, count(*) AS ops, CAST(sum(CASE WHEN op = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS puts, arg_max(op, seq) AS last_op FROM log
  GROUP BY key ORDER BY ops DESC, key LIMIT 10""")
def hot_key_contention(spark, d):
    """The ten keys with the most operations, and what became of each."""
    top = events_log(spark, d).groupBy("key").agg(F.count("*").alias("ops"), F.sum((F.col("op") == "P").cast("bigint")).alias("puts"), F.max_by("op", "seq").alias("last_op"))
    return top.orderBy(F.desc("ops"), "key").limit(10).withColumn("key", K.shown("key"))


@query(f""", cart AS (SELECT *, CASE WHEN seq % 10 = 0 THEN 'D' ELSE op END AS op2 FROM v),
  c AS (SELECT * FROM cart QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)
  SELECT key, value, seq, expires_at_ms FROM c WHERE op2 = 'P' AND NOT (expires_at_ms > 0 AND {NOW_MS} > expires_at_ms)""")
def ecommerce_replay(spark, d):
    """The log with every tenth operation a delete, as carts are emptied."""
    log = events_log(spark, d)
    emptied = F.col("seq") % 10 == 0
    log = log.withColumn("op", F.when(emptied, "D").otherwise(F.col("op")))
    return rows_out(merge.visible(merge.versions(log), NOW_MS))


SQL["latest_by_customer"] = """SELECT 'customer-' || lpad(CAST(o_custkey AS VARCHAR), greatest(9, CAST(length(CAST(o_custkey AS VARCHAR)) AS INTEGER)), '0') AS key, arg_max(o_orderstatus, o_orderkey) AS value, max(o_orderkey) AS seq,
  CAST(0 AS BIGINT) AS expires_at_ms FROM orders GROUP BY o_custkey"""


@query(None)
def latest_by_customer(spark, d):
    """A second, larger log without deletes."""
    return rows_out(merge.visible(merge.versions(orders_log(spark, d)), NOW_MS))


@query(STATE)
def stream_upsert_state(spark, d):
    """The log as a stream: versions kept in Spark's state store, then judged as any other."""
    run = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events_log(spark, d).write.parquet(f"{run}/log")
    schema = spark.read.parquet(f"{run}/log").schema
    out = f"{run}/versions"

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("append").parquet(out)

    state = latest_state(spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{run}/log"))
    query_ = state.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", f"{run}/offsets").trigger(availableNow=True).start()
    query_.awaitTermination()
    return rows_out(merge.visible(spark.read.schema(VERSION).parquet(out), NOW_MS))


def _store(spark, d, parts: int = 1, **config) -> KVStore:
    """A new store on disk, with all events logged in so many batches."""
    store = KVStore(spark, StoreConfig(data_directory=f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", **config))
    for rows in _parts(spark, d, parts):
        store.append(rows, order_by=["seq"])
    return store


def _all_segments(store: KVStore) -> list[int]:
    return [s.segment_id for s in store.manifest.current().segments]


STORED = STATE.replace("seq, ", "")


@query(STORED)
def store_round_trip(spark, d):
    """The log in four batches through a store on disk: logged, flushed, compacted, and read back with a tail."""
    store = _store(spark, d, 0)
    for number, rows in enumerate(_parts(spark, d, 4)):
        store.append(rows, order_by=["seq"])
        if number < 3:
            store.flush(NOW_MS)
        if number == 1:
            store.compact(_all_segments(store), NOW_MS)
    return rows_out(store.scan(now_ms=NOW_MS)).drop("seq")


@query(STORED)
def store_snapshot_scan(spark, d):
    """A scan that is opened before a flush, a compaction and a clear, and read after them."""
    store = _store(spark, d, 2)
    opened = store.scan(now_ms=NOW_MS)
    store.flush(NOW_MS)
    store.compact(_all_segments(store), NOW_MS)
    store.clear()
    store.vacuum()
    return rows_out(opened).drop("seq")


@query(STORED)
def store_crash_recovery(spark, d):
    """A store left without a flush, opened again."""
    return rows_out(KVStore(spark, _store(spark, d, 2).root).scan(now_ms=NOW_MS)).drop("seq")


@query("SELECT op, count(*) AS records FROM log GROUP BY op HAVING false")
def store_clear(spark, d):
    """What is left of a store that was cleared, and then maintained and opened again: nothing."""
    store = _store(spark, d, 2)
    store.flush(NOW_MS)
    store.clear()
    store.maintain(NOW_MS)
    rows = KVStore(spark, store.root).rows()
    return rows.groupBy(F.when(F.col("tombstone"), "D").otherwise("P").alias("op")).agg(F.count("*").alias("records"))


@query(f"""SELECT step, answer FROM (VALUES (1, 'SUCCESS'), (2, 'one'), (3, 'INVALID_INPUT'), (4, 'INVALID_INPUT'), (5, 'INVALID_INPUT'), (6, 'KEY_NOT_FOUND'), (7, 'SUCCESS'),
  (8, NULL), (9, 'KEY_NOT_FOUND'), (10, 'SUCCESS'), (11, 'timed'), (12, NULL), (13, 'true'), (14, 'false'), (15, ''), (16, 'MEMTABLE_FULL')) AS t(step, answer)""")
def store_single_key_calls(spark, d):
    """put, get, delete and containsKey, one key at a time, with their status."""
    store = _store(spark, d, 0, mem_table_max_size_bytes=1000)
    text = lambda b: None if b is None else b.decode()
    answers = [
        store.put_status("key", "one", now_ms=NOW_MS).value, text(store.get("key", NOW_MS)), store.put_status(None, "v").value, store.put_status("", "v").value,
        store.put_status("key", None).value, store.delete_status("absent", NOW_MS).value, store.delete_status("key", NOW_MS).value, text(store.get("key", NOW_MS)),
        store.delete_status("key", NOW_MS).value, store.put_status("t", "timed", 1, NOW_MS).value, text(store.get("t", NOW_MS + 1000)), text(store.get("t", NOW_MS + 1001)),
        str(store.contains_key("t", NOW_MS)).lower(), str(store.contains_key("key", NOW_MS)).lower(),
        text(store.get("e", NOW_MS)) if store.put("e", "", now_ms=NOW_MS) else "refused", store.put_status("large", "x" * 1000, now_ms=NOW_MS).value,
    ]
    return spark.createDataFrame(list(enumerate(answers, 1)), "step int, answer string")


@query("SELECT key, value, row_number() OVER (ORDER BY key) AS position, lead(key) OVER (ORDER BY key) AS peeked FROM vis WHERE key >= 'user-00003' AND key < 'user-00006'")
def iterator_ordered(spark, d):
    """A key range of a store through its iterator, with what a peek shows after each step."""
    it, out = _store(spark, d).iterator("user-00003", "user-00006", NOW_MS), []
    while it.has_next():
        key, value = next(it)
        peeked = it.peek()
        out.append((key.decode(), value.decode(), len(out) + 1, peeked and peeked.decode()))
    return spark.createDataFrame(out, "key string, value string, position bigint, peeked string")


@query("SELECT CAST(sum(n) AS BIGINT) AS size FROM (SELECT count(DISTINCT key) AS n FROM log GROUP BY seq // ((SELECT max(seq) FROM log) // 3 + 1))")
def size_approx(spark, d):
    """Entries over the runs of a store, overwritten ones too."""
    store = _store(spark, d, 0)
    for rows in _parts(spark, d, 3):
        store.append(rows, order_by=["seq"])
        store.flush(NOW_MS)
    return spark.createDataFrame([(store.size_approx(),)], "size bigint")


@query("SELECT key, NOT gone AS live FROM s WHERE op = 'P' AND expires_at_ms > 0")
def ttl_after_flush_and_compaction(spark, d):
    """Keys whose newest version expires, looked up in a store that has flushed and compacted them."""
    store = _store(spark, d, 0)
    for rows in _parts(spark, d, 2):
        store.append(rows, order_by=["seq"])
        store.flush(NOW_MS)
    store.compact(_all_segments(store), NOW_MS)
    wanted = merge.latest(events_versions(spark, d)).where("not tombstone and expires_at_ms > 0").select("key")
    return store.contains(wanted, NOW_MS).select(K.shown("key").alias("key"), F.col("present").alias("live"))


@query(f"SELECT key FROM l WHERE op = 'P' AND expires_at_ms > 0 AND {NOW_MS} > expires_at_ms")
def ttl_cleanup(spark, d):
    """The tombstones that a cleanup logs, for keys of a segment and of the log's tail."""
    store = _store(spark, d, 0)
    older, newer = _parts(spark, d, 2)
    store.append(older, order_by=["seq"])
    # Flushed when nothing has expired, so that the cleanup has to find what has since.
    store.flush(0)
    store.append(newer, order_by=["seq"])
    # Any of the three may have flushed itself, so the log's end and the tombstones may be in a segment.
    behind = max([store.manifest.current().flushed_seq, *(b.last for b in store.tail())])
    store.cleanup(NOW_MS)
    return store.rows().where(F.col("tombstone") & (F.col("seq") > behind)).select(K.shown("key").alias("key"))


@query("""SELECT seq // ((SELECT max(seq) FROM log) // 4 + 1) + 1 AS segment_id, count(DISTINCT key) AS entries, min(key) AS min_key, max(key) AS max_key FROM log GROUP BY 1""")
def flush_by_size(spark, d):
    """Four batches, each over the size of a memory table, so each flushes itself."""
    store = _store(spark, d, 4, mem_table_max_size_bytes=4096)
    made = [(s.segment_id, s.entry_count, bytes.fromhex(s.min_key).decode(), bytes.fromhex(s.max_key).decode()) for s in store.manifest.current().segments]
    return spark.createDataFrame(made, "segment_id bigint, entries bigint, min_key string, max_key string")


@query("SELECT DISTINCT key, false AS present FROM log WHERE key IN (SELECT key FROM vis)")
def delete_batch(spark, d):
    """All live keys deleted at once, half of them in a segment, and then looked for."""
    store = _store(spark, d, 2)
    live = reads.list_keys(events_versions(spark, d), NOW_MS)
    store.flush(NOW_MS)
    store.delete_batch(live, NOW_MS)
    return store.contains(live, NOW_MS).select(K.shown("key").alias("key"), "present")


THIRDS = """, t AS (SELECT seq // ((SELECT max(seq) FROM log) // 3 + 1) + 1 AS segment_id, key FROM log), n AS (SELECT segment_id, count(DISTINCT key) AS n FROM t GROUP BY segment_id),
  z AS (SELECT segment_id, n, """ + _BITS + """ AS bits FROM n), y AS (SELECT *, greatest(1, CAST(floor(bits / greatest(n, 1) * ln(2) + 0.5) AS BIGINT)) AS hashes FROM z),
  pos AS (SELECT DISTINCT segment_id, key AS k, bits, hashes FROM t JOIN y USING (segment_id)),
  f AS (SELECT DISTINCT segment_id, (""" + _HEX.format(1) + " + i * " + _HEX.format(9) + """) % bits AS at FROM (SELECT *, unnest(range(0, hashes)) AS i FROM pos))"""


def _thirds(spark, d) -> KVStore:
    """A store of three segments, opened again."""
    store = _store(spark, d, 0)
    for rows in _parts(spark, d, 3):
        store.append(rows, order_by=["seq"])
        store.flush(NOW_MS)
    return KVStore(spark, store.root)


@query(THIRDS + " SELECT segment_id, f.at AS bit FROM f")
def store_bloom_saved(spark, d):
    """The bits of the filters saved beside a store's segments, as loaded by one that opens it."""
    store = _thirds(spark, d)
    bits = [(s.segment_id, bit) for s in store.manifest.current().segments for bit in store.bloom(s).set_bits()]
    return spark.createDataFrame(bits, "segment_id bigint, bit bigint")


PROBED = f"(SELECT p.key AS k FROM {PROBES_SQL} WHERE p.key <> '' UNION SELECT min(key) || '-absent' FROM vis UNION SELECT max(key) FROM vis)"


@query(THIRDS + f""", b AS (SELECT segment_id, min(key) AS lo, max(key) AS hi FROM t GROUP BY segment_id),
  pr AS (SELECT segment_id, k, bits, hashes FROM {PROBED}, y), pp AS (SELECT segment_id, k, ({_HEX.format(1)} + i * {_HEX.format(9)}) % bits AS at FROM (SELECT *, unnest(range(0, hashes)) AS i FROM pr)),
  r AS (SELECT pp.segment_id, k, bool_and(f.at IS NOT NULL) AS maybe FROM pp LEFT JOIN f ON pp.segment_id = f.segment_id AND pp.at = f.at GROUP BY ALL)
  SELECT k AS key, segment_id FROM r JOIN b USING (segment_id) WHERE maybe AND k BETWEEN lo AND hi""")
def store_bloom_prunes(spark, d):
    """The segments that a point read of a key opens, by their bounds and filters."""
    store = _thirds(spark, d)
    ends = reads.list_keys(events_versions(spark, d), NOW_MS).agg(F.min("key").alias("lo"), F.max("key").alias("hi")).first()
    probes = {k.encode() for k in PROBES if k} | {bytes(ends["lo"]) + b"-absent", bytes(ends["hi"])}
    return spark.createDataFrame([(k.decode(), s.segment_id) for k in probes for s in store.candidates(k)], "key string, segment_id bigint")


@query(f""", e AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts_ms DESC, seq DESC) = 1)
  SELECT key, value, seq, expires_at_ms FROM e WHERE op = 'P' AND NOT (expires_at_ms > 0 AND {NOW_MS} > expires_at_ms)""")
def latest_by_event_time(spark, d):
    """The state if the time of writing decides which version is the newest, not the order of arrival."""
    newest = merge.latest(merge.versions(events_log(spark, d), "ts_ms"), ("ts_ms", "seq"))
    return rows_out(merge.live(newest, NOW_MS))


@query("SELECT key, value, op = 'D' AS tombstone, expires_at_ms FROM l WHERE key >= 'user-00002' AND key < 'user-00009'")
def entries_with_tombstones(spark, d):
    """The newest entries of a key range of a store, deleted ones too; the second half is in the log."""
    store = _store(spark, d, 0)
    older, newer = _parts(spark, d, 2)
    store.append(older, order_by=["seq"])
    store.flush(0)
    store.append(newer, order_by=["seq"])
    rows = store.entries("user-00002", "user-00009")
    return rows.select(K.shown("key").alias("key"), K.shown("value").alias("value"), "tombstone", "expires_at_ms")


SQL["store_ingest"] = """SELECT 'order/' || CAST(o_orderkey AS VARCHAR) AS key, CAST(o_custkey AS VARCHAR) || '|' || o_orderstatus AS value FROM orders"""


@query(None)
def store_ingest(spark, d):
    """A table of another shape put into a store, half of it flushed."""
    store, orders = _store(spark, d, 0), spark.read.parquet(f"{d}/orders.parquet")
    for odd in (0, 1):
        store.ingest(orders.where(F.col("o_orderkey") % 2 == odd), "concat('order/', o_orderkey)", "concat(o_custkey, '|', o_orderstatus)", now_ms=NOW_MS)
        if not odd:
            store.flush(NOW_MS)
    return store.scan(now_ms=NOW_MS).select(K.shown("key").alias("key"), K.shown("value").alias("value"))


@query("""SELECT 'put' AS call, key, CASE WHEN value IS NULL THEN 'INVALID_INPUT' WHEN strlen(key) + 16 + strlen(value) > 36 THEN 'MEMTABLE_FULL' ELSE 'SUCCESS' END AS status, count(*) AS rows FROM log GROUP BY ALL
  UNION ALL SELECT 'delete', key, CASE WHEN bool_or(strlen(key) + 16 + strlen(value) <= 36) THEN 'SUCCESS' ELSE 'KEY_NOT_FOUND' END, 1 FROM log GROUP BY key
  UNION ALL SELECT 'delete', '', 'INVALID_INPUT', 1""")
def batch_statuses(spark, d):
    """What becomes of each row of a batch put, with null and oversize values, and of a batch delete of all its keys."""
    store = _store(spark, d, 0, mem_table_max_size_bytes=36)
    put = store.put_batch_status(events_log(spark, d).select("key", "value"), now_ms=NOW_MS)
    wanted = events_log(spark, d).select("key").distinct().union(spark.createDataFrame([(bytearray(),)], "key binary"))
    deleted = store.delete_batch_status(wanted, NOW_MS)
    both = put.select(F.lit("put").alias("call"), "key", "status").union(deleted.select(F.lit("delete"), "key", "status"))
    return both.groupBy("call", K.shown("key").alias("key"), "status").agg(F.count("*").alias("rows"))
