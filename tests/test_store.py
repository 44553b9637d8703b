"""The store on disk: the reference behaviours, and a random walk against a plain model with an explicit clock."""

import random

import pytest
from pyspark.sql import functions as F

from kvlake import KVStore, StoreConfig
from kvlake.config import CompactionStrategy
from kvlake.functions import keys as K
from kvlake.operators import bloom, merge, reads
from kvlake.operators.compaction import may_drop_tombstones
from kvlake.operators.planning import SegmentInfo, SizeTieredPlanner, ThresholdPlanner
from kvlake.plans import catalogue
from kvlake.sources.manifest import Conflict, Manifest
from kvlake.sources.wal import WriteAheadLog
from kvlake.store import Status

NOW = 1_000_000


@pytest.fixture
def store(spark, tmp_path):
    return KVStore(spark, str(tmp_path / "data"))


def state(store, now=NOW, start=None, end=None):
    return {bytes(r["key"]): bytes(r["value"]) for r in store.scan(start, end, now).collect()}


def keys(spark, *ks):
    return spark.createDataFrame([(None if k is None else bytearray(k),) for k in ks], "key binary")


def test_put_get_delete_and_refusals(store):
    assert store.put("k", "v", now_ms=NOW) and store.get("k", NOW) == b"v"
    assert store.put_status(None, "v") is store.put_status("", "v") is store.put_status("k", None) is Status.INVALID_INPUT
    assert store.get("absent", NOW) is None and store.get("", NOW) is None and store.get(None, NOW) is None
    assert store.contains_key("k", NOW) and not store.contains_key("x", NOW)
    assert store.delete("k", NOW) and store.get("k", NOW) is None
    assert store.delete_status("k", NOW) is Status.KEY_NOT_FOUND and store.delete_status("") is Status.INVALID_INPUT
    assert store.put("empty", "", now_ms=NOW) and store.get("empty", NOW) == b""


def test_expiry_is_strict_and_survives_flush_and_compaction(store):
    store.put("a", "old", now_ms=NOW)
    store.flush(NOW)
    store.put("a", "new", ttl_seconds=1, now_ms=NOW)
    for step in (lambda: None, lambda: store.flush(NOW), lambda: store.compact([s.segment_id for s in store.manifest.current().segments], NOW)):
        step()
        assert store.get("a", NOW + 1000) == b"new" and store.get("a", NOW + 1001) is None
    # An expired newest version flushed late still hides the older one.
    store.clear()
    store.put("b", "old", now_ms=NOW)
    store.flush(NOW)
    store.put("b", "new", ttl_seconds=1, now_ms=NOW)
    store.flush(NOW + 5000)
    assert store.get("b", NOW + 5000) is None


def test_batches_tell_what_became_of_each_row(spark, tmp_path, monkeypatch):
    store = KVStore(spark, StoreConfig(data_directory=str(tmp_path / "d"), mem_table_max_size_bytes=40))
    rows = spark.createDataFrame([(1, b"a", b"1"), (2, b"b", None), (3, None, b"3"), (4, b"", b"4"), (5, b"big", b"x" * 40), (6, b"a", b"2")], "n int, key binary, value binary")
    told = {r["n"]: r["status"] for r in store.put_batch_status(rows, now_ms=NOW, order_by=["n"]).collect()}
    assert told == {1: "SUCCESS", 2: "INVALID_INPUT", 3: "INVALID_INPUT", 4: "INVALID_INPUT", 5: "MEMTABLE_FULL", 6: "SUCCESS"} and state(store) == {b"a": b"2"}
    gone = store.delete_batch_status(keys(spark, b"a", b"a", b"big", None, b""), NOW)
    assert sorted(r["status"] for r in gone.collect()) == ["INVALID_INPUT", "INVALID_INPUT", "KEY_NOT_FOUND", "SUCCESS", "SUCCESS"] and state(store) == {}
    assert [(bytes(r["key"]), r["tombstone"]) for r in store.entries("a", "b").collect()] == [(b"a", True)]
    monkeypatch.setattr(store.log, "append", lambda *a, **k: (_ for _ in ()).throw(OSError("full")))
    assert {r["status"] for r in store.put_batch_status(rows.where("n = 1")).collect()} == {"WAL_ERROR"} and isinstance(store.last_error, OSError)


def test_ingest_takes_rows_of_any_shape(spark, store):
    rows = spark.createDataFrame([(1, "x", "old"), (2, "x", "new"), (3, None, "lost")], "seq int, key string, value string")
    assert store.ingest(rows, "concat('k/', key)", F.upper("value"), now_ms=NOW, order_by=["seq"]) == 2
    assert state(store) == {b"k/x": b"NEW"}


def test_ranges_iterator_and_counts(store, spark):
    rows = spark.createDataFrame([(f"key{i}".encode(), f"v{i}".encode()) for i in range(1, 6)], "key binary, value binary")
    assert store.put_batch(rows, now_ms=NOW) == 5
    for (a, b), n in {(None, None): 5, ("key2", "key5"): 3, ("key3", None): 3, (None, "key3"): 2, ("key5", "key1"): 0}.items():
        assert len(state(store, NOW, a, b)) == n
    it = store.iterator("key2", None, NOW)
    assert it.peek() == b"key2" and next(it) == (b"key2", b"v2") and [k for k, _ in it] == [b"key3", b"key4", b"key5"]
    assert not it.has_next() and it.peek() is None
    with pytest.raises(StopIteration):
        next(it)
    store.flush(NOW)
    store.put("key1", "again", now_ms=NOW)
    assert store.size(NOW) == 5 and store.size_approx() == 6 and store.segments_count() == 1
    got = {r["key"] and bytes(r["key"]): r["status"] for r in store.multi_get(keys(spark, b"key1", b"no", b"", None), NOW).collect()}
    assert got == {b"key1": "SUCCESS", b"no": "KEY_NOT_FOUND", b"": "INVALID_INPUT", None: "INVALID_INPUT"}
    assert store.delete_batch(keys(spark, b"key1", b"no", None), NOW) == 1 and store.size(NOW) == 4
    store.clear()
    assert store.size(NOW) == 0 and store.list_keys(NOW).count() == 0 and store.flush(NOW) is None


def test_byte_order_prefixes_and_large_values(store, spark):
    raw = [b"\x7f", b"\x7f\x00", b"\x80", b"\xff", b"\xff\xff", b"a", b"a\x00"]
    store.put_batch(spark.createDataFrame([(k, b"x" * 5000) for k in raw], "key binary, value binary"), now_ms=NOW)
    assert [k for k, _ in store.iterator(now_ms=NOW)] == sorted(raw)
    assert K.prefix_end(b"\xff\xff") is None and K.prefix_end(b"a\xff") == b"b"
    assert {bytes(r["key"]) for r in store.prefix(b"\xff", NOW).collect()} == {b"\xff", b"\xff\xff"}
    assert {bytes(r["key"]) for r in store.prefix(b"\x7f", NOW).collect()} == {b"\x7f", b"\x7f\x00"}


def test_restart_and_crash_lose_nothing(store, spark):
    store.put("a", "1", now_ms=NOW)
    store.flush(NOW)
    store.put("b", "2", now_ms=NOW)
    again = KVStore(spark, store.root)
    assert state(again) == {b"a": b"1", b"b": b"2"}
    again.close(NOW)
    assert state(KVStore(spark, store.root)) == {b"a": b"1", b"b": b"2"} and not again.tail()
    again.put("a", "3", now_ms=NOW)
    assert KVStore(spark, store.root).get("a", NOW) == b"3"


def test_random_walk_against_a_model(spark, tmp_path):
    r = random.Random(12)
    store = KVStore(spark, StoreConfig(data_directory=str(tmp_path / "walk"), compaction_threshold=3))
    model, now = {}, NOW
    for step in range(14):
        now += r.randint(0, 1500)
        ops = []
        for _ in range(r.randint(1, 12)):
            key, ttl = f"k{r.randint(0, 15)}".encode(), r.choice([0, 0, 1, 3])
            if r.random() < 0.3:
                ops.append(("D", key, None, 0, now))
                model.pop(key, None)
            else:
                value = str(r.random()).encode()
                ops.append(("P", key, value, ttl, now))
                model[key] = (value, now + ttl * 1000 if ttl else None)
        store.append(spark.createDataFrame([(i, *o) for i, o in enumerate(ops)], "i int, op string, key binary, value binary, ttl_seconds bigint, ts_ms bigint"), order_by=["i"])
        action = r.choice(["flush", "flush", "compact", "part", "restart", "none"])
        live = [s.segment_id for s in store.manifest.current().segments]
        if action == "flush":
            store.flush(now)
        elif action == "compact":
            store.maintain(now)
        elif action == "part" and len(live) > 1:
            store.compact(sorted(r.sample(live, 2)), now)
        elif action == "restart":
            store = KVStore(spark, store.config)
        want = {k: v for k, (v, e) in model.items() if e is None or now <= e}
        assert state(store, now) == want, (step, action)
        assert state(store, now, "k1", "k3") == {k: v for k, v in want.items() if b"k1" <= k < b"k3"}


def test_log_batches_tokens_and_truncation(spark, tmp_path):
    log = WriteAheadLog(spark, str(tmp_path))
    ops = spark.createDataFrame([(i, "P" if i % 3 else "D", f"k{i}".encode(), None if i % 3 == 0 else b"v", 0, NOW) for i in range(30)], "i int, op string, key binary, value binary, ttl_seconds bigint, ts_ms bigint").repartition(4)
    first = log.append(ops, -1, ["i"], "s.0")
    assert (first.first, first.last) == (0, 29) and log.append(ops, -1, ["i"], "s.0") is None
    assert [bytes(r["key"]).decode() for r in log.read().orderBy("seq").collect()] == [f"k{i}" for i in range(30)]
    second = log.append(ops.limit(3), -1)
    assert second.first == 30 and log.read(29).count() == 3
    log.truncate(29)
    assert [b.first for b in log.batches()] == [30] and log.append(ops.limit(0), -1) is None
    bad = spark.createDataFrame([("X", b"k", b"v", 0, NOW)], "op string, key binary, value binary, ttl_seconds bigint, ts_ms bigint")
    log.append(bad, -1)
    with pytest.raises(Exception, match="unknown operation"):
        log.checked().collect()


def test_manifest_refuses_a_second_writer(spark, tmp_path):
    a = Manifest(spark, str(tmp_path))
    v = a.current()
    a.commit(v, flushed_seq=5)
    with pytest.raises(Conflict):
        a.commit(v, flushed_seq=6)
    assert a.current().flushed_seq == 5


def test_partial_compaction_keeps_what_hides_older_rows(store):
    store.put("k", "old", now_ms=NOW)
    store.flush(NOW)
    store.delete("k", NOW)
    store.flush(NOW)
    store.put("other", "x", now_ms=NOW)
    store.flush(NOW)
    ids = [s.segment_id for s in store.manifest.current().segments]
    store.compact(ids[1:], NOW)
    assert store.get("k", NOW) is None and store.size(NOW) == 1
    made = store.compact([s.segment_id for s in store.manifest.current().segments], NOW)
    assert made.tombstones == 0 and made.entry_count == 1 and store.get("k", NOW) is None
    assert may_drop_tombstones([], [])


def test_planners():
    def seg(i, size, level=0):
        return SegmentInfo(i, level, size)

    st = SizeTieredPlanner()
    assert not st.should_compact([seg(i, 100) for i in range(3)]) and st.select([seg(i, 100) for i in range(3)]) == []
    assert len(st.select([seg(i, 100) for i in range(5)])) == 5
    assert [s.segment_id for s in st.select([*(seg(i, 1000) for i in range(4)), *(seg(10 + i, 10_000) for i in range(5))])] == [10, 11, 12, 13, 14]
    assert len(st.select([seg(i, 100) for i in range(40)])) == 32
    assert st.output_level([seg(0, 1)] * 5) == 1 and st.output_level([seg(0, 1), seg(1, 1), seg(2, 1, 1)]) == 2 and st.output_level([]) == 0
    th = ThresholdPlanner()
    assert th.should_compact([seg(i, 1) for i in range(4)]) and not th.should_compact([seg(0, 1)])
    assert [s.segment_id for s in th.select([seg(0, 1, 1), seg(1, 1, 1), seg(2, 1), seg(3, 1)])] == [2, 3]
    assert th.select([seg(0, 1), seg(1, 1, 1)]) == [] and th.output_level([seg(0, 1, 2)]) == 3 and th.output_level([]) == 0


def test_configuration():
    c = StoreConfig()
    assert (c.mem_table_max_size_bytes, c.data_directory, c.compaction_threshold, c.compaction_strategy) == (10 * 1024 * 1024, "./data", 4, CompactionStrategy.THRESHOLD)
    assert c.replace(compaction_threshold=2).compaction_threshold == 2
    for bad in ({"compaction_threshold": 0}, {"data_directory": ""}, {"flush_interval_seconds": -1}, {"compaction_strategy": None}):
        with pytest.raises(ValueError):
            StoreConfig(**bad)


def test_bloom_contract(spark):
    bits, hashes = bloom.bits_and_hashes(100)
    assert bits % 8 == 0 and bits >= 958 and hashes == 7 and bloom.bits_and_hashes(0)[0] == 8
    own = spark.createDataFrame([(1, f"k{i}".encode(), bits, hashes) for i in range(100)], "s int, key binary, bits bigint, hashes bigint")
    probes = spark.createDataFrame([(1, f"x{i}".encode(), bits, hashes) for i in range(1000)] + [(1, None, bits, hashes)], "s int, key binary, bits bigint, hashes bigint")
    filters = bloom.build(own, "s")
    assert bloom.might_contain(own, filters, "s").where("not maybe").count() == 0
    assert bloom.might_contain(probes, filters, "s").where("maybe").count() < 50


def test_bloom_hits_of_every_key_in_every_filter(spark, monkeypatch):
    """Filters of equal and of other sizes, in several blocks and chunks; a null key, a filter without bits, no keys at all."""
    monkeypatch.setattr(bloom, "BLOCK_FILTERS", 8)
    own = spark.range(3000).select((F.col("id") % 30).alias("s"), F.concat(F.lit("k"), F.col("id").cast("string")).cast("binary").alias("key"))
    own = own.where("s < 20 or key < 'k2'")
    sized = bloom.sizes(own.groupBy("s").agg(F.count("*").alias("n")), error=0.2).cache()
    filters = bloom.build(own.join(sized, "s"), "s")
    sized = sized.union(spark.createDataFrame([(99, 0, 8, 1)], "s bigint, n bigint, bits bigint, hashes bigint"))
    probes = spark.range(500, 40_000, numPartitions=1).select(F.concat(F.lit("k"), F.col("id").cast("string")).cast("binary").alias("key")).union(keys(spark, None))
    pairs = bloom.might_contain(probes.crossJoin(sized), filters, "s").groupBy("s").agg(F.sum(F.col("maybe").cast("bigint")).alias("hits"))
    got = {r["s"]: r["hits"] for r in bloom.hits(probes, filters, sized, "s").collect()}
    assert got == {r["s"]: r["hits"] for r in pairs.collect()} and len(got) == 31 and got[99] == 0 < got[0] < 39_500
    assert {r["hits"] for r in bloom.hits(probes.where("false"), filters, sized, "s").collect()} == {0}


def test_bloom_fpr_shuffles_no_row_per_key_and_segment(spark):
    """100 segments and 10,500 absent keys, with no join small enough to be broadcast."""
    def written():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    kept, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), written()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = catalogue.QUERIES["bloom_fpr"](spark, "/root/testdata/sf0.1").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert len(got) == 100 and all(0 < r["false_positives"] < 0.02 * r["probes"] for r in got)
    assert written() - before < sum(r["probes"] for r in got) / 2


def test_point_reads_open_only_segments_whose_filter_holds_the_key(spark, store, monkeypatch):
    for part in range(3):
        store.put_batch(keys(spark, b"a", *(b"%d-%d" % (part, i) for i in range(50)), b"z").withColumn("value", F.col("key")), now_ms=NOW)
        store.flush(NOW)
    opened = KVStore(spark, store.root)
    ids = [s.segment_id for s in opened.manifest.current().segments]
    assert [s.segment_id for s in opened.candidates("a")] == ids and opened.candidates("b-absent") == []
    assert [s.segment_id for s in opened.candidates("1-7")] == ids[1:2]
    assert opened.get("1-7", NOW) == b"1-7" and opened.get("b-absent", NOW) is None
    saved = opened.bloom(opened.manifest.current().segments[0])
    assert bloom.Filter.from_json(saved.to_json()) == saved and len(saved.set_bits()) > 50
    # A segment with too many keys for a filter at the driver has none, and is read as before.
    monkeypatch.setattr("kvlake.sources.segments.BLOOM_KEYS", 10)
    made = store.compact(ids, NOW)
    assert made.bloom is None and KVStore(spark, store.root).get("2-3", NOW) == b"2-3"
    store.vacuum(0, 2**60)
    assert KVStore(spark, store.root).get("1-7", NOW) == b"1-7"


def test_filters_reach_the_scan(spark, tmp_path):
    rows = spark.range(100).select(K.key_column(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("key"), F.lit(b"v").alias("value"), F.lit(0).cast("bigint").alias("expires_at_ms"), F.lit(False).alias("tombstone"), F.col("id").alias("seq"))
    rows.write.parquet(str(tmp_path / "s"))
    df = spark.read.parquet(str(tmp_path / "s"))
    plan = reads.point_get(df, "k5", NOW)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key" in plan or "PushedFilters: [IsNotNull(key), EqualTo" in plan
    plan = reads.list_keys(df, NOW)._jdf.queryExecution().executedPlan().toString()
    assert "value" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert "WindowGroupLimit" in merge.latest(df)._jdf.queryExecution().executedPlan().toString()


def test_stream_into_store_is_logged_once(spark, tmp_path):
    from kvlake.streaming.ingest import into_store

    ops = spark.createDataFrame([(i, "P" if i % 5 else "D", f"k{i % 7}".encode(), b"v%d" % i if i % 5 else None, 0, NOW) for i in range(60)], "i int, op string, key binary, value binary, ttl_seconds bigint, ts_ms bigint")
    for part in range(3):
        ops.where((F.col("i") >= part * 20) & (F.col("i") < part * 20 + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = KVStore(spark, str(tmp_path / "store"))
    for _ in range(2):
        stream = spark.readStream.schema(ops.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        into_store(stream, store, str(tmp_path / "offsets"), flush_every=2, order_by=["i"]).awaitTermination()
        last = {f"k{i % 7}".encode(): (b"v%d" % i if i % 5 else None) for i in range(60)}
        assert state(store) == {k: v for k, v in last.items() if v is not None}
    assert store.append(ops, ["i"], ("ops", 0)) == 0


def test_two_writers_that_saw_the_same_log_lose_nothing(spark, tmp_path):
    """Equal and unequal numbers of rows; both list the log before either claims."""
    import threading

    for sizes in ((5, 5), (3, 7)):
        root, met, got = str(tmp_path / f"w{sizes[0]}"), threading.Barrier(2), {}

        def write(w, n, root=root, met=met, got=got):
            waits = iter([lambda: met.wait(60)])
            ops = spark.createDataFrame([("P", f"w{w}-{i}".encode(), b"v", 0, NOW) for i in range(n)], "op string, key binary, value binary, ttl_seconds bigint, ts_ms bigint")
            got[w] = WriteAheadLog(spark, root).append(ops, -1, claim=lambda: next(waits, lambda: None)())

        threads = [threading.Thread(target=write, args=(w, n)) for w, n in enumerate(sizes)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        rows = WriteAheadLog(spark, root).read().collect()
        assert sorted(bytes(r["key"]).decode() for r in rows) == sorted(f"w{w}-{i}" for w, n in enumerate(sizes) for i in range(n))
        assert sorted(r["seq"] for r in rows) == list(range(sum(sizes)))
        assert sorted((b.first, b.last) for b in got.values())[0][1] + 1 == max(b.first for b in got.values())


def test_a_number_that_was_flushed_meanwhile_is_not_claimed(spark, tmp_path):
    log = WriteAheadLog(spark, str(tmp_path))
    ops = spark.createDataFrame([("P", b"k", b"v", 0, NOW)], "op string, key binary, value binary, ttl_seconds bigint, ts_ms bigint")
    floors = iter([-1, 4])
    assert log.append(ops, lambda: next(floors, 4)).first == 5


def test_manifest_versions_are_made_by_one_writer(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from kvlake.sources.filesystem import Files

    files, target = Files(spark, str(tmp_path)), str(tmp_path / "v1.json")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: files.create(target, str(i)), range(16)))
    assert won.count(True) == 1 and files.read(target) == str(won.index(True)) and files.names(str(tmp_path)) == ["v1.json"]


def test_open_readers_survive_maintenance_until_vacuum(store):
    for i in range(3):
        store.put(f"k{i}", "v", now_ms=NOW)
        store.flush(NOW)
    store.put("k3", "v", now_ms=NOW)
    opened, it = store.scan(now_ms=NOW), store.iterator(now_ms=NOW)
    store.flush(NOW)
    store.compact([s.segment_id for s in store.manifest.current().segments], NOW)
    store.clear()
    store.maintain(NOW)
    assert opened.count() == 4 and len(list(it)) == 4 and state(store) == {}
    assert store.vacuum(grace_ms=-1000) > 0 and state(store) == {} and not store.log.batches()
    store.put("new", "v", now_ms=NOW)
    assert state(store) == {b"new": b"v"}


def test_flush_by_size_and_oversize(spark, tmp_path):
    store = KVStore(spark, StoreConfig(data_directory=str(tmp_path / "s"), mem_table_max_size_bytes=60))
    assert store.put_status("k", "x" * 58, now_ms=NOW) is Status.MEMTABLE_FULL and store.size(NOW) == 0
    assert store.put("a", "x" * 30, now_ms=NOW) and store.tail_bytes() == 47 and store.segments_count() == 0
    assert store.put("b", "x", now_ms=NOW) and store.segments_count() == 1 and store.tail_bytes() == 0 and store.size(NOW) == 2
    assert store.segment_rows(1).count() == 2 and store.segment_rows(1, "b").count() == 1 and store.tail_rows().count() == 0


def test_cleanup_and_services(store):
    from kvlake.services import Service, services

    store.put("key1", "v", ttl_seconds=1, now_ms=NOW)
    store.put("key2", "v", now_ms=NOW)
    store.flush(NOW)
    assert store.cleanup(NOW + 1000) == 0 and store.cleanup(NOW + 2000) == 1 and store.cleanup(NOW + 2000) == 0
    assert [r["tombstone"] for r in store.tail_rows().collect()] == [True] and state(store) == {b"key2": b"v"}
    made = services(store)
    assert made["flush"].execute_now() and store.segments_count() == 2 and made["compaction"].execute_now() and made["cleanup"].execute_now()
    import threading

    ran = threading.Event()
    s = Service("x", 0.01, lambda: (ran.set(), 1 / 0)).start()
    assert ran.wait(10) and s.shutdown(10) and isinstance(s.last_error, ZeroDivisionError)
