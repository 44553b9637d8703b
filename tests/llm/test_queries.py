"""The base results of the corpus operators against SQL; odd names; long texts full of matches."""

import itertools
import random
import re
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kvlake.llm import decontaminate, license_scan, media_sniff, quality, queries, secret_scan, sharding, simhash, url_filter

D = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda x: None if x is None or x is pd.NA or x != x else int(x) if isinstance(x, float) else x.item() if hasattr(x, "item") else x
    return list(df.columns), sorted(repr(tuple(map(plain, r))) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", ["secret_base_counts", "media_payloads", "license_base_places", "shard_totals"])
def test_base_results_agree_with_sql(spark, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    got = rows(queries.OPERATORS[name](spark, D).toPandas())
    assert got == rows(duck.sql(queries.SQL[name]).df()) and got[1]


def test_suppression_against_all_pairs():
    r = random.Random(4)
    for _ in range(200):
        found = [(p, a, a + r.randint(1, 9), n) for n, (p, a) in enumerate((r.randint(0, 2), r.randint(0, 12)) for _ in range(r.randint(0, 14)))]
        by = {}
        for p, a, b, n in found:
            by.setdefault(p, []).append((a, -b, n, str(n)))

        assert sorted(license_scan.resolved(by)) == sorted((a, b, p, str(n)) for p, a, b, n in found if not any(y[3] != n and y[1] <= a and b <= y[2] and (y[0] > p or (y[0] == p and ((y[1], y[2]) != (a, b) or y[3] < n))) for y in found))


def test_time_grows_with_the_length_alone(spark):
    detector, ratio = license_scan.detector(), []
    for make, run in (
        (lambda n: b"mit license " * n, detector.detect),
        (lambda n: b"%PDF-1. startxref PK\x03\x04 \xff\xd8\xff " * n, media_sniff.sniff),
    ):
        times = []
        for n in (5_000, 40_000):
            start = time.perf_counter()
            run(make(n))
            times.append(time.perf_counter() - start)
        ratio.append(times[1] / times[0])
    assert max(ratio) < 24, ratio  # eight times the length
    long = "https://example.org/" + "a/b-" * 50_000
    pages = spark.createDataFrame([(i, f"https://www.example.com/en/{i}" if i % 2 else f"https://x.net/es/{i}") for i in range(40)] + [(99, long)], "page_id bigint, url string")
    start = time.perf_counter()
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    assert len(got) == 41 and len(got[99]["path"]) == 200_001 and time.perf_counter() - start < 60


def test_url_ratio_against_a_plain_model(spark):
    urls = [("com/a", True), ("com/ab", True), ("net/es", False), ("net/e", False), ("net/e", False)]
    labelled = spark.createDataFrame(urls, "text string, accepted boolean")
    model = url_filter.language_models(labelled)
    got = {(r["k"], r["gram"]): r["ratio"] for r in model.collect()}
    counts = {True: {}, False: {}}
    for text, ok in urls:
        marked = "\x02" * 3 + text + "\x03"
        for i, k in itertools.product(range(3, len(marked)), range(1, 5)):
            g = marked[i - k + 1 : i + 1]
            counts[ok][g] = counts[ok].get(g, 0) + 1
    grams = {g for c in counts.values() for g in c}

    def p(c, g):
        total = sum(n for h, n in c.items() if len(h) == len(g) and h[:-1] == g[:-1])
        below = p(c, g[1:]) if len(g) > 1 else 1 / url_filter.ALPHABET
        return (c.get(g, 0) + url_filter.SMOOTH * below) / (total + url_filter.SMOOTH)

    import math

    assert set(got) == {(len(g), g) for g in grams}
    assert all(abs(got[len(g), g] - math.log(p(counts[True], g) / p(counts[False], g))) < 1e-9 for g in grams)


def test_columns_of_any_name_pass_through(spark, tmp_path):
    texts = ["password: abcdefghijklmnop here", "one two three four five six seven", "one two three four five six seven", None, ""]
    names = ["__th", "__id", "__gone", "__fp", "__row", "__redacted", "__score", "__q_n_bytes", "__leak_words", "__leak_spans", "__share", "shard_"]
    docs = spark.createDataFrame([(i, t, *[f"own{i}"] * len(names)) for i, t in enumerate(texts)], "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names))
    bench = spark.createDataFrame([("a", "one two three")], "item_id string, text string")
    model = quality.Ensemble([], 1.0)
    for out in (
        simhash.keep_one_similar(docs), simhash.keep_one(docs), secret_scan.redact(docs), quality.keep_good(docs, model), decontaminate.remove(docs, bench), decontaminate.remove(docs, bench, mode="documents"),
    ):
        assert out.columns == docs.columns
        kept = out.collect()
        assert kept and all(r[n] == f"own{r['doc_id']}" for r in kept for n in names)
    assert {r["doc_id"] for r in simhash.keep_one_similar(docs).collect()} == {0, 1, 3}
    sharding.write(docs.union(docs), str(tmp_path / "shards"), 3)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 10 and back.groupBy("shard").agg(F.max("slot") + 1 == F.count("*")).where("not `((max(slot) + 1) = count(1))`").isEmpty()


def test_many_benchmark_blocks(spark):
    r = random.Random(5)
    items = [(f"i{k}", " ".join(f"w{r.randrange(400)}" for _ in range(30))) for k in range(60)]
    bench = spark.createDataFrame(items + items, "item_id string, text string")
    docs = spark.createDataFrame([(k, f"x {t} y" if k % 2 else "nothing here") for k, (_, t) in enumerate(items)], "doc_id bigint, text string")
    one, many = (sorted(map(repr, decontaminate.find(docs, bench, block_bytes=b).collect())) for b in (1 << 20, 400))
    assert one == many and sum("leak_items=['i" in x for x in one) == 30


def test_repeated_ids_do_not_swell_the_sample(spark):
    from kvlake.llm.common import labelled_sample

    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "b")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0)], "doc_id bigint, quality int")
    assert sorted(map(tuple, labelled_sample(docs, labels, "quality", F.lit(True), 10).collect())) == [("b", 0), ("text 0", 1)]


def test_repeated_marks_of_any_kind_count():
    at = quality.STATS.index("max_mark_share")
    assert quality.statistics(b"a *** b @@@@ c ~~")[at] == quality.statistics(b"a ### b ==== c ~~")[at] > 0
    assert re.search("mark", quality.STATS[at])
