"""The pipeline over a small table: what each stage decides, and what the next one sees."""

import zlib

import corpus_pipeline
import pytest

from kvlake.llm import common, decontaminate, secret_scan, simhash

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{D}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, docs, D).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        out.append((name, before, docs))
    return out


def test_names(stages):
    assert [n for n, _, _ in stages] == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "secret scans", "packing"]
    columns = stages[0][1].columns
    assert all(after.columns == columns for _, _, after in stages[:-1])


def test_quality_keeps_good_documents(spark, stages):
    _, before, after = stages[0]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in after.collect()}
    known = [r["doc_id"] for r in before.collect() if r["doc_id"] in labels]
    assert sum((k in kept) == bool(labels[k]) for k in known) > 0.9 * len(known)


def test_one_of_each_group_of_similar_texts_stays(stages):
    """Against all pairs of texts: nothing goes that is not similar to a smaller one, and nearly all that is goes."""
    _, before, after = stages[1]
    sets = {r["doc_id"]: set(simhash.shingle_set((r["text"] or "").encode().lower().split())) for r in before.collect()}
    ids = sorted(sets)
    links = [(a, b) for k, b in enumerate(ids) for a in ids[:k] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    kept = {r["doc_id"] for r in after.collect()}
    similar = {b for _, b in links}
    assert set(ids) - kept <= similar
    assert len(similar & kept) <= 0.1 * len(similar)
    assert after.count() == len(kept)


def test_no_benchmark_window_and_no_secret_is_left(spark, stages):
    bench = spark.read.parquet(f"{D}/benchmark.parquet")
    _, before, after = stages[2]
    hit = {r["doc_id"] for r in decontaminate.find(before, bench).collect() if r["leak_spans"]}
    assert hit and not [r for r in decontaminate.find(after, bench).collect() if r["leak_spans"]]
    texts = {r["doc_id"]: r["text"] for r in after.collect()}
    assert all(texts[r["doc_id"]] == r["text"] for r in before.collect() if r["doc_id"] not in hit)
    _, before, after = stages[3]
    assert not [r for r in secret_scan.scan(after).collect() if r["spans"]]
    assert after.count() == before.count()


def test_packing_has_every_token(spark, stages):
    _, before, after = stages[4]
    rows = after.collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in before.collect()}
    assert all(zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r["ids"])) == r["ids_crc32"] for r in rows)
    whole = {}
    for r in rows:
        whole[r["doc_id"]] = whole.get(r["doc_id"], 0) + r["length"]
        assert r["doc_tokens"] >= r["start"] + r["length"]
    assert all(whole[r["doc_id"]] == r["doc_tokens"] for r in rows)


def test_odd_rows_pass_through(spark, tmp_path):
    rows = [(1, "", "en", "s", 0, "x"), (2, None, None, None, None, "x"), (None, None, None, None, None, "x"), (3, "mit license " * 50, "en", "s", 1, "y"), (3, "mit license " * 50, "en", "s", 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, D)
        assert out.columns == docs.columns, name
        out.collect()
        assert stage(spark, docs.limit(0), D).count() == 0
    assert sorted((r["doc_id"] or 0) for r in corpus_pipeline.near_duplicate_stage(spark, docs, D).collect()) == [1, 3]
    assert corpus_pipeline.run(spark, D).count() > 0


def test_hot_keys_are_joined_like_any_other(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    many = spark.createDataFrame([(k, i) for k, n in ((1, 9), (2, 2), (3, 5)) for i in range(n)], "k bigint, i bigint")
    one = spark.createDataFrame([(1, 9, "a"), (2, 2, "b"), (3, 5, "c"), (4, 0, "d")], "k bigint, n bigint, name string")
    got = common.join_spread(many, one, "k", "n", 16)
    assert got.columns == ["k", "i", "name"]
    assert sorted(got.collect()) == sorted(many.join(one.drop("n"), "k").collect())
