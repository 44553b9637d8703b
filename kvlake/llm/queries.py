"""The registered queries: each derives its fixed columns from an operator's output."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, license_scan, media_sniff, packing, quality, secret_scan, sharding, simhash, toxicity, url_filter
from .common import fold, table


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, packed into sequences of at most 2048."""
    return packing.pack(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False,
        added=packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")),
    )


def op2_ngram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words and items of the benchmark each document holds."""
    found = decontaminate.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.expr("aggregate(leak_spans, 0L, (n, s) -> n + s.last - s.first)")
    return found.select(
        "doc_id",
        F.col("leak_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("leak_items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "leak_items"), 256).alias("items_sha256"),
        (F.size("leak_spans") > 0).alias("contaminated"),
    )


def op3_url_language_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op4_toxicity_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document; labels of one fold in five are never seen."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op5_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in every document."""
    spans = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = "filter(spans, s -> s.kind in ('assign', 'access', 'hex'))"
    text = "array_join(transform({}, s -> concat_ws(':', s.kind, cast(s.start as string), cast(s.end as string))), ',')"
    return spans.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(F.expr(text.format(base)), 256).alias("base_sha256"),
        F.expr(text.format("spans")).alias("spans"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document; labels of one fold in three are never seen."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op7_signature_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as samples, read back and sniffed."""
    return media_sniff.features(media_sniff.store_texts(table(spark, sf_dir, "documents")))


def op8_license_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses that every document names."""
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("detections")


def op9_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 16, near equal in bytes."""
    return sharding.shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of the secret scan, which SQL can express."""
    return op5_secret_automaton(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored payloads as they are read back."""
    return op7_signature_sniffing(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of the base phrases."""
    return op8_license_signatures(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def shard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All shards together: rows, bytes, and whether every shard's slots are gapless from 0."""
    rows = op10_sampled_splitters(spark, sf_dir)
    each = rows.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.sum("slot").alias("slots"))
    gapless = F.bool_and((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("slots") * 2 == F.col("n") * (F.col("n") - 1)))
    return each.agg(F.sum("n").alias("rows"), F.sum("bytes").alias("bytes"), gapless.alias("gapless"))


OPERATORS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_harmonic_packing, op2_ngram_decontamination, op3_url_language_ratio, op4_toxicity_convolution, op5_secret_automaton,
        op6_quality_rules, op7_signature_sniffing, op8_license_signatures, op9_simhash_covering, op10_sampled_splitters,
        secret_base_counts, media_payloads, license_base_places, shard_totals,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return OPERATORS | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return dict(SQL) | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})


_WORDS = (
    "regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
OP2_SQL = f"""
WITH items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS.format('text')} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS gram
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM windows),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS w FROM documents
), places AS (
  SELECT r, n, i, list_slice(w, i, i + n - 1) AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)
), hits AS (
  SELECT r, i, places.n, item_id FROM places JOIN windows ON places.n = windows.n AND places.gram = windows.gram
), words AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r
), found AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""

_TEXT = "coalesce(text, '')"
SQL = {
    "op2_ngram_decontamination": OP2_SQL,
    "secret_base_counts": f"""
SELECT doc_id,
  CAST(len(list_filter(regexp_extract_all({_TEXT}, '(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 12)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all({_TEXT}, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS BIGINT) AS n_access,
  CAST(len(list_filter(regexp_extract_all({_TEXT}, '[0-9a-f]+'), lambda x: length(x) >= 16)) AS BIGINT) AS n_hex
FROM documents""",
    "media_payloads": f"""
WITH d AS (SELECT doc_id, encode({_TEXT}) AS b FROM documents),
p AS (SELECT doc_id, octet_length(b) AS n, b || unhex(repeat('00', CAST(greatest(64, (octet_length(b) + 63) // 64 * 64) - octet_length(b) AS INTEGER))) AS payload FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_sha256 FROM p""",
    "license_base_places": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS w FROM documents),
i AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE list_contains(w, 'license')),
h AS (
  SELECT r, i - 1 AS place, 'mit' AS label FROM i WHERE w[i] = 'mit' AND w[i + 1] = 'license'
  UNION ALL SELECT r, i - 1, 'apache' FROM i WHERE w[i] = 'apache' AND w[i + 1] = 'license'
  UNION ALL SELECT r, i - 1, 'gpl' FROM i WHERE w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license'
), n AS (SELECT r, count(*) AS n, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(labels, '') AS base_labels
FROM d LEFT JOIN n USING (r)""",
    "shard_totals": f"SELECT count(*) AS rows, CAST(sum(strlen({_TEXT}) + 1) AS BIGINT) AS bytes, true AS gapless FROM documents",
}
