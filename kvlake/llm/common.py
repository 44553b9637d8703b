"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.sources.filesystem import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Bytes table: A-Z to a-z, all else as it is.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Bytes table for the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text:
#: digits, letters and everything above ASCII stay, every other byte separates.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """The lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 bytes."""
    return text.translate(WORD_BYTES).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes not to be a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that a lost executor costs a re-read
    and not a recomputation.

    It is a written table, not a checkpoint: a checkpoint keeps the estimated size of the
    plan it cuts, and estimates of joins multiply; after a few rounds of an iteration
    these are numbers of millions of digits.  A table's size is that of its files.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key of more rows than this, and than its share of all rows over ``HOT_KEYS``, is hot; so there are at most that many.
HOT_ROWS = 1000
HOT_KEYS = 4096


def join_spread(many: DataFrame, one: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``many`` joined with ``one``, which is materialised and has a row per key and in ``n`` how
    many rows of ``many`` the key has (dropped here); ``total`` bounds their sum.

    The rows of hot keys stay where they are and meet the few rows of ``one`` by a broadcast,
    so no task has to read all rows of a key.
    """
    limit = max(HOT_ROWS, total // HOT_KEYS)
    hot = one.where(F.col(n) > limit).drop(n)
    if hot.isEmpty():
        return many.join(one.drop(n), key)
    rest = many.join(F.broadcast(hot.select(key)), key, "left_anti").join(one.where(F.col(n) <= limit).drop(n), key)
    return many.join(F.broadcast(hot), key).unionByName(rest)


def join_salted(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """``many`` joined with ``one``, which has a row per key, of any width: the rows of a hot key
    are dealt out, each share of them with its own copy of the key's row."""
    hot = many.groupBy(key).agg(F.ceil(F.count("*") / F.lit(HOT_ROWS)).cast("int").alias("__shares")).where("__shares > 1")
    hot = cut(hot)
    if hot.isEmpty():
        return many.join(one, key)
    shares = F.coalesce("__shares", F.lit(1))
    dealt = many.join(hot, key, "left").withColumn("__share", F.pmod(F.xxhash64(*many.columns), shares).cast("int")).drop("__shares")
    copies = one.join(hot, key, "left").withColumn("__share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("__shares")
    return dealt.join(copies, [key, "__share"]).drop("__share")


def id_text(id_col: str) -> Column:
    """The id as text; a null id counts as the empty text."""
    return F.coalesce(F.col(id_col).cast("string"), F.lit(""))


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(id_text(id_col)), F.lit(folds).cast("bigint"))


#: Bytes of a slice of a batch, if it has more than one row.
SLICE_BYTES = 1 << 20


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows and bytes, so that what Python makes of one stays small; at the end
    of a task freed memory goes back to the system, as workers live on from stage to stage."""

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = batch.num_rows
        if n > rows or (n > 1 and batch.nbytes > SLICE_BYTES):
            yield from parts(batch.slice(0, n // 2))
            yield from parts(batch.slice(n // 2))
        elif n:
            yield batch

    for batch in batches:
        yield from parts(batch)
    del batches
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def blobs(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


#: Rows of an Arrow batch; texts are long, and a batch is held whole on both sides.
BATCH_ROWS = 500
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def importable(spark: SparkSession) -> None:
    """Lets Python workers of a local session import this package from wherever the driver did, and
    limits the session's Arrow batches to ``BATCH_ROWS`` rows."""
    env, root = spark.sparkContext.environment, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, *known]))
    if not 0 < int(spark.conf.get(_BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))


def map_text(
    df: DataFrame, id_col: str, text_col: str, rows: Callable[[list[bytes]], dict[str, list]], fields: dict[str, pa.DataType], ddl: str
) -> DataFrame:
    """One output row per input row: the id and what ``rows`` makes of a batch's
    texts.  No shuffle; a batch at a time is in memory."""
    importable(df.sparkSession)
    id_type = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = rows(blobs(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(made[k], t) for k, t in fields.items())], [id_col, *fields]
            )

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, {ddl}")


def add_columns(
    df: DataFrame, text_col: str, rows: Callable[[list[bytes]], dict[str, list]], fields: dict[str, pa.DataType], ddl: str
) -> DataFrame:
    """All columns of ``df`` and those that ``rows`` makes; ``fields`` must not clash."""
    importable(df.sparkSession)
    at = df.columns.index(text_col)
    names = df.columns
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = rows(blobs(batch.column(at)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(made[k], t) for k, t in fields.items())], [*names, *fields]
            )

    return df.mapInArrow(run, f"{kept}, {ddl}")


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, keep: Column, max_rows_per_class: int, max_text_bytes: int | None = None
) -> DataFrame:
    """At most about ``max_rows_per_class`` labelled documents of either class, chosen by a hash of the id.

    Only the chosen label rows, whose number is bounded, are broadcast; texts over
    ``max_text_bytes``, if given, are left out of the sample so that its size is bounded too.
    Of an id that several documents have, one text is taken, the least.
    ``keep`` says which label rows may be learnt from.
    """
    usable = labels.where(keep & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    scale = 1 << 30
    chance = F.lit(0)
    for value, n in counts.items():
        chance = F.when(F.col("label") == value, F.lit(int(scale * min(1.0, max_rows_per_class / n)))).otherwise(chance)
    chosen = usable.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(scale)) < chance)
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.where("text is not null").select("doc_id", "text")
    if max_text_bytes is not None:
        texts = texts.where(F.octet_length("text") <= max_text_bytes)
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    return found.select("text", "label")
