"""Bloom filters as column expressions, one per segment.

Positions come from double hashing of two 32-bit parts of an MD5 of the key, which any
SQL engine can compute too.  A filter is the set of its bits, packed into 64-bit words:
its size is bounded by the segment's number of keys, and it is built by aggregation by
word, not by gathering a segment's keys anywhere.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: For ``hits``: probes packed in a row; bytes of a block of filters at most, unless eight filters are larger, and
#: filters of a block at most; segments whose counts a task keeps before it sends them on.
CHUNK = 16_384
BLOCK_BYTES = 1 << 20
BLOCK_FILTERS = 1024
KEPT_COUNTS = 1 << 20
#: Probes looked up at a time.
_STEP = 2048


def bits_and_hashes(keys: int, error: float = 0.01) -> tuple[int, int]:
    """Bits, whole bytes of them, and hash functions for ``keys`` keys at a false-positive rate."""
    bits = int(-keys * math.log(error) / math.log(2) ** 2)
    bits = max(8, -(-bits // 8) * 8)
    return bits, max(1, round(bits / max(keys, 1) * math.log(2)))


def sizes(counts: DataFrame, n: str = "n", error: float = 0.01) -> DataFrame:
    """Adds ``bits`` and ``hashes`` to rows with a number of keys."""
    raw = F.floor(-F.col(n) * F.lit(math.log(error)) / F.lit(math.log(2) ** 2))
    bits = F.greatest(F.lit(8), F.ceil(raw / 8) * 8).cast("bigint")
    hashes = F.greatest(F.lit(1), F.floor(F.col("bits") / F.greatest(F.col(n), F.lit(1)) * F.lit(math.log(2)) + 0.5)).cast("bigint")
    return counts.withColumn("bits", bits).withColumn("hashes", hashes)


def _part(key: Column, at: int) -> Column:
    return F.conv(F.substring(F.md5(key), at, 8), 16, 10).cast("bigint")


def hashed(rows: DataFrame) -> DataFrame:
    """Adds the two hashes of the key, once per row; a null key has none and no positions."""
    return rows.withColumn("__h1", _part(F.col("key"), 1)).withColumn("__h2", _part(F.col("key"), 9))


def positions(bits: Column, hashes: Column) -> Column:
    """The bit positions of a hashed row: (h1 + i * h2) mod bits."""
    return F.transform(F.sequence(F.lit(0).cast("bigint"), hashes - 1), lambda i: F.pmod(F.col("__h1") + i * F.col("__h2"), bits))


def build(keys: DataFrame, by: str, bits: str = "bits", hashes: str = "hashes") -> DataFrame:
    """(by, word, mask): the filters' words that are not zero."""
    at = hashed(keys).select(by, F.explode(positions(F.col(bits), F.col(hashes))).alias("at")).where("at is not null")
    mask = F.expr("shiftleft(1L, cast(at % 64 as int))")
    return at.select(by, F.floor(F.col("at") / 64).alias("word"), mask.alias("mask")).groupBy(by, "word").agg(F.bit_or("mask").alias("mask"))


def might_contain(probes: DataFrame, filters: DataFrame, by: str, bits: str = "bits", hashes: str = "hashes") -> DataFrame:
    """``probes`` (by, key, bits, hashes) and whether the filter may hold the key; a null key is not held."""
    at = hashed(probes).select(by, "key", F.explode(F.array_distinct(positions(F.col(bits), F.col(hashes)))).alias("at"))
    at = at.withColumn("word", F.floor(F.col("at") / 64))
    hit = F.coalesce(F.expr("(mask & shiftleft(1L, cast(at % 64 as int))) != 0"), F.lit(False))
    return at.join(filters, [by, "word"], "left").groupBy(by, "key").agg(F.bool_and(hit).alias("maybe"))


def hits(keys: DataFrame, filters: DataFrame, sized: DataFrame, by: str) -> DataFrame:
    """(by, hits): for every row of ``sized`` (by, a bigint; bits, hashes) how many of ``keys`` (key) its filter may hold; a
    null key is not held.

    Every key meets every filter, but no row is made of the two.  Filters of one size have a key's positions in
    common, so they are laid side by side, a bit of each in a byte string per position, and one AND of a key's byte
    strings judges them all.  Chunks of keys meet such blocks of filters, and only counts go on.
    """
    # Filters of a block: a whole number of bytes of them.
    width = F.greatest(F.lit(1), F.least(F.lit(BLOCK_FILTERS // 8), F.floor(F.lit(BLOCK_BYTES) / F.col("bits")))) * 8
    numbered = sized.select(by, "bits", "hashes", (F.row_number().over(Window.partitionBy("bits", "hashes").orderBy(by)) - 1).alias("__n"))
    numbered = numbered.withColumn("__block", F.floor(F.col("__n") / width)).withColumn("__slot", (F.col("__n") % width).cast("int"))
    words = numbered.join(filters, by, "left").select(F.col(by).alias("id"), "bits", "hashes", "__block", "__slot", "word", "mask")
    blocks = words.groupBy("bits", "hashes", "__block").applyInArrow(_side_by_side, "bits bigint, hashes bigint, ids binary, planes binary")
    tasks = keys.sparkSession.sparkContext.defaultParallelism
    # A number of partitions that is asked for stays, however little each holds: the work is in the pairs.
    probes = hashed(keys.where("key is not null")).select("__h1", "__h2").repartition(tasks)
    chunks = probes.mapInArrow(_chunks, "h1 binary, h2 binary").repartition(tasks)
    counted = chunks.crossJoin(blocks).mapInArrow(_count, "id bigint, hits bigint")
    return counted.groupBy(F.col("id").alias(by)).agg(F.sum("hits").alias("hits")).join(sized.select(by), by, "right").select(by, F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"))


def _side_by_side(words):
    """The words of a block's filters as one byte string per position, with a bit for each filter."""
    import numpy as np
    import pyarrow as pa

    bits = words["bits"][0].as_py()
    slot = words["__slot"].to_numpy()
    slots, first = np.unique(slot, return_index=True)
    set_ = words.filter(words["word"].is_valid())
    word, mask, at = (set_[c].to_numpy() for c in ("word", "mask", "__slot"))
    planes = np.zeros((bits, -(-len(slots) // 8)), np.uint8)
    for bit in range(64):
        on = (mask >> bit) & 1 == 1
        np.bitwise_or.at(planes, (word[on] * 64 + bit, at[on] >> 3), np.uint8(128) >> (at[on] & 7).astype(np.uint8))
    ids = words["id"].to_numpy()[first].astype("<i8")
    return pa.table({"bits": [bits], "hashes": words["hashes"][:1].to_pylist(), "ids": [ids.tobytes()], "planes": [planes.tobytes()]})


def _chunks(batches) -> Iterator:
    """Hashes of up to ``CHUNK`` keys in a row."""
    import numpy as np
    import pyarrow as pa

    def packed(h1, h2):
        return pa.RecordBatch.from_pydict({"h1": [h1.astype("<u4").tobytes()], "h2": [h2.astype("<u4").tobytes()]})

    kept, n = [], 0
    for batch in batches:
        kept.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        n += batch.num_rows
        if n >= CHUNK:
            h1, h2 = (np.concatenate(c) for c in zip(*kept, strict=True))
            for i in range(0, n - n % CHUNK, CHUNK):
                yield packed(h1[i : i + CHUNK], h2[i : i + CHUNK])
            kept, n = [[h1[n - n % CHUNK :], h2[n - n % CHUNK :]]], n % CHUNK
    if n:
        yield packed(*(np.concatenate(c) for c in zip(*kept, strict=True)))


def _count(batches) -> Iterator:
    """Per filter of a block the keys of a chunk that it may hold; counts of equal blocks are added up."""
    import numpy as np
    import pyarrow as pa

    byte_bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
    counts: dict[bytes, np.ndarray] = {}
    kept = 0

    def told():
        ids = np.concatenate([np.frombuffer(b, "<i8") for b in counts])
        return pa.RecordBatch.from_pydict({"id": ids, "hits": np.concatenate(list(counts.values()))})

    for batch in batches:
        for row in range(batch.num_rows):
            h1, h2, bits, hashes, ids, planes = (batch[c][row].as_py() for c in ("h1", "h2", "bits", "hashes", "ids", "planes"))
            h1, h2 = (np.frombuffer(h, "<u4").astype(np.int64) for h in (h1, h2))
            table = np.frombuffer(planes, np.uint8).reshape(bits, -1)
            width = table.shape[1]
            own = np.zeros(width * 256, np.int64)
            for i in range(0, len(h1), _STEP):
                at, step = h1[i : i + _STEP] % bits, h2[i : i + _STEP] % bits
                held = table.take(at, axis=0)
                for _ in range(hashes - 1):
                    at = at + step
                    at -= bits * (at >= bits)
                    held &= table.take(at, axis=0)
                held = held.ravel()
                some = np.flatnonzero(held)
                own += np.bincount(some % width * 256 + held[some], minlength=width * 256)
            found = (own.reshape(width, 256) @ byte_bits).ravel()[: len(ids) // 8]
            if ids in counts:
                counts[ids] += found
            else:
                counts[ids] = found
                kept += len(found)
            if kept >= KEPT_COUNTS:
                yield told()
                counts, kept = {}, 0
    if counts:
        yield told()


@dataclass(frozen=True)
class Filter:
    """One filter at the driver, with the bits that ``build`` sets: for segments whose number of keys is bounded."""

    bits: int
    hashes: int
    words: array

    @classmethod
    def of(cls, keys: DataFrame, n: int, error: float = 0.01) -> Filter:
        """The filter of the ``n`` keys of ``keys`` (key); at the default rate the driver gets a word of 64 bits for every six or seven keys."""
        bits, hashes = bits_and_hashes(n, error)
        sized = keys.select(F.lit(0).alias("one"), "key", F.lit(bits).cast("bigint").alias("bits"), F.lit(hashes).cast("bigint").alias("hashes"))
        words = array("q", bytes(8 * -(-bits // 64)))
        for word, mask in zip(*(c.to_pylist() for c in build(sized, "one").select("word", "mask").toArrow().columns), strict=True):
            words[word] = mask
        return cls(bits, hashes, words)

    def positions(self, key: bytes) -> list[int]:
        digest = hashlib.md5(key, usedforsecurity=False).digest()
        h1, h2 = int.from_bytes(digest[:4]), int.from_bytes(digest[4:8])
        return [(h1 + i * h2) % self.bits for i in range(self.hashes)]

    def might_contain(self, key: bytes) -> bool:
        return all(self.words[at // 64] >> (at % 64) & 1 for at in self.positions(key))

    def set_bits(self) -> list[int]:
        return [64 * n + i for n, word in enumerate(self.words) if word for i in range(64) if word >> i & 1]

    def to_json(self) -> str:
        """Bits, hash functions, and the words as little-endian bytes in base 64."""
        raw = b"".join(w.to_bytes(8, "little", signed=True) for w in self.words)
        return json.dumps({"bits": self.bits, "hashes": self.hashes, "words": base64.b64encode(raw).decode()})

    @classmethod
    def from_json(cls, text: str) -> Filter:
        got = json.loads(text)
        raw = base64.b64decode(got["words"])
        return cls(got["bits"], got["hashes"], array("q", (int.from_bytes(raw[i : i + 8], "little", signed=True) for i in range(0, len(raw), 8))))
