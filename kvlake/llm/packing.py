"""Harmonic packing of token sequences.

A capacity C is split into reciprocal classes: class k takes pieces of C // k
tokens, and each of its sequences takes exactly k of them.  Documents may be cut,
so a piece is cut to the length of its class, which leaves C mod k (< k) tokens
of padding: whole capacities come first (class 1), then of a rest r with
C/(k+1) <= r < C/k a piece of C // (k+1), and so on; the last piece, shorter than
``C // classes``, goes to the small class.  A rest shrinks from r < C/k to less
than C/(k(k+1)), so few pieces come of a document.  The small pieces of a worker
fill sequences one after another (next fit, cut at the end).

Every worker (partition) fills its own sequences with a fixed count per class and
nothing is exchanged: no shuffle, and memory for at most k open pieces per class.
At its end a worker lays the pieces of unfilled sequences end to end, cut freely,
so that one sequence per worker at most is partly filled.
"""

from __future__ import annotations

import base64
import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import blobs, importable, sliced

CAPACITY = 2048
CLASSES = 64
END_ID = 1
#: Sequence numbers of one worker.
WORKER_SPAN = 1 << 40
_SPACE = re.compile(r"\s")


class Encoder:
    """Token ids of a text as little-endian unsigned 32-bit bytes.

    A single space between two other characters always begins a new pre-token of the
    byte-level pattern, so what stands between such spaces can be encoded, and kept,
    by itself.  A text in which a space has white space beside it is encoded whole.
    ``added`` tokens have their own ids wherever their strings stand, and what is
    between them is encoded by itself.
    """

    def __init__(self, ranks_path: str, pattern: str, added: dict[str, int] | None = None, keep: int = 40_000, longest: int = 48):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._piece = self._plain._core_bpe.encode_single_piece
        self._marks = {m: self._bytes(self._plain.encode_ordinary(m)) for m in ",."}
        self._keep, self._longest = keep, longest
        self._added = {t: self._bytes([i]) for t, i in (added or {}).items() if t}
        self._at_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self._added, key=len, reverse=True)) + ")")
        self._cache: dict[str, bytes | None] = {}
        self._older: dict[str, bytes | None] = {}

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        ids = array("I", ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def whole(self, text: str) -> bytes:
        return self._bytes(self._plain.encode_ordinary(text))

    def _miss(self, word: str) -> bytes | None:
        """The ids of a space and ``word``.  Letters alone are one pre-token; a mark after
        letters is another.  Two generations of kept words bound the memory."""
        ids = self._older.get(word)
        if ids is None and word:
            if word.isalpha():
                ids = self._bytes(self._piece((" " + word).encode()))
            elif word[-1] in ",." and word[:-1].isalpha():
                stem = word[:-1]
                return (self._cache.get(stem) or self._miss(stem)) + self._marks[word[-1]]
            elif not _SPACE.match(word[0]) and not _SPACE.match(word[-1]):
                ids = self.whole(" " + word)
        if len(word) <= self._longest:
            if len(self._cache) >= self._keep:
                self._older, self._cache = self._cache, {}
            self._cache[word] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if any(t in text for t in self._added):
            return b"".join(self._added.get(part) or self.plain(part) for part in self._at_added.split(text) if part)
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if not rest:
            return self.whole(text)
        if not first or _SPACE.match(first[0]) or _SPACE.match(first[-1]):
            return self.whole(text)
        get, miss = self._cache.get, self._miss
        parts = [get(w) or miss(w) for w in rest]
        if None in parts:
            return self.whole(text)
        return self.whole(first) + b"".join(parts)


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizer's file and their ids."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens", ())}


def piece_lengths(n: int, capacity: int = CAPACITY, classes: int = CLASSES) -> list[tuple[int, int]]:
    """(class, length) of the pieces of a document of ``n`` tokens, in their order;
    class 0 is the small one."""
    out = [(1, capacity)] * (n // capacity)
    rest = n % capacity
    while rest:
        k = -(-capacity // rest)
        if capacity // k > rest:
            k += 1
        if k > classes:
            out.append((0, rest))
            break
        out.append((k, capacity // k))
        rest -= capacity // k
    return out


class Packer:
    """Fills the sequences of one worker; pieces are (document number, start, length)."""

    def __init__(self, capacity: int, classes: int, first_sequence: int):
        self.capacity, self.classes, self.next = capacity, classes, first_sequence
        self.open: list[list] = [[] for _ in range(classes + 1)]
        self.small = 0

    def _close(self, pieces: list) -> list:
        at, out = 0, []
        for p in pieces:
            out.append((*p, self.next, at))
            at += p[2]
        self.next += 1
        return out

    def add(self, document, n: int) -> list:
        """Pieces that are placed now: (document, start, length, sequence, offset)."""
        placed, start = [], 0
        for k, length in piece_lengths(n, self.capacity, self.classes):
            if k:
                self.open[k].append((document, start, length))
                if len(self.open[k]) == k:
                    placed += self._close(self.open[k])
                    self.open[k] = []
            else:
                placed += self._small(document, start, length)
            start += length
        return placed

    def _small(self, document, start: int, length: int) -> list:
        placed = []
        while length:
            take = min(length, self.capacity - self.small)
            self.open[0].append((document, start, take))
            self.small += take
            start, length = start + take, length - take
            if self.small == self.capacity:
                placed += self._close(self.open[0])
                self.open[0], self.small = [], 0
        return placed

    def finish(self) -> list:
        """Lays what is left end to end."""
        placed = []
        for k in range(1, self.classes + 1):
            for p in self.open[k]:
                placed += self._small(*p)
            self.open[k] = []
        if self.open[0]:
            placed += self._close(self.open[0])
            self.open[0], self.small = [], 0
        return placed


def pack(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    classes: int = CLASSES,
    end_id: int = END_ID,
    with_ids: bool = True,
    added: dict[str, int] | None = None,
) -> DataFrame:
    """Pieces of all documents, packed: id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and, ``with_ids``, the piece's token ids.

    A null text is empty; every document ends with ``end_id``, so none is without a
    piece.  Repeated rows are packed each by itself, null ids stay null, other columns
    are ignored, an empty table has no pieces.
    """
    importable(docs.sparkSession)
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(ranks_path, pattern, added)
        packer = Packer(capacity, classes, TaskContext.get().partitionId() * WORKER_SPAN)
        kind = None

        def out(placed: list, limit: int = 0) -> Iterator[pa.RecordBatch]:
            if len(placed) <= limit:
                return
            while placed:
                part = placed[:1000]
                del placed[:1000]
                pieces = [memoryview(p[0][1])[4 * p[1] : 4 * (p[1] + p[2])] for p in part]
                columns = [
                    pa.array([p[0][0] for p in part], kind),
                    *(pa.array(x, pa.int64()) for x in (
                        [p[1] for p in part], [p[2] for p in part], [zlib.crc32(x) for x in pieces],
                        [len(p[0][1]) // 4 for p in part], [p[3] for p in part], [p[4] for p in part],
                    )),
                ]
                names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if with_ids:
                    offsets, total = [0], 0
                    for p in part:
                        total += p[2]
                        offsets.append(total)
                    values = pa.Array.from_buffers(pa.int32(), total, [None, pa.py_buffer(b"".join(pieces))])
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

        end = end_id.to_bytes(4, "little")
        placed: list = []
        for batch in sliced(batches):
            kind = batch.column(0).type
            for key, text in zip(batch.column(0).to_pylist(), blobs(batch.column(1)), strict=True):
                ids = encode(text.decode("utf-8", "replace")) + end if text else end
                placed += packer.add((key, ids), len(ids) // 4)
                yield from out(placed, 1000)
        placed += packer.finish()
        yield from out(placed)

    ddl = f"`{id_col}` {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return docs.select(id_col, text_col).mapInArrow(run, ddl + (", ids array<int>" if with_ids else ""))
