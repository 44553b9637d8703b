"""Benchmark decontamination: a broadcast hash set of the test n-grams.

Every benchmark item gives windows of ``n`` consecutive words (an item of fewer
words is one window).  The windows are broadcast as a hash set, a bounded block of
the benchmark at a time, and the word windows of every document are scanned
against them: runs of words that the benchmark has at all, then a rolling hash,
then the words themselves.  All blocks are scanned in one pass over the documents
by chained map stages; there is no shuffle.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs, cut, importable, sliced, words_of

WINDOW = 10
#: Benchmark text of one broadcast block; a block's hash set takes some 40 times that.
BLOCK_BYTES = 2 << 20
#: Blocks that are broadcast at a time, so at most 16 MB of benchmark text are.
PASS_BLOCKS = 8
_RAW_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)
SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


class WindowSet:
    """The windows of some items: word numbers, window hashes by length, and the items of each window."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[str] = []
        windows: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            length, item = min(n, len(words)), len(self.ids)
            self.ids.append(item_id)
            for i in range(len(words) - length + 1):
                windows[tuple(numbers[i : i + length])].add(item)
        self.windows = dict(windows)
        by_length = defaultdict(list)
        for w in self.windows:
            by_length[len(w)].append(w)
        self.hashes = {
            length: np.unique(self.rolled(np.array(ws, dtype=np.uint64).T)) for length, ws in sorted(by_length.items())
        }

    @staticmethod
    def rolled(columns) -> np.ndarray:
        h = np.zeros(len(columns[0]), dtype=np.uint64)
        for c in columns:
            h = (h ^ c) * _PRIME
            h ^= h >> np.uint64(29)
        return h

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans [first, last) in windows, merged, and the ids of the items hit."""
        get = self.vocabulary.get
        numbers = np.fromiter([get(w, 0) for w in words], dtype=np.uint64, count=len(words))
        unknown = np.concatenate(([0], np.cumsum(numbers == 0)))
        found: list[tuple[int, int]] = []
        items: set[int] = set()
        for length, hashes in self.hashes.items():
            if len(words) < length:
                continue
            at = np.flatnonzero(unknown[length:] == unknown[:-length])
            if not len(at):
                continue
            h = self.rolled([numbers[at + j] for j in range(length)])
            near = np.searchsorted(hashes, h)
            for i in at[hashes[np.minimum(near, len(hashes) - 1)] == h].tolist():
                hit = self.windows.get(tuple(numbers[i : i + length].tolist()))
                if hit:
                    items |= hit
                    found.append((i, i + length))
        return merged(found), {self.ids[i] for i in items}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def benchmark_blocks(benchmark: DataFrame, n: int, id_col: str, text_col: str, block_bytes: int) -> Iterator[WindowSet]:
    """The benchmark's windows, a block of bounded size at a time."""
    items = benchmark.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    items = items.distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        yield WindowSet([(r["id"], r["text"].encode()) for r in block.collect()], n)


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = WINDOW,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    prefix: str = "leak_",
) -> DataFrame:
    """All columns of ``docs`` and ``leak_words`` (their number), ``leak_spans`` (word
    spans [first, last) inside windows, merged) and ``leak_items`` (ids hit, sorted).

    A null or empty text has no words; a null item id is the empty id; an item
    without words, or an empty benchmark, hits nothing.  Repeated rows are kept.  Columns of
    the three names that ``docs`` has are replaced; ``prefix`` names them otherwise.  Of a
    large benchmark ``PASS_BLOCKS`` blocks are held at a time, and the table is cut between.
    """
    importable(docs.sparkSession)
    names = [prefix + x for x in ("words", "spans", "items")]
    fields = [f for f in docs.schema.fields if f.name not in names]
    docs = docs.select(*(f.name for f in fields))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    ddl += f", `{names[0]}` bigint, `{names[1]}` array<struct<first:int,last:int>>, `{names[2]}` array<string>"
    at = docs.columns.index(text_col)
    context = docs.sparkSession.sparkContext
    pending: list = []
    for number, windows in enumerate(benchmark_blocks(benchmark, n, item_col, item_text_col, block_bytes)):
        held = context.broadcast(windows)

        def run(batches, held=held, first=number == 0, width=len(fields)):
            windows = held.value
            for batch in sliced(batches):
                counts, spans, items = [], [], []
                for row, text in enumerate(blobs(batch.column(at))):
                    words = words_of(text)
                    s, i = windows.scan(words)
                    if not first:
                        before = batch.column(width + 1)[row].as_py()
                        s = merged(s + [(x["first"], x["last"]) for x in before])
                        i = i | set(batch.column(width + 2)[row].as_py())
                    counts.append(len(words))
                    spans.append([{"first": a, "last": b} for a, b in s])
                    items.append(sorted(i))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:width], pa.array(counts, pa.int64()), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))],
                    [*batch.schema.names[:width], *names],
                )

        docs = docs.mapInArrow(run, ddl)
        pending.append(held)
        if len(pending) == PASS_BLOCKS:
            docs = cut(docs)
            while pending:
                pending.pop().destroy()
    return docs


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of ``spans`` and what stands between them."""
    words = [m.span() for m in _RAW_WORD.finditer(text)]
    out, at = [], 0
    for first, last in spans:
        out.append(text[at : words[first][0]].rstrip(b" "))
        at = words[last - 1][1]
    return b"".join([*out, text[at:]])


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", mode: str = "spans", **options) -> DataFrame:
    """``docs`` without what the benchmark holds, its columns unchanged.

    ``mode`` "documents" drops every document that is hit.  "spans" cuts the hit words
    out of the text and drops a document only if no word is left of it.  Documents
    that are not hit, empty and null ones among them, stay as they are.
    """
    prefix = "__leak_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    found = find(docs, benchmark, text_col=text_col, prefix=prefix, **options)
    clean = F.size(prefix + "spans") == 0
    if mode == "documents":
        return found.where(clean).select(*docs.columns)
    at, spans_at, names = docs.columns.index(text_col), len(docs.columns) + 1, docs.columns
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches):
        for batch in sliced(batches):
            spans = batch.column(spans_at).to_pylist()
            texts, keep = batch.column(at).to_pylist(), []
            for row, s in enumerate(spans):
                left = True
                if s:
                    text = without_spans(texts[row].encode(), [(x["first"], x["last"]) for x in s])
                    left = bool(_RAW_WORD.search(text))
                    texts[row] = text.decode("utf-8", "replace")
                keep.append(left)
            columns = [*batch.columns[: len(names)]]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    return found.mapInArrow(run, ddl)
