"""Media columns: signature sniffing.

An Aho-Corasick automaton over the magic bytes of known formats finds all places
where one may begin, in one pass; a validator per format then confirms structure and
lengths there.  What begins at byte 0 decides the type of a blob and corrects a
declared one; what is confirmed elsewhere is carved out as embedded media.
"""

from __future__ import annotations

import re
import bisect
import hashlib
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import importable, map_text, sliced


# Format, offset of the magic in the file, magic bytes.
MAGIC = (
    ("png", 0, b"\x89PNG\r\n\x1a\n"),
    ("gif", 0, b"GIF87a"),
    ("gif", 0, b"GIF89a"),
    ("jpeg", 0, b"\xff\xd8\xff"),
    ("bmp", 0, b"BM"),
    ("wav", 8, b"WAVEfmt "),
    ("webp", 8, b"WEBPVP8"),
    ("pdf", 0, b"%PDF-1."),
    ("zip", 0, b"PK\x03\x04"),
    ("gzip", 0, b"\x1f\x8b\x08"),
    ("ogg", 0, b"OggS\x00"),
    ("flac", 0, b"fLaC\x00"),
    ("mp4", 4, b"ftyp"),
)
TYPES = {
    "png": "image/png", "gif": "image/gif", "jpeg": "image/jpeg", "bmp": "image/bmp", "wav": "audio/wav", "webp": "image/webp",
    "pdf": "application/pdf", "zip": "application/zip", "gzip": "application/gzip", "ogg": "audio/ogg", "flac": "audio/flac", "mp4": "video/mp4",
}
RATE = 8000


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """The payload as 8-bit mono samples in a RIFF/WAVE container; lossless."""
    pad = b"\0" * (len(payload) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + pad


def wav_samples(media: bytes) -> bytes:
    """The samples of the data chunk, read by the chunk lengths."""
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def _riff(b: bytes, at: int, form: bytes) -> int:
    if at < 0 or b[at : at + 4] != b"RIFF" or b[at + 8 : at + 12] != form:
        return -1
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return -1
    p = at + 12
    while p + 8 <= end:
        size = struct.unpack_from("<I", b, p + 4)[0]
        p += 8 + size + size % 2
    return end if p in (end, end + 1) else -1


def _png(b: bytes, at: int) -> int:
    p, first = at + 8, True
    while p + 12 <= len(b):
        size, name = struct.unpack_from(">I4s", b, p)
        if first != (name == b"IHDR") or p + 12 + size > len(b) or zlib.crc32(b[p + 4 : p + 8 + size]) != struct.unpack_from(">I", b, p + 8 + size)[0]:
            return -1
        p, first = p + 12 + size, False
        if name == b"IEND":
            return p
    return -1


def _gif(b: bytes, at: int) -> int:
    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1

    if at + 13 > len(b):
        return -1
    p = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 128 else 0)
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            p = blocks(p + 11 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 128 else 0))
        else:
            return -1
    return -1


class Blob(bytes):
    """Bytes that find a mark from wherever they are asked, having looked for it once."""

    def first(self, mark: bytes, at: int) -> int:
        """The first place of ``mark`` at or behind ``at``, or -1."""
        places = self.__dict__.setdefault(mark, [])
        if not places:
            places += [m.start() for m in re.finditer(b"(?=" + re.escape(mark) + b")", self)] or [-1]
        i = bisect.bisect_left(places, at)
        return places[i] if i < len(places) else -1


def _jpeg(b: Blob, at: int) -> int:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        mark, size = b[p + 1], struct.unpack_from(">H", b, p + 2)[0]
        if mark == 0xDA:
            end = b.first(b"\xff\xd9", p + 2 + size)
            return end + 2 if end >= 0 else -1
        if size < 2 or not 0xC0 <= mark <= 0xFE:
            return -1
        p += 2 + size
    return -1


def _bmp(b: bytes, at: int) -> int:
    if at + 30 > len(b):
        return -1
    size, zero, start, head = struct.unpack_from("<IIII", b, at + 2)
    planes, depth = struct.unpack_from("<HH", b, at + 26)
    ok = zero == 0 and head in (40, 52, 56, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and 14 + head <= start <= size
    return at + size if ok and at + size <= len(b) else -1


def _pdf(b: Blob, at: int) -> int:
    end = b.first(b"%%EOF", at)
    return end + 5 if end >= 0 and 0 <= b.first(b"startxref", at) <= end - 9 else -1


def _zip(b: Blob, at: int) -> int:
    end = b.first(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return -1
    size, start, note = struct.unpack_from("<IIH", b, end + 12)
    return end + 22 + note if at + start + size == end and end + 22 + note <= len(b) else -1


def _gzip(b: bytes, at: int) -> int:
    d = zlib.decompressobj(31)
    try:
        for p in range(at, len(b), 1 << 16):
            rest = b[p : p + (1 << 16)]
            while rest and not d.eof:  # bounded pieces of what comes out
                d.decompress(rest, 1 << 20)
                rest = d.unconsumed_tail
            if d.eof:
                return min(p + (1 << 16), len(b)) - len(d.unused_data)
    except zlib.error:
        pass
    return -1


def _ogg(b: bytes, at: int) -> int:
    p = at
    while b[p : p + 4] == b"OggS" and p + 27 <= len(b):
        table = b[p + 27 : p + 27 + b[p + 26]]
        p += 27 + len(table) + sum(table)
    return p if at < p <= len(b) else -1


def _flac(b: bytes, at: int) -> int:
    p = at + 4
    while p + 4 <= len(b):
        size = int.from_bytes(b[p + 1 : p + 4], "big")
        if p == at + 4 and (b[p] & 127 or size != 34):
            return -1
        last, p = b[p] & 128, p + 4 + size
        if last:
            return len(b) if p <= len(b) else -1
    return -1


def _mp4(b: bytes, at: int) -> int:
    p = at
    while 0 <= p and p + 8 <= len(b):
        size, name = struct.unpack_from(">I4s", b, p)
        if size < 8 or not name.isalnum() or p + size > len(b):
            break
        p += size
    return p if p > at else -1


CHECKS = {
    "png": _png, "gif": _gif, "jpeg": _jpeg, "bmp": _bmp, "pdf": _pdf, "zip": _zip, "gzip": _gzip, "ogg": _ogg, "flac": _flac, "mp4": _mp4,
    "wav": lambda b, at: _riff(b, at, b"WAVE"), "webp": lambda b, at: _riff(b, at, b"WEBP"),
}

_automata: list[ahocorasick.Automaton] = []


def automaton() -> ahocorasick.Automaton:
    if not _automata:
        a = ahocorasick.Automaton()
        for name, offset, magic in MAGIC:
            a.add_word(magic.decode("latin-1"), (name, offset + len(magic) - 1))
        a.make_automaton()
        _automata.append(a)
    return _automata[0]


def sniff(blob: bytes) -> tuple[str | None, list[tuple[str, int, int]]]:
    """(type, confirmed media [(type, start, end)]): what begins at 0 and reaches the end of the
    blob, or to within its padding, is the blob's own type; all else that is confirmed is embedded.
    Media inside confirmed embedded media are not looked for again."""
    own, found, behind = None, [], 0
    blob = Blob(blob)
    for last, (name, before) in automaton().iter(blob.decode("latin-1")):
        at = last - before
        if at < behind or at < 0:
            continue
        end = CHECKS[name](blob, at)
        if end < 0:
            continue
        if at == 0 and own is None:
            own = TYPES[name]
        else:
            found.append((TYPES[name], at, end))
            behind = end
    return own, found


def inspect(df: DataFrame, id_col: str, media_col: str, declared_col: str | None = None, carve: bool = True) -> DataFrame:
    """Per row of a binary column: id, declared, type (sniffed, else the declared one), corrected
    (the declared type was wrong), and the embedded media: type, start, length and, with ``carve``, bytes.

    Null media have no type of their own and nothing embedded; null ids and repeated rows are kept.
    """
    importable(df.sparkSession)
    id_type = dict(df.dtypes)[id_col]
    names = [id_col, media_col, *([declared_col] if declared_col else [])]
    item = [("type", pa.string()), ("start", pa.int64()), ("length", pa.int64()), *([("bytes", pa.binary())] if carve else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            media = batch.column(1).to_pylist()
            declared = batch.column(2).to_pylist() if declared_col else [None] * len(media)
            types, wrong, inside = [], [], []
            for blob, said in zip(media, declared, strict=True):
                own, found = sniff(blob or b"")
                types.append(own or said)
                wrong.append(bool(own and said and own != said))
                inside.append([{"type": t, "start": a, "length": e - a} | ({"bytes": blob[a:e]} if carve else {}) for t, a, e in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(declared, pa.string()), pa.array(types, pa.string()), pa.array(wrong, pa.bool_()), pa.array(inside, pa.list_(pa.struct(item)))],
                [id_col, "declared", "type", "corrected", "embedded"],
            )

    ddl = f"`{id_col}` {id_type}, declared string, type string, corrected boolean, embedded array<struct<type:string,start:bigint,length:bigint" + (",bytes:binary>>" if carve else ">>")
    return df.select(*names).mapInArrow(run, ddl)


def padded(text: bytes, unit: int = 64) -> bytes:
    return text + b"\0" * (max(1, -(-len(text) // unit)) * unit - len(text))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every text, padded, as the samples of a WAVE file.  Null texts are empty."""
    def rows(texts: list[bytes]) -> dict[str, list]:
        return {"n_bytes": [len(t) for t in texts], "media": [wav(padded(t)) for t in texts]}

    return map_text(docs, id_col, text_col, rows, {"n_bytes": pa.int64(), "media": pa.binary()}, "n_bytes bigint, media binary")


def feature(own: str | None, embedded: list, samples: bytes) -> str:
    """The blob's type, its length in samples and what is embedded."""
    inside = ";".join(f"{t}@{a}+{e - a}" for t, a, e in embedded)
    return f"{own or 'unknown'}|samples={len(samples)}|embedded={len(embedded)}" + (f"|{inside}" if inside else "")


FIELDS = {
    "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(),
    "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(),
}
DDL = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def features(media_rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests and features of stored texts (id, n_bytes, media), read back from the media bytes."""
    importable(media_rows.sparkSession)
    id_type = dict(media_rows.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out: dict[str, list] = {k: [] for k in FIELDS if k != "n_bytes"}
            for media in batch.column(2).to_pylist():
                own, embedded = sniff(media)
                payload = wav_samples(media) if own == "audio/wav" else b""
                out["payload_bytes"].append(len(payload))
                out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                out["tail_crc32"].append(zlib.crc32(payload[-64:]))
                out["media_bytes"].append(len(media))
                out["media_sha256"].append(hashlib.sha256(media).hexdigest())
                out["feature"].append(feature(own, embedded, payload))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(v, FIELDS[k]) for k, v in out.items())], [id_col, *FIELDS]
            )

    return media_rows.select(id_col, "n_bytes", "media").mapInArrow(run, f"`{id_col}` {id_type}, {DDL}")
