"""Media columns: signature sniffing, type correction, carving; and texts stored as 8-bit sound.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over the stored bytes; a validator for the
format then walks its structure (chunk sizes, checksums, trailers) from there and says where the object ends. What
stands at byte 0 corrects the declared type; valid objects further inside are carved.

Defined results: null bytes or null text count as empty; empty bytes have the type ``application/x-empty`` and no objects;
equal bytes give equal results; an object that fails its validator is not reported; an object inside one already carved is not carved again.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.cluster import cut, ddl, extended, map_text

SPAN = "struct<type:string,start:bigint,end:bigint>"

# Magic bytes of common formats.
MAGIC = {
    "image/png": [b"\x89PNG\r\n\x1a\n"],
    "image/gif": [b"GIF87a", b"GIF89a"],
    "image/jpeg": [b"\xff\xd8\xff"],
    "riff": [b"RIFF"],
    "application/gzip": [b"\x1f\x8b\x08"],
    "application/zip": [b"PK\x03\x04"],
    "application/pdf": [b"%PDF-"],
    "audio/ogg": [b"OggS"],
    "audio/flac": [b"fLaC"],
}
# Types of RIFF forms.
RIFF_FORMS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, magics in MAGIC.items():
        for magic in magics:
            found.add_word(magic.decode("latin-1"), (kind, len(magic)))
    found.make_automaton()
    return found


class Trailers:
    """Where a trailer stands next; places are asked for in ascending order, so each byte is searched once for each trailer."""

    def __init__(self, b: bytes):
        self.b, self.next = b, {}

    def after(self, trailer: bytes, at: int) -> int:
        there, since = self.next.get(trailer, (0, len(self.b) + 1))
        if not since <= at or 0 <= there < at:
            since, there = at, self.b.find(trailer, at)
            self.next[trailer] = there, since
        return there


def _png(b: bytes, at: int, next_: Trailers) -> int:
    i = at + 8
    while i + 12 <= len(b):
        n = int.from_bytes(b[i : i + 4], "big")
        if i + 12 + n > len(b) or zlib.crc32(b[i + 4 : i + 8 + n]) != int.from_bytes(b[i + 8 + n : i + 12 + n], "big"):
            return -1
        if b[i + 4 : i + 8] == b"IEND":
            return i + 12 + n
        i += 12 + n
    return -1


def _gif(b: bytes, at: int, next_: Trailers) -> int:
    def blocks(i: int) -> int:
        while i < len(b) and b[i]:
            i += b[i] + 1
        return i + 1

    if at + 13 > len(b):
        return -1
    i = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 128 else 0)
    while i < len(b):
        if b[i] == 0x3B:
            return i + 1
        if b[i] == 0x21:
            i = blocks(i + 2)
        elif b[i] == 0x2C and i + 10 <= len(b):
            i = blocks(i + 11 + (3 << (b[i + 9] & 7) + 1 if b[i + 9] & 128 else 0))
        else:
            return -1
    return -1


def _jpeg(b: bytes, at: int, next_: Trailers) -> int:
    i = at + 2
    while i + 4 <= len(b) and b[i] == 0xFF:
        if b[i + 1] == 0xDA:
            end = next_.after(b"\xff\xd9", i)
            return end + 2 if end >= 0 else -1
        n = int.from_bytes(b[i + 2 : i + 4], "big")
        if n < 2:
            return -1
        i += 2 + n
    return -1


def _riff(b: bytes, at: int, next_: Trailers) -> int:
    if at + 12 > len(b) or b[at + 8 : at + 12] not in RIFF_FORMS:
        return -1
    end, i = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little"), at + 12
    if end > len(b):
        return -1
    while i + 8 <= end:
        n = int.from_bytes(b[i + 4 : i + 8], "little")
        i += 8 + n + (n & 1)
    return end if i in (end, end + 1) else -1


def _gzip(b: bytes, at: int, next_: Trailers) -> int:
    d = zlib.decompressobj(31)
    try:
        rest = memoryview(b)[at:]
        while rest and not d.eof:
            d.decompress(rest[: 1 << 20] if not d.unconsumed_tail else d.unconsumed_tail, 1 << 20)
            rest = rest[1 << 20 :] if not d.unconsumed_tail else rest
    except zlib.error:
        return -1
    return len(b) - len(rest) - len(d.unused_data) if d.eof else -1


def _zip(b: bytes, at: int, next_: Trailers) -> int:
    end = next_.after(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return -1
    size, offset, comment = struct.unpack("<IIH", b[end + 12 : end + 22])
    return end + 22 + comment if at + offset + size == end and end + 22 + comment <= len(b) else -1


def _pdf(b: bytes, at: int, next_: Trailers) -> int:
    end = next_.after(b"%%EOF", at)
    return end + 5 if end >= 0 and 0 <= next_.after(b"startxref", at) < end else -1


def _ogg(b: bytes, at: int, next_: Trailers) -> int:
    i = at
    while b[i : i + 4] == b"OggS" and i + 27 <= len(b):
        n = b[i + 26]
        i += 27 + n + sum(b[i + 27 : i + 27 + n])
    return i if at < i <= len(b) else -1


def _flac(b: bytes, at: int, next_: Trailers) -> int:
    return len(b) if at + 42 <= len(b) and b[at + 4] & 127 == 0 and int.from_bytes(b[at + 5 : at + 8], "big") == 34 else -1


VALID = {"image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "riff": _riff, "application/gzip": _gzip, "application/zip": _zip, "application/pdf": _pdf, "audio/ogg": _ogg, "audio/flac": _flac}


def objects(b: bytes, inside: tuple[int, int] | None = None) -> list[tuple[str, int, int]]:
    """Valid media objects (type, start, end) in ``b`` or between two places of it, in order, none within another."""
    a, z = inside or (0, len(b))
    out, done = [], a
    part, b = b[a:z], b if z == len(b) else b[:z]
    next_ = Trailers(b)
    for last, (kind, n) in automaton().iter(part.decode("latin-1")):
        at = a + last - n + 1
        if at >= done and (end := VALID[kind](b, at, next_)) > at:
            out.append((RIFF_FORMS[b[at + 8 : at + 12]] if kind == "riff" else kind, at, end))
            done = end
    return out


def sniff(df: DataFrame, media: str = "media", declared: str | None = None) -> DataFrame:
    """``df`` with ``media_type`` (corrected), ``type_changed`` and ``objects`` (what stands in the bytes) beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, media):
                said = part.column(declared).to_pylist() if declared else [None] * part.num_rows
                kinds, found = [], []
                for raw, was in zip(part.column(media).to_pylist(), said, strict=True):
                    spans = objects(raw or b"")
                    kinds.append(spans[0][0] if spans and spans[0][1] == 0 else was if raw and was else "application/octet-stream" if raw else "application/x-empty")
                    found.append([{"type": t, "start": a, "end": z} for t, a, z in spans])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(kinds), pa.array([k != w for k, w in zip(kinds, said, strict=True)]), pa.array(found, pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], [*part.schema.names, "media_type", "type_changed", "objects"])

    return df.mapInArrow(run, extended(df, media_type="string", type_changed="boolean", objects=f"array<{SPAN}>"))


def wav(payload: bytes, rate: int = 8000) -> bytes:
    """A mono WAVE file whose unsigned 8-bit samples are ``payload``."""
    odd = b"\0" * (len(payload) & 1)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(odd), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload + odd


def samples(b: bytes) -> tuple[int, int, int]:
    """Of a WAVE file: its rate, and where its samples begin and end."""
    i, rate = 12, 0
    while i + 8 <= len(b):
        n = int.from_bytes(b[i + 4 : i + 8], "little")
        if b[i : i + 4] == b"fmt ":
            rate = int.from_bytes(b[i + 12 : i + 16], "little")
        if b[i : i + 4] == b"data":
            return rate, i + 8, i + 8 + n
        i += 8 + n + (n & 1)
    raise ValueError("no samples")


def store_texts(df: DataFrame, key: str = "doc_id", text: str = "text", unit: int = 64) -> DataFrame:
    """``key``, ``n_bytes`` and ``media``: the text's UTF-8, zero bytes up to a positive multiple of ``unit``, as WAVE."""

    def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw = [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([len(x) for x in raw], pa.int64()), pa.array([wav(x.ljust(max(unit, -(-len(x) // unit) * unit), b"\0")) for x in raw], pa.binary())], [key, "n_bytes", "media"])

    return map_text(df, key, text, run, f"`{key}` {ddl(df, key)}, n_bytes long, media binary")


def described(df: DataFrame) -> DataFrame:
    """What the stored sounds of :func:`store_texts`, read back, hold; ``df`` is the result of :func:`sniff` on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, "media"):
                rows = []
                for raw, kind in zip(part.column("media").to_pylist(), part.column("media_type").to_pylist(), strict=True):
                    rate, a, z = samples(raw)
                    payload = raw[a:z]
                    wave = np.frombuffer(payload, np.uint8)
                    inner = objects(raw, (a, z))
                    feature = f"{kind};rate={rate};samples={z - a};sum={int(wave.sum(dtype=np.int64))};peak={int(wave.max(initial=0))};distinct={int(np.count_nonzero(np.bincount(wave, minlength=256)))};embedded={','.join(f'{t}:{i - a}:{j - a}' for t, i, j in inner)}"
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("n_bytes"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["key", "n_bytes", *NAMES])

    NAMES = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    key = df.columns[0]
    kind = ddl(df, key)
    out = df.select(F.col(key).alias("key"), "n_bytes", "media", "media_type").mapInArrow(run, f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.withColumnRenamed("key", key)
