"""Media columns: lossless storage as 8-bit samples, and signature sniffing.

An Aho-Corasick automaton finds all magic bytes in one pass; a validator for each format then confirms structure and length. What begins
at byte 0 gives the true type, whatever was declared; confirmed media further in are carved out as (type, start, length).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import pieces, staged

PAD, RATE = 64, 8000


def wav(payload: bytes) -> bytes:
    """8-bit mono PCM whose samples are the payload's bytes; the payload's length is even."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def _riff(d: memoryview, at: int, end_of: Ends) -> int | None:
    if len(d) < at + 12 or bytes(d[at + 8 : at + 12]) != b"WAVE":
        return None
    end, seen, p = at + 8 + int.from_bytes(d[at + 4 : at + 8], "little"), set(), at + 12
    if end > len(d):
        return None
    while p + 8 <= end:
        name, n = bytes(d[p : p + 4]), int.from_bytes(d[p + 4 : p + 8], "little")
        if p + 8 + n > end:
            return None
        seen.add(name)
        p += 8 + n + (n & 1)
    return end - at if {b"fmt ", b"data"} <= seen else None


def _png(d: memoryview, at: int, end_of: Ends) -> int | None:
    p = at + 8
    first = True
    while p + 12 <= len(d):
        n, name = int.from_bytes(d[p : p + 4], "big"), bytes(d[p + 4 : p + 8])
        if p + 12 + n > len(d) or first and (name != b"IHDR" or n != 13) or zlib.crc32(d[p + 4 : p + 8 + n]) != int.from_bytes(d[p + 8 + n : p + 12 + n], "big"):
            return None
        p, first = p + 12 + n, False
        if name == b"IEND":
            return p - at
    return None


def _gif(d: memoryview, at: int, end_of: Ends) -> int | None:
    if len(d) < at + 13:
        return None
    flags, p = d[at + 10], at + 13
    p += 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    while p < len(d):
        mark = d[p]
        if mark == 0x3B:
            return p + 1 - at
        if mark == 0x21:
            p += 2
        elif mark == 0x2C:
            if p + 10 > len(d):
                return None
            p += 10 + (3 << ((d[p + 9] & 7) + 1) if d[p + 9] & 0x80 else 0) + 1
        else:
            return None
        while p < len(d) and d[p]:
            p += d[p] + 1
        p += 1
    return None


class Ends:
    """Where the next end mark lies; starts come in rising order, so each byte is searched once a mark."""

    def __init__(self, media: bytes) -> None:
        self.media, self.known = media, {}

    def __call__(self, mark: bytes, at: int) -> int:
        if self.known.get(mark, -2) != -1 and self.known.get(mark, -2) < at:
            self.known[mark] = self.media.find(mark, at)
        return self.known[mark]


def _jpeg(d: memoryview, at: int, end_of: Ends) -> int | None:
    p = at + 2
    while p + 4 <= len(d) and d[p] == 0xFF:
        mark = d[p + 1]
        if mark == 0xDA:  # entropy-coded data follows, up to the end mark
            end = end_of(b"\xff\xd9", p)
            return end + 2 - at if end >= 0 else None
        if not 0xC0 <= mark <= 0xFE:
            return None
        p += 2 + int.from_bytes(d[p + 2 : p + 4], "big")
    return None


def _bmp(d: memoryview, at: int, end_of: Ends) -> int | None:
    if len(d) < at + 30:
        return None
    size, spare, pixels, head = struct.unpack("<IIII", d[at + 2 : at + 18])
    return size if not spare and head in (12, 40, 108, 124) and 14 + head <= pixels <= size <= len(d) - at else None


def _pdf(d: memoryview, at: int, end_of: Ends) -> int | None:
    raw = bytes(d[at : at + 8])
    if not (len(raw) == 8 and raw[5:6].isdigit() and raw[6:7] == b"." and raw[7:8].isdigit()):
        return None
    end = end_of(b"%%EOF", at)
    return end + 5 - at if end >= 0 else None


def _zip(d: memoryview, at: int, end_of: Ends) -> int | None:
    if len(d) < at + 30 or int.from_bytes(d[at + 4 : at + 6], "little") > 63:
        return None
    end = end_of(b"PK\x05\x06", at)
    if end < 0 or len(d) < end + 22:
        return None
    size, start, note = struct.unpack("<IIH", d[end + 12 : end + 22])
    return end + 22 + note - at if start + size == end - at and len(d) >= end + 22 + note else None


def _gzip(d: memoryview, at: int, end_of: Ends) -> int | None:
    if len(d) < at + 18 or d[at + 3] & 0xE0:
        return None
    unzip, p = zlib.decompressobj(31), at
    try:
        while not unzip.eof and p < len(d):
            unzip.decompress(d[p : p + 65536], 1 << 20)
            while unzip.unconsumed_tail and not unzip.eof:
                unzip.decompress(unzip.unconsumed_tail, 1 << 20)
            p += 65536
    except zlib.error:
        return None
    return min(p, len(d)) - len(unzip.unused_data) - at if unzip.eof else None


def _ogg(d: memoryview, at: int, end_of: Ends) -> int | None:
    p, last = at, False
    while not last and p + 27 <= len(d) and bytes(d[p : p + 5]) == b"OggS\0":
        n = d[p + 26]
        last = bool(d[p + 5] & 4)
        p += 27 + n + sum(d[p + 27 : p + 27 + n])
    return p - at if last and p <= len(d) else None


#: Magic bytes, type, validator (fixed values of the formats).
SIGNATURES: list[tuple[bytes, str, Callable[[memoryview, int, "Ends"], int | None]]] = [
    (b"RIFF", "audio/wav", _riff),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"BM", "image/bmp", _bmp),
    (b"%PDF-", "application/pdf", _pdf),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"OggS", "audio/ogg", _ogg),
]


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, kind, valid in SIGNATURES:
        found.add_word(magic.decode("latin-1"), (len(magic), kind, valid))
    found.make_automaton()
    return found


def sniffed(media: bytes) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The type of what begins at byte 0 (None: no known one), and (type, start, length) of media further in that don't overlap."""
    kind, carved, free = None, [], 1
    view, end_of = memoryview(media), Ends(media)
    for last, (n, name, valid) in _automaton().iter(media.decode("latin-1")):
        at = last - n + 1
        if at and at < free:
            continue
        length = valid(view, at, end_of)
        if length and not at:
            kind = name
        elif length:
            carved.append((name, at, length))
            free = at + length
    return kind, carved


def samples(media: bytes) -> bytes:
    """The sample bytes of a confirmed wav."""
    p = 12
    while media[p : p + 4] != b"data":
        p += 8 + int.from_bytes(media[p + 4 : p + 8], "little") + (int.from_bytes(media[p + 4 : p + 8], "little") & 1)
    return media[p + 8 : p + 8 + int.from_bytes(media[p + 4 : p + 8], "little")]


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        media = [wav(t.ljust(max(PAD, -(-len(t) // PAD) * PAD), b"\0")) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def _read(declared: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "media"):
            out = []
            for doc, n, media in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                kind, carved = sniffed(media)
                payload = samples(media) if kind == "audio/wav" else media
                feature = f"type={kind or declared};declared={declared};samples={len(payload)};carved=" + ",".join(f"{k}@{a}+{m}" for k, a, m in carved)
                out.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k in (3, 6, 7) else pa.int64()) for k, c in enumerate(zip(*out, strict=True))], names)

    return run


def media_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: every text as a wav, in the shared folder."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return staged(source.mapInArrow(_store, "doc_id long, n_bytes long, media binary"), "media")


def media_features(media: DataFrame, declared: str = "text/plain") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, from the stored bytes.

    Null and empty texts are stored as PAD zero bytes. Repeated rows, and null ids, give a row each; equal texts give equal values.
    An empty table gives no rows. Media that are no wav are their own payload. Other columns play no part.
    """
    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.mapInArrow(_read(declared), kinds)
