"""Media columns: payloads stored as media files, and signature sniffing that finds out what a stored file really is.

An Aho-Corasick automaton over magic bytes finds every place where a format may begin; a validator for each format
then confirms structure and lengths there. The confirmed format at offset 0 corrects the declared type; confirmed
files further in are carved out.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

#: Payloads are padded with byte 255 to a positive multiple of this.
UNIT = 576
RATE = 8000
#: Bytes that an inflater takes, and gives, at once.
PIECE = 1 << 16


@dataclass(frozen=True)
class Found:
    kind: str
    start: int
    end: int


class Marks:
    """Places of the marks that end formats without lengths. They are looked for once, however often a format seems to begin."""

    def __init__(self, data: bytes):
        self.data = data

    def _places(self, mark: bytes) -> list[int]:
        return [m.start() for m in re.finditer(re.escape(mark), self.data)]

    @cached_property
    def pdf_end(self) -> int:
        return self.data.rfind(b"%%EOF")

    @cached_property
    def pdf_reference(self) -> int:
        """The last cross-reference before the end mark."""
        return self.data.rfind(b"startxref", 0, max(0, self.pdf_end))

    @cached_property
    def zip_ends(self) -> list[int]:
        return self._places(b"PK\5\6")

    @cached_property
    def jpeg_ends(self) -> list[int]:
        return self._places(b"\xff\xd9")


def _u(data: bytes, at: int, size: int, order: str = "little") -> int:
    return int.from_bytes(data[at : at + size], order) if at + size <= len(data) else -1


def _riff(data: bytes, at: int, marks: Marks) -> Found | None:
    """RIFF/WAVE: chunk lengths add up to the form's length, with a format and a data chunk."""
    end, form = at + 8 + _u(data, at + 4, 4), data[at + 8 : at + 12]
    if end > len(data) or form != b"WAVE":
        return None
    here, seen = at + 12, set()
    while here + 8 <= end:
        seen.add(data[here : here + 4])
        here += 8 + _u(data, here + 4, 4)
        here += here & 1 if here < end else 0
    return Found("audio/wav", at, end) if here == end and {b"fmt ", b"data"} <= seen else None


def _png(data: bytes, at: int, marks: Marks) -> Found | None:
    """Chunks with right checksums from IHDR to IEND."""
    here, first = at + 8, True
    while here + 12 <= len(data):
        size, kind = _u(data, here, 4, "big"), data[here + 4 : here + 8]
        if here + 12 + size > len(data) or first and (kind, size) != (b"IHDR", 13) or zlib.crc32(data[here + 4 : here + 8 + size]) != _u(data, here + 8 + size, 4, "big"):
            return None
        here, first = here + 12 + size, False
        if kind == b"IEND":
            return Found("image/png", at, here)
    return None


def _bmp(data: bytes, at: int, marks: Marks) -> Found | None:
    size, offset, head = _u(data, at + 2, 4), _u(data, at + 10, 4), _u(data, at + 14, 4)
    planes, depth = _u(data, at + 26, 2), _u(data, at + 28, 2)
    ok = head in (40, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and 14 + head <= offset <= size and at + size <= len(data)
    return Found("image/bmp", at, at + size) if ok else None


def _gif(data: bytes, at: int, marks: Marks) -> Found | None:
    """Blocks from the screen descriptor to the trailer."""
    if at + 13 > len(data):
        return None
    flags = data[at + 10]
    here = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    while here < len(data):
        mark = data[here]
        if mark == 0x3B:
            return Found("image/gif", at, here + 1)
        if mark == 0x21:
            here += 2
        elif mark == 0x2C and here + 10 < len(data):
            local = data[here + 9]
            here += 11 + (3 << (local & 7) + 1 if local & 128 else 0)
        else:
            return None
        while here < len(data) and data[here]:
            here += 1 + data[here]
        here += 1
    return None


def _jpeg(data: bytes, at: int, marks: Marks) -> Found | None:
    """Segments with right lengths up to the scan, then the end marker."""
    here = at + 2
    while here + 4 <= len(data) and data[here] == 0xFF:
        if data[here + 1] == 0xDA:
            i = bisect_left(marks.jpeg_ends, here)
            return Found("image/jpeg", at, marks.jpeg_ends[i] + 2) if i < len(marks.jpeg_ends) else None
        size = _u(data, here + 2, 2, "big")
        if size < 2:
            return None
        here += 2 + size
    return None


def _gzip(data: bytes, at: int, marks: Marks) -> Found | None:
    """A stream that inflates to its end, with the right checksum. Input and output go through in pieces of bounded size."""
    stream, here = zlib.decompressobj(31), at
    try:
        while not stream.eof and here < len(data):
            rest = data[here : here + PIECE]
            here += len(rest)
            while rest and not stream.eof:
                stream.decompress(rest, PIECE)
                rest = stream.unconsumed_tail
    except zlib.error:
        return None
    return Found("application/gzip", at, here - len(stream.unused_data)) if stream.eof else None


def _pdf(data: bytes, at: int, marks: Marks) -> Found | None:
    """From the magic bytes to the last end mark, with a cross-reference between them."""
    return Found("application/pdf", at, marks.pdf_end + 5) if at <= marks.pdf_reference else None


def _zip(data: bytes, at: int, marks: Marks) -> Found | None:
    """The first end record behind `at` points back to the directory, which points to the first entry."""
    i = bisect_left(marks.zip_ends, at)
    end = marks.zip_ends[i] if i < len(marks.zip_ends) else len(data)
    if end + 22 > len(data):
        return None
    size, offset, stop = _u(data, end + 12, 4), _u(data, end + 16, 4), end + 22 + _u(data, end + 20, 2)
    return Found("application/zip", at, stop) if at + offset + size == end and stop <= len(data) else None


#: Magic bytes and validators (fixed values of the formats).
SIGNATURES: dict[bytes, Callable[[bytes, int, Marks], Found | None]] = {
    b"RIFF": _riff,
    b"\x89PNG\r\n\x1a\n": _png,
    b"BM": _bmp,
    b"GIF87a": _gif,
    b"GIF89a": _gif,
    b"\xff\xd8\xff": _jpeg,
    b"\x1f\x8b\x08": _gzip,
    b"%PDF-": _pdf,
    b"PK\3\4": _zip,
}


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic in SIGNATURES:
        found.add_word(magic.decode("latin-1"), magic)
    found.make_automaton()
    return found


def sniff(data: bytes) -> list[Found]:
    """Confirmed media in data, leftmost first; files inside a confirmed one follow it if they lie wholly within."""
    out, marks = [], Marks(data)
    for end, magic in _automaton().iter(data.decode("latin-1")):
        found = SIGNATURES[magic](data, end + 1 - len(magic), marks)
        if found:
            out.append(found)
    return sorted(out, key=lambda f: (f.start, -f.end))


def resolve(data: bytes, declared: str | None) -> tuple[str | None, bool, list[Found]]:
    """(actual type, whether the declared one was wrong, carved files). With nothing confirmed at offset 0 the declared type stands."""
    found = sniff(data)
    whole = next((f for f in found if f.start == 0), None)
    actual = whole.kind if whole else declared
    return actual, actual != declared, [f for f in found if f is not whole]


def sniffed(df: DataFrame, media: str = "media", declared: str = "declared", key: str = "doc_id") -> DataFrame:
    """For each row: key, media_type, corrected, carved array of (media_type, start, length, media).

    A null media value has no type of its own: the declared one stands and nothing is carved. No shuffle.
    """
    carved = "array<struct<media_type: string, start: long, length: long, media: binary>>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [resolve(d or b"", t) for d, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            cuts = [[{"media_type": f.kind, "start": f.start, "length": f.end - f.start, "media": d[f.start : f.end]} for f in r[2]] for r, d in zip(rows, batch.column(1).to_pylist(), strict=True)]
            kind = pa.list_(pa.struct([("media_type", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("media", pa.binary())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_()), pa.array(cuts, kind)], [key, "media_type", "corrected", "carved"])

    kind = dict(df.dtypes)[key]
    return df.select(key, media, declared).mapInArrow(scan, f"`{key}` {kind}, media_type string, corrected boolean, carved {carved}")


def payload_of(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % UNIT or (0 if text else UNIT))


def to_wav(payload: bytes) -> bytes:
    """8-bit mono PCM; a payload's length is a multiple of 576, so no chunk needs a pad byte."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def from_wav(data: bytes) -> bytes:
    here, end = 12, 8 + _u(data, 4, 4)
    while here < end:
        size = _u(data, here + 4, 4)
        if data[here : here + 4] == b"data":
            return data[here + 8 : here + 8 + size]
        here += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def stored(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as media: doc_id, n_bytes, media (WAV), declared (the type that an uploader would claim)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([to_wav(payload_of(t)) for t in texts], pa.binary()), pa.array(["application/octet-stream"] * len(texts), pa.string())], ["doc_id", "n_bytes", "media", "declared"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, "doc_id long, n_bytes long, media binary, declared string")


def features(docs: DataFrame) -> DataFrame:
    """Each document's text, stored as media and read back: sizes, digests and a feature string.

    The feature has the sniffed type, whether the declared one was corrected, length, mean and spread of the samples,
    and each carved file's type, place and length. A null text counts as empty, whose payload is one unit of padding.
    Equal texts have equal values; rows are independent. No shuffle.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, data, declared in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                actual, corrected, carved = resolve(data, declared)
                payload = from_wav(data)
                samples = np.frombuffer(payload, np.uint8)
                mean = int(samples.sum(dtype=np.int64)) / len(samples)
                peaks = int(samples.min()), int(samples.max())
                cuts = ",".join(f"{f.kind}@{f.start}+{f.end - f.start}" for f in carved)
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), f"type={actual};corrected={int(corrected)};samples={len(samples)};mean={mean:.6f};range={peaks[0]}-{peaks[1]};carved={cuts}"))
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored(docs).mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
