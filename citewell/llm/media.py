"""Media columns with signature sniffing.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass
over the bytes; a validator of each format then reads its headers and lengths. What
passes at offset 0 is the true type, whatever was declared; what passes further in
and ends within the bytes is embedded media, which can be carved out.

Defined results: null content has type null and nothing embedded; a null text is
stored as an empty one; unknown and empty bytes have type
``application/octet-stream``; content of any length is read whole; repeated rows get
equal results; an empty table gives an empty result; only the named columns are read,
so further columns may have any names.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache, cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from citewell import ship
from citewell.llm.common import documents

UNKNOWN = "application/octet-stream"
WAV = "audio/wav"
BLOCK = 64
RATE = 8000


def _wav(data: bytes, at: int) -> int | None:
    """The end of a RIFF WAVE with a format and a data chunk, or None."""
    if data[at + 8 : at + 12] != b"WAVE" or at + 12 > len(data):
        return None
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if end > len(data):
        return None
    seen, k = set(), at + 12
    while k + 8 <= end:
        size = struct.unpack_from("<I", data, k + 4)[0]
        seen.add(data[k : k + 4])
        k += 8 + size + size % 2
    return end if {b"fmt ", b"data"} <= seen and k in (end, end + 1) else None


def _png(data: bytes, at: int) -> int | None:
    """Chunks with right checksums from IHDR to IEND."""
    k, first = at + 8, True
    while k + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, k)
        stop = k + 12 + size
        if stop > len(data) or first != (kind == b"IHDR"):
            return None
        if zlib.crc32(data[k + 4 : stop - 4]) != struct.unpack_from(">I", data, stop - 4)[0]:
            return None
        if kind == b"IEND":
            return stop
        k, first = stop, False
    return None


def _gif(data: bytes, at: int) -> int | None:
    """Header, then blocks up to the trailer."""
    if at + 13 > len(data):
        return None
    flags = data[at + 10]
    k = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    while k < len(data):
        kind = data[k]
        if kind == 0x3B:
            return k + 1
        if kind == 0x2C and k + 10 <= len(data):
            flags = data[k + 9]
            k += 11 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
        elif kind == 0x21:
            k += 2
        else:
            return None
        while k < len(data) and data[k]:
            k += data[k] + 1
        k += 1
    return None


def _jpeg(data: bytes, at: int) -> int | None:
    """Segments with lengths up to the scan, then the end marker."""
    k = at + 2
    while k + 4 <= len(data) and data[k] == 0xFF:
        kind, size = data[k + 1], struct.unpack_from(">H", data, k + 2)[0]
        if size < 2 or not 0xC0 <= kind <= 0xFE or kind == 0xD9:
            return None
        k += 2 + size
        if kind == 0xDA:
            end = marks(data).first(b"\xff\xd9", k)
            return end + 2 if end >= 0 else None
    return None


def _bmp(data: bytes, at: int) -> int | None:
    """File size, pixel offset and header size agree."""
    if at + 30 > len(data):
        return None
    size, zero, offset, header, _, _, planes, depth = struct.unpack_from("<IIIIiiHH", data, at + 2)
    good = zero == 0 and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and header in (12, 40, 108, 124)
    return at + size if good and 14 + header <= offset <= size <= len(data) - at else None


def _gzip(data: bytes, at: int) -> int | None:
    """A member that inflates whole, with its checksum."""
    inflate = zlib.decompressobj(31)
    try:
        k = at
        while k < len(data) and not inflate.eof:
            inflate.decompress(data[k : k + 65536])
            k += 65536
    except zlib.error:
        return None
    return min(k, len(data)) - len(inflate.unused_data) if inflate.eof else None


class Marks:
    """Places of what validators look for beyond their header, found once for all the
    headers of the bytes."""

    def __init__(self, data: bytes):
        self.data = data
        self.places: dict[bytes, list[int]] = {}

    def of(self, mark: bytes) -> list[int]:
        if mark not in self.places:
            self.places[mark] = [m.start() for m in re.finditer(re.escape(mark), self.data)]
        return self.places[mark]

    def first(self, mark: bytes, at: int) -> int:
        """The first place from ``at`` on, or -1."""
        places = self.of(mark)
        k = bisect_left(places, at)
        return places[k] if k < len(places) else -1

    def last(self, mark: bytes, before: int) -> int:
        """The last place that ends before ``before``, or -1."""
        places = self.of(mark)
        k = bisect_left(places, before - len(mark) + 1)
        return places[k - 1] if k else -1

    @cached_property
    def archives(self) -> dict[int, int]:
        """Start and end of what the end records of the bytes describe; the first that
        tells of a start counts."""
        found: dict[int, int] = {}
        for k in self.of(b"PK\x05\x06"):
            if k <= len(self.data) - 22:
                size, offset, comment = struct.unpack_from("<IIH", self.data, k + 12)
                if k + 22 + comment <= len(self.data):
                    found.setdefault(k - size - offset, k + 22 + comment)
        return found

    @cached_property
    def pdf_ends(self) -> list[tuple[int, int, int]]:
        """Start, end and pointer of each end marker with a cross-reference pointer."""
        return [(m.start(), m.end(), int(m[1])) for m in PDF_END.finditer(self.data)]

    @cached_property
    def pdf_tables(self) -> set[int]:
        return {m.start() for m in PDF_TABLE.finditer(self.data)}


@lru_cache(maxsize=1)
def marks(data: bytes) -> Marks:
    return Marks(data)


def _zip(data: bytes, at: int) -> int | None:
    """A local header, and the end record whose directory leads back to it."""
    if at + 30 > len(data) or struct.unpack_from("<H", data, at + 4)[0] > 63:
        return None
    return marks(data).archives.get(at)


PDF_END = re.compile(rb"startxref\s+(\d{1,12})\s+%%EOF")
#: Where a pointer may lead: a table, or the number of an object (at any of its digits).
PDF_TABLE = re.compile(rb"xref|\d(?=\d{0,11}\s+\d{1,12}\s+obj)")


def _pdf(data: bytes, at: int) -> int | None:
    """A version, and an end marker after a cross-reference pointer. Of the markers up
    to the next header after the first: the last whose pointer, counted from this
    header, meets a table, else the last."""
    if not data[at + 5 : at + 8].replace(b".", b"").isdigit():
        return None
    m = marks(data)
    pointer = m.first(b"startxref", at)
    first = m.first(b"%%EOF", pointer) if pointer >= 0 else -1
    if first < 0:
        return None
    after = m.first(b"%PDF-", first)
    after = after if after >= 0 else len(data)
    ends = m.pdf_ends
    for start, end, target in reversed(ends[bisect_left(ends, (pointer,)) : bisect_left(ends, (after,))]):
        if end <= after and at + target in m.pdf_tables:
            return end
    return m.last(b"%%EOF", after) + 5


#: Type, magic bytes, and validator that gives the end of the file.
FORMATS: tuple[tuple[str, bytes, Callable[[bytes, int], int | None]], ...] = (
    ("audio/wav", b"RIFF", _wav),
    ("image/png", b"\x89PNG\r\n\x1a\n", _png),
    ("image/gif", b"GIF87a", _gif),
    ("image/gif", b"GIF89a", _gif),
    ("image/jpeg", b"\xff\xd8\xff", _jpeg),
    ("image/bmp", b"BM", _bmp),
    ("application/gzip", b"\x1f\x8b\x08", _gzip),
    ("application/zip", b"PK\x03\x04", _zip),
    ("application/pdf", b"%PDF-", _pdf),
)


@cache
def automaton():
    """Of the magic bytes; bytes are read as Latin-1, one character each."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, (_, magic, _) in enumerate(FORMATS):
        found.add_word(magic.decode("latin-1"), k)
    found.make_automaton()
    return found


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """Type, start and end of all media that the validators confirm, outermost
    first, and after it what lies inside."""
    found = []
    for last, k in automaton().iter(data.decode("latin-1")):
        kind, magic, valid = FORMATS[k]
        at = last - len(magic) + 1
        if (end := valid(data, at)) is not None:
            found.append((kind, at, end))
    return sorted(found, key=lambda x: (x[1], -x[2], x[0]))


def true_type(found: list[tuple[str, int, int]]) -> str:
    return next((kind for kind, at, _ in found if at == 0), UNKNOWN)


def inspect(rows: DataFrame, content: str = "content", declared: str = "declared", key: str = "id") -> DataFrame:
    """key, declared, detected, corrected (they differ), embedded: type, start, end
    and carved bytes of media inside."""
    kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("content", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types, parts = [], []
            for data in batch.column(content).to_pylist():
                found = sniff(data) if data is not None else []
                types.append(true_type(found) if data is not None else None)
                parts.append([{"type": t, "start": a, "end": e, "content": data[a:e]} for t, a, e in found if a])
            said = batch.column(declared).to_pylist()
            wrong = [None if t is None else t != d for t, d in zip(types, said, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column(declared), pa.array(types, pa.string()), pa.array(wrong, pa.bool_()), pa.array(parts, kind)],
                [key, declared, "detected", "corrected", "embedded"],
            )

    ship()
    schema = (
        f"{key} {rows.schema[key].dataType.simpleString()}, {declared} string, detected string, corrected boolean, "
        "embedded array<struct<type:string,start:bigint,end:bigint,content:binary>>"
    )
    return rows.select(key, declared, content).mapInArrow(run, schema)


def stored(payload: bytes) -> bytes:
    """The payload as 8-bit mono samples of a WAV file."""
    form = struct.pack("<HHIIHH", 1, 1, RATE, RATE, 1, 8)
    data = b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def samples(media: bytes) -> bytes:
    """The samples of the WAV file, found by its chunks."""
    k = 12
    while k + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, k)
        if name == b"data":
            return media[k + 8 : k + 8 + size]
        k += 8 + size + size % 2
    raise ValueError("no data chunk")


def features(media: bytes, payload: bytes) -> str:
    """True type, samples, mean and spread of the samples, and embedded media."""
    found = sniff(media)
    counts = np.bincount(np.frombuffer(payload, dtype=np.uint8), minlength=256)
    n, values = len(payload), np.arange(256)
    total, squares = int((counts * values).sum()), int((counts * values * values).sum())
    inside = ",".join(f"{t}@{a}-{e}" for t, a, e in found if a)
    return f"type={true_type(found)};samples={n};sum={total};squares={squares};values={int((counts > 0).sum())};inside={inside}"


def digest(docs: DataFrame) -> DataFrame:
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def one(text: str | None) -> tuple:
        data = (text or "").encode()
        media = stored(data + b"\0" * (-len(data) % BLOCK or BLOCK * (not data)))
        payload = samples(media)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return len(data), len(payload), sha(payload), zlib.crc32(payload[-BLOCK:]), len(media), sha(media), features(media, payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(t.as_py()) for t in batch.column("text")]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *names])

    ship()
    kinds = ["bigint" if t == pa.int64() else "string" for t in types]
    schema = ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *(f"{n} {k}" for n, k in zip(names, kinds, strict=True))])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))
