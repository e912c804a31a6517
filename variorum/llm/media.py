"""Signature sniffing of media columns (operator 6).

One Aho-Corasick pass over a value's bytes locates the magic bytes of all known formats at once.  A
magic alone proves nothing, so a validator of its format walks the structure (chunk lengths, checksums,
header fields) and gives the length, or rejects it.  A valid signature at the start corrects the declared
type; valid ones further in are embedded media, carved by offset and length.

Nulls and empty values are of no type (null), with nothing embedded.  A value whose start isn't valid
keeps no type either, whatever was declared, but is still searched for embedded media.  Embedded media
inside other embedded media aren't listed; carve and sniff those again.

The marks that end a format are located in the same pass, so no validator searches the rest of a value
for each magic: long values full of magics cost their length.  Repeated rows are sniffed alike, an empty
table gives an empty result, and input columns that have the name of a result are replaced by it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import batches, out_batch, table

WIDTH = 64


# ---- validators: bytes and the offset of the magic -> length, or None ----------------------------


class Value:
    """The bytes of one value with the places of end marks, found in the same pass as the magics, and the places
    from which a walk is known to lead nowhere; so each validator's searches cost their results only."""

    def __init__(self, data: bytes, marks: dict[bytes, list[int]]):
        self.data, self.marks = data, marks
        self.dead: set[int] = set()
        self.zeros = 1, 0

    def zero(self, at: int) -> int:
        """The first zero byte from ``at`` on, or -1; stretches without one are searched once."""
        low, next_ = self.zeros
        if not (low <= at and (next_ < 0 or at <= next_)):
            self.zeros = at, self.data.find(0, at)
        return self.zeros[1]

    def find(self, mark: bytes, at: int, stop: int | None = None) -> int:
        """The first place of an end mark from ``at`` on (and before ``stop``), or -1."""
        places = self.marks.get(mark, [])
        k = bisect_left(places, at)
        found = k < len(places) and (stop is None or places[k] + len(mark) <= stop)
        return places[k] if found else -1


def _wav(b: bytes, at: int) -> int | None:
    if b[at + 8 : at + 12] != b"WAVE":
        return None
    (size,) = struct.unpack_from("<I", b, at + 4)
    stop, i, seen = at + 8 + size, at + 12, set()
    if stop > len(b):
        return None
    while i + 8 <= stop:
        seen.add(b[i : i + 4])
        i += 8 + (n := struct.unpack_from("<I", b, i + 4)[0]) + n % 2
    return stop - at if i == stop and {b"fmt ", b"data"} <= seen else None


def _au(b: bytes, at: int) -> int | None:
    if at + 24 > len(b):
        return None
    head, size, encoding, rate, channels = struct.unpack_from(">5I", b, at + 4)
    fine = 24 <= head <= 4096 and encoding in (1, 2, 3, 4, 5, 6, 7) and 0 < rate <= 1 << 20 and 0 < channels <= 64
    return head + size if fine and at + head + size <= len(b) else None


def _bmp(b: bytes, at: int) -> int | None:
    if at + 54 > len(b):
        return None
    size, zero, offset, head, width, height, planes, depth = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if zero or head not in (40, 108, 124) or planes != 1 or depth not in (1, 4, 8, 16, 24, 32) or width <= 0:
        return None
    row = (width * depth + 31) // 32 * 4
    return size if offset >= 14 + head and offset + row * abs(height) <= size and at + size <= len(b) else None


def _png(b: bytes, at: int) -> int | None:
    i, first = at + 8, True
    while i + 12 <= len(b):
        (n,) = struct.unpack_from(">I", b, i)
        kind = b[i + 4 : i + 8]
        if i + 12 + n > len(b) or first != (kind == b"IHDR"):
            return None
        if zlib.crc32(memoryview(b)[i + 4 : i + 8 + n]) != struct.unpack_from(">I", b, i + 8 + n)[0]:
            return None
        i, first = i + 12 + n, False
        if kind == b"IEND":
            return i - at
    return None


def _gif(v: Value, at: int) -> int | None:
    b = v.data
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    i = at + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0)

    def blocks(i: int) -> int | None:
        walked = []
        while i < len(b) and i not in v.dead:
            if not b[i]:
                return i + 1
            walked.append(i)
            i += 1 + b[i]
        v.dead.update(walked)
        return None

    while i is not None and i < len(b):
        if b[i] == 0x3B:
            return i + 1 - at
        if b[i] == 0x21:
            i = blocks(i + 2)
        elif b[i] == 0x2C and i + 10 <= len(b):
            i = blocks(i + 11 + (3 << ((b[i + 9] & 7) + 1) if b[i + 9] & 128 else 0))
        else:
            return None
    return None


def _jpeg(v: Value, at: int) -> int | None:
    b, i = v.data, at + 2
    while i + 4 <= len(b) and b[i] == 0xFF:
        if b[i + 1] == 0xDA:
            end = v.find(b"\xff\xd9", i)
            return end + 2 - at if end >= 0 else None
        if not 0xC0 <= b[i + 1] <= 0xFE:
            return None
        i += 2 + struct.unpack_from(">H", b, i + 2)[0]
    return None


def _pdf(v: Value, at: int) -> int | None:
    end = v.find(b"%%EOF", at)
    return end + 5 - at if end >= 0 and v.find(b"startxref", at, end) >= 0 and v.data[at + 5 : at + 6].isdigit() else None


def _zip(v: Value, at: int) -> int | None:
    b, end = v.data, v.find(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return None
    size, offset, note = struct.unpack_from("<IIH", b, end + 12)
    return end + 22 + note - at if at + offset + size == end and b[at + offset : at + offset + 4] == b"PK\x01\x02" else None


def _gzip(v: Value, at: int) -> int | None:
    b = v.data
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return None
    flags, i = b[at + 3], at + 10
    if flags & 4:
        i += 2 + int.from_bytes(b[i : i + 2], "little")
    for _ in range((flags >> 3 & 1) + (flags >> 4 & 1)):  # name and comment end with a zero byte
        i = v.zero(i) + 1
        if not i:
            return None
    i += flags & 2
    d, crc, size = zlib.decompressobj(-15), 0, 0
    try:
        while not d.eof:
            part = d.unconsumed_tail
            if not part:
                part = b[i : i + 65536]
                i += len(part)
            out = d.decompress(part, 1 << 20)  # what comes out is dropped, so a small value can't fill the memory
            if not part and not out:
                return None
            crc, size = zlib.crc32(out, crc), size + len(out)
    except zlib.error:
        return None
    i -= len(d.unused_data)
    return i + 8 - at if i + 8 <= len(b) and struct.unpack_from("<II", b, i) == (crc, size & 0xFFFFFFFF) else None


#: The magic bytes of formats, with the validators above.
SIGNATURES: list[tuple[bytes, str, Callable[[Value, int], int | None]]] = [
    (b"RIFF", "wav", lambda v, at: _wav(v.data, at)),
    (b".snd", "au", lambda v, at: _au(v.data, at)),
    (b"BM", "bmp", lambda v, at: _bmp(v.data, at)),
    (b"\x89PNG\r\n\x1a\n", "png", lambda v, at: _png(v.data, at)),
    (b"GIF87a", "gif", _gif),
    (b"GIF89a", "gif", _gif),
    (b"\xff\xd8\xff", "jpeg", _jpeg),
    (b"%PDF-", "pdf", _pdf),
    (b"PK\x03\x04", "zip", _zip),
    (b"\x1f\x8b\x08", "gzip", _gzip),
]
#: The marks that end a format, located in the same pass.
END_MARKS = [b"\xff\xd9", b"%%EOF", b"startxref", b"PK\x05\x06"]
_AUTOMATON: list = []


def automaton():
    """The automaton of all magics and end marks (bytes as characters of the same number)."""
    if not _AUTOMATON:
        import ahocorasick

        a = ahocorasick.Automaton()
        for i, (magic, _, _) in enumerate(SIGNATURES):
            a.add_word(magic.decode("latin-1"), i)
        for mark in END_MARKS:
            a.add_word(mark.decode("latin-1"), mark)
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def sniff(data: bytes) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The type by the valid signature at the start, and embedded media (type, offset, length)."""
    kind, embedded, until = None, [], 0
    marks: dict[bytes, list[int]] = {}
    starts: list[tuple[int, int]] = []
    for end, what in automaton().iter(data.decode("latin-1")):
        if isinstance(what, bytes):
            marks.setdefault(what, []).append(end + 1 - len(what))
        else:
            starts.append((end + 1 - len(SIGNATURES[what][0]), what))
    value = Value(data, marks)
    for at, i in starts:
        _, name, validate = SIGNATURES[i]
        if at and at < until:
            continue
        length = validate(value, at)
        if length is None:
            continue
        if at == 0:
            kind = name
        else:
            embedded.append((name, at, length))
            until = at + length
    return kind, embedded


# ---- containers of 8-bit samples --------------------------------------------------------------------


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def store(payload: bytes, kind: str) -> bytes:
    """``payload`` (a positive multiple of 64 bytes) as the 8-bit samples of a container."""
    n, rows = len(payload), len(payload) // WIDTH
    if kind == "wav":
        head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", n)
        return b"RIFF" + struct.pack("<I", len(head) + n) + head + payload
    if kind == "au":
        return b".snd" + struct.pack(">5I", 24, n, 2, 8000, 1) + payload
    if kind == "bmp":
        gray = b"".join(bytes((i, i, i, 0)) for i in range(256))
        offset = 54 + len(gray)
        return b"BM" + struct.pack("<IIIIiiHHIIiiII", offset + n, 0, offset, 40, WIDTH, -rows, 1, 8, 0, n, 0, 0, 256, 0) + gray + payload
    lines = np.zeros((rows, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def samples(data: bytes, kind: str | None) -> bytes | None:
    """The samples of a container that ``store`` wrote, by its sniffed type."""
    if kind == "wav":
        at = data.index(b"data", 12)
        return data[at + 8 : at + 8 + struct.unpack_from("<I", data, at + 4)[0]]
    if kind == "au":
        head, size = struct.unpack_from(">II", data, 4)
        return data[head : head + size]
    if kind == "bmp":
        (offset,) = struct.unpack_from("<I", data, 10)
        width, height = struct.unpack_from("<ii", data, 18)
        return data[offset : offset + width * -height]
    if kind == "png":
        i, parts = 8, []
        while i < len(data):
            (n,) = struct.unpack_from(">I", data, i)
            if data[i + 4 : i + 8] == b"IDAT":
                parts.append(data[i + 8 : i + 8 + n])
            i += 12 + n
        width = struct.unpack_from(">I", data, 16)[0]
        return np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()
    return None


KINDS = ("wav", "au", "bmp", "png")
MEDIA = "doc_id long, n_bytes long, declared string, media binary"
_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("declared", pa.string()), ("media", pa.binary())])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as media: the container goes by the text's length, the declared type by its checksum (so
    that most declarations are wrong, as in crawled columns)."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(source, "text"):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), texts):
                raw = (text or "").encode("utf-8", "surrogatepass")
                payload = raw + bytes(-len(raw) % WIDTH if raw else WIDTH)
                rows.append((doc, len(raw), KINDS[zlib.crc32(raw) % len(KINDS)], store(payload, KINDS[len(raw) % len(KINDS)])))
            yield out_batch(_MEDIA, dict(zip(_MEDIA.names, zip(*rows))))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, MEDIA)


_SPAN = pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
SNIFFED = "actual string, corrected boolean, embedded array<struct<type: string, offset: bigint, length: bigint>>"
READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def feature(kind: str | None, embedded: int, payload: bytes) -> str:
    """Type, number of embedded media and statistics of the samples."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts[counts > 0] / max(1, len(payload))
    mean = float(counts @ np.arange(256)) / max(1, len(payload))
    return f"{kind};embedded={embedded};mean={mean:.4f};entropy={float(-(share * np.log2(share)).sum()):.4f};distinct={int((counts > 0).sum())}"


def inspect(media: DataFrame, media_col: str = "media", declared_col: str = "declared", read: bool = False) -> DataFrame:
    """The other columns of ``media`` with what sniffing found; with ``read``, what the samples hold too."""
    results = [f for part in ((SNIFFED, READ) if read else (SNIFFED,)) for f in media.sparkSession.createDataFrame([], part).schema]
    others = [c for c in media.columns if c != media_col and c not in {f.name for f in results}]
    schema = media.select(*others).schema
    for field in results:
        schema = schema.add(field)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            at, told = batch.num_columns - 1, batch.schema.get_field_index(declared_col)
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                values = part.column(at).to_pylist()
                found = [(None, []) if d is None else sniff(d) for d in values]
                columns = [*part.columns[:at], pa.array([x for x, _ in found], pa.string())]
                columns.append(pa.array([x is not None and x != d for (x, _), d in zip(found, part.column(told).to_pylist())], pa.bool_()))
                columns.append(pa.array([[{"type": t, "offset": o, "length": n} for t, o, n in e] for _, e in found], pa.list_(_SPAN)))
                names = [*part.schema.names[:at], "actual", "corrected", "embedded"]
                if read:
                    rows = []
                    for d, (kind, inner) in zip(values, found):
                        p = samples(d, kind) if d is not None else None
                        rows.append(
                            (None,) * 6
                            if p is None
                            else (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-WIDTH:]), len(d), hashlib.sha256(d).hexdigest(), feature(kind, len(inner), p))
                        )
                    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                    columns += [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                    names += ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return media.select(*others, media_col).mapInArrow(run, schema)


def carve(media: DataFrame, media_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """A row for each embedded medium: the other columns, type, offset and its bytes."""
    found = inspect(media.withColumn("_v_media", F.col(media_col)), "_v_media", declared_col)
    spans = found.withColumn("_v_span", F.explode("embedded")).drop("actual", "corrected", "embedded")
    body = F.substring(F.col(media_col), F.col("_v_span.offset").cast("int") + 1, F.col("_v_span.length").cast("int"))
    return spans.withColumns({"carved_type": F.col("_v_span.type"), "carved_offset": F.col("_v_span.offset"), "carved": body}).drop("_v_span", media_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op6_media_sniffing``: all documents as media, sniffed and read back."""
    found = inspect(store_texts(table(spark, sf_dir, "documents")), read=True)
    return found.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "declared", "actual", "corrected", F.to_json("embedded").alias("embedded")
    )
