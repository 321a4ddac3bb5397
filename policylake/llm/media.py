"""Media columns: signature sniffing with an Aho-Corasick automaton and format validators.

The automaton finds every magic number in one pass over a column's bytes. A validator for the format then walks the
structure from there (chunks, blocks, headers, checksums) and returns the length of the medium or nothing, so that bytes
which merely look like a signature are refused. A confirmed medium at the start corrects the declared type; those further
inside are carved out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

UNIT = 576
PAD = 255

#: Magic numbers: format and the distance of the magic from the start of the medium.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": ("image/png", 0),
    b"\xff\xd8\xff": ("image/jpeg", 0),
    b"GIF87a": ("image/gif", 0),
    b"GIF89a": ("image/gif", 0),
    b"BM": ("image/bmp", 0),
    b"WAVEfmt ": ("audio/wav", 8),
    b"WEBPVP8": ("image/webp", 8),
    b"fLaC": ("audio/flac", 0),
    b"OggS": ("audio/ogg", 0),
    b"%PDF-": ("application/pdf", 0),
    b"PK\x03\x04": ("application/zip", 0),
    b"\x1f\x8b\x08": ("application/gzip", 0),
}


def _png(b: memoryview) -> int | None:
    at, first = 8, True
    while at + 12 <= len(b):
        (size,) = struct.unpack_from(">I", b, at)
        kind = bytes(b[at + 4 : at + 8])
        end = at + 12 + size
        if end > len(b) or (first and (kind != b"IHDR" or size != 13)) or zlib.crc32(b[at + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if kind == b"IEND":
            return end
        at, first = end, False
    return None


def _jpeg(blob: bytes, start: int, seen: dict) -> int | None:
    at = start + 2
    while at + 2 <= len(blob):
        if blob[at] != 0xFF:
            return None
        kind = blob[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            return at + 2 - start
        (size,) = struct.unpack_from(">H", blob, at + 2) if at + 4 <= len(blob) else (0,)
        if size < 2 or at + 2 + size > len(blob):
            return None
        at += 2 + size
        if kind == 0xDA:  # entropy-coded data: up to a marker that is neither a stuffed byte nor a restart
            k = blob.find(b"\xff", at)
            while 0 <= k < len(blob) - 1 and (blob[k + 1] == 0 or 0xD0 <= blob[k + 1] <= 0xD7):
                k = blob.find(b"\xff", k + 2)
            if k < 0 or k + 1 >= len(blob):
                return None
            at = k
    return None


def _gif(b: memoryview) -> int | None:
    if len(b) < 13:
        return None
    at = 13 + (3 << (b[10] & 7) + 1 if b[10] & 0x80 else 0)

    def blocks(at: int) -> int | None:
        while at < len(b):
            if b[at] == 0:
                return at + 1
            at += 1 + b[at]
        return None

    while at < len(b):
        kind = b[at]
        if kind == 0x3B:
            return at + 1
        if kind == 0x21:
            at = blocks(at + 2)
        elif kind == 0x2C and at + 10 <= len(b):
            flags = b[at + 9]
            at = blocks(at + 11 + (3 << (flags & 7) + 1 if flags & 0x80 else 0))
        else:
            return None
        if at is None:
            return None
    return None


def _bmp(b: memoryview) -> int | None:
    if len(b) < 26:
        return None
    size, reserved, pixels, header = struct.unpack_from("<IIII", b, 2)
    return size if reserved == 0 and header in (12, 40, 52, 56, 108, 124) and 14 + header <= pixels <= size <= len(b) else None


def _riff(b: memoryview, kind: bytes) -> int | None:
    if len(b) < 12 or bytes(b[:4]) != b"RIFF" or bytes(b[8:12]) != kind:
        return None
    end = 8 + struct.unpack_from("<I", b, 4)[0]
    if end > len(b):
        return None
    at, kinds = 12, []
    while at + 8 <= end:
        (size,) = struct.unpack_from("<I", b, at + 4)
        kinds.append(bytes(b[at : at + 4]))
        at += 8 + size + (size & 1)
    return end if at == end and (kind != b"WAVE" or (kinds[:1] == [b"fmt "] and b"data" in kinds)) else None


def _ogg(b: memoryview) -> int | None:
    at = 0
    while at + 27 <= len(b) and bytes(b[at : at + 4]) == b"OggS" and b[at + 4] == 0:
        n = b[at + 26]
        end = at + 27 + n + sum(b[at + 27 : at + 27 + n])
        if at + 27 + n > len(b) or end > len(b):
            return None
        at = end
    return at or None


def _flac(b: memoryview) -> int | None:
    """Metadata blocks; the frames have no length of their own and reach to the end."""
    at, first = 4, True
    while at + 4 <= len(b):
        size = int.from_bytes(b[at + 1 : at + 4], "big")
        if (first and (b[at] & 0x7F or size != 34)) or at + 4 + size > len(b):
            return None
        final, first = b[at] & 0x80, False
        at += 4 + size
        if final:
            return len(b)
    return None


def _pdf(blob: bytes, start: int, seen: dict) -> int | None:
    """Up to the last end mark before the next document begins."""
    after = blob.find(b"%PDF-", start + 5)
    after = len(blob) if after < 0 else after
    end = blob.rfind(b"%%EOF", start, after)
    good = blob[start + 5 : start + 6].isdigit() and blob[start + 6 : start + 7] == b"." and end >= 0 and blob.rfind(b"startxref", start, end) >= 0
    return end + 5 - start if good else None


def _zip(blob: bytes, start: int, seen: dict) -> int | None:
    """The end record tells where its archive begins: all of a value's are read once."""
    if "zip" not in seen:
        found, end = {}, blob.find(b"PK\x05\x06")
        while end >= 0 and end + 22 <= len(blob):
            size, offset, comment = struct.unpack_from("<IIH", blob, end + 12)
            if end + 22 + comment <= len(blob):
                found.setdefault(end - size - offset, end + 22 + comment)
            end = blob.find(b"PK\x05\x06", end + 1)
        seen["zip"] = found
    end = seen["zip"].get(start)
    return end - start if end else None


def _gzip(b: memoryview) -> int | None:
    d = zlib.decompressobj(31)
    try:
        at = 0
        while at < len(b) and not d.eof:
            part = b[at : at + 65536]
            at += len(part)
            d.decompress(part, 1 << 20)
            while d.unconsumed_tail and not d.eof:
                d.decompress(d.unconsumed_tail, 1 << 20)
    except zlib.error:
        return None
    return at - len(d.unused_data) if d.eof else None


VALIDATORS = {
    "image/png": _png, "image/gif": _gif, "image/bmp": _bmp, "audio/wav": lambda b: _riff(b, b"WAVE"), "image/webp": lambda b: _riff(b, b"WEBP"),
    "audio/flac": _flac, "audio/ogg": _ogg, "application/gzip": _gzip,
}
#: Validators that search: they get the whole value, a place in it, and what was found in it before, so that nothing is read again for each magic number.
SEARCHING = {"image/jpeg": _jpeg, "application/pdf": _pdf, "application/zip": _zip}

_automaton = None


def automaton():
    """The automaton over all magic numbers, as Latin-1 strings; made once in each worker process."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        made = ahocorasick.Automaton()
        for magic, (kind, back) in MAGIC.items():
            made.add_word(magic.decode("latin-1"), (kind, back + len(magic) - 1))
        made.make_automaton()
        _automaton = made
    return _automaton


def sniff(blob: bytes) -> list[tuple[str, int, int]]:
    """Confirmed media of ``blob`` as (type, offset, length), outermost only, in order."""
    view, found, free, seen = memoryview(blob), [], 0, {}
    for end, (kind, back) in automaton().iter(blob.decode("latin-1")):
        at = end - back
        if at < free:
            continue
        length = SEARCHING[kind](blob, at, seen) if kind in SEARCHING else VALIDATORS[kind](view[at:])
        if length:
            found.append((kind, at, length))
            free = at + length
    return found


def payload_of(text: bytes, unit: int = UNIT, pad: int = PAD) -> bytes:
    """``text`` and bytes ``pad`` up to a positive multiple of ``unit``."""
    size = max(unit, -(-len(text) // unit) * unit)
    return text + bytes([pad]) * (size - len(text))


def png(samples: bytes, width: int = UNIT) -> bytes:
    """An 8-bit grey image of rows of ``width`` samples."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    lines = np.zeros((rows.shape[0], width + 1), np.uint8)  # filter type 0 before each row
    lines[:, 1:] = rows

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, rows.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def png_samples(medium: bytes) -> tuple[bytes, int, int]:
    """Samples, width and height of an image that png() wrote."""
    width, height = struct.unpack_from(">II", medium, 16)
    at, packed = 8, []
    while at < len(medium):
        (size,) = struct.unpack_from(">I", medium, at)
        if medium[at + 4 : at + 8] == b"IDAT":
            packed.append(medium[at + 8 : at + 8 + size])
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("only rows without a filter are written here")
    return lines[:, 1:].tobytes(), width, height


STORED = T.StructType([T.StructField("declared_type", T.StringType()), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])


def text_to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT) -> DataFrame:
    """Each text's UTF-8 bytes, padded to a positive multiple of ``unit``, as a lossless image column.

    Returns ``id_col``, declared_type (application/octet-stream: nothing is claimed), n_bytes (unpadded) and media. Null
    text counts as empty. Rows stay as they are, repeated ones too; other columns are left out.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *STORED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 200):
                part = batch.slice(i, 200)
                texts = [(x or "").encode() for x in part.column(1).to_pylist()]
                media = [png(payload_of(t, unit), unit) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(["application/octet-stream"] * len(texts)), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


SNIFFED = "media_type string, corrected boolean, confirmed boolean, n_media long, carved array<struct<media_type:string,offset:long,length:long,media:binary>>"


def sniff_media(df: DataFrame, media_col: str = "media", declared_col: str = "declared_type", carve: bool = True) -> DataFrame:
    """Sniff a media column.

    Adds media_type (the confirmed type at the start, else the declared one), corrected (it differs from the declared
    type), confirmed, n_media (confirmed media anywhere, outermost only) and carved (those which don't fill the value, with
    their bytes). Null and empty values have no media: type as declared, nothing confirmed, carved empty. All other columns
    stay, the added names must not be among them.
    """
    names = ["media_type", "corrected", "confirmed", "n_media", "carved"]
    if clash := set(names) & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are there already")
    carved_type = pa.list_(pa.struct([("media_type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("media", pa.binary())]))
    schema = T.StructType([*df.schema, *T.StructType.fromDDL(SNIFFED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 500):
                batch = whole.slice(i, 500)
                rows = []
                for blob, declared in zip(batch.column(media_col).to_pylist(), batch.column(declared_col).to_pylist()):
                    blob = bytes(blob or b"")
                    found = sniff(blob)
                    at_start = found[0][0] if found and found[0][1] == 0 else None
                    inside = [{"media_type": k, "offset": a, "length": n, "media": blob[a : a + n]} for k, a, n in found if n != len(blob)] if carve else []
                    rows.append((at_start or declared, bool(at_start and at_start != declared), at_start is not None, len(found), inside))
                kinds = (pa.string(), pa.bool_(), pa.bool_(), pa.int64(), carved_type)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=schema.names)

    return df.mapInArrow(run, schema)


def sample_features(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Decode the images of a sniffed column and describe their samples.

    Returns ``id_col``, n_bytes, payload (the samples read back), media and feature: type, size, mean, deviation and entropy
    of the samples. A value that isn't confirmed as an image raises an error, as its samples would be wrong.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("payload", T.BinaryType()), T.StructField("media", T.BinaryType()), T.StructField("feature", T.StringType())])

    def describe(medium: bytes, kind: str) -> tuple[bytes, str]:
        if kind != "image/png":
            raise ValueError(f"not a confirmed image: {kind}")
        samples, width, height = png_samples(medium)
        counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
        share = counts / counts.sum()
        values = np.arange(256)
        mean = float((share * values).sum())
        deviation = float(np.sqrt((share * (values - mean) ** 2).sum()))
        some = share[share > 0]
        return samples, f"{kind};{width}x{height};mean={mean:.3f};deviation={deviation:.3f};entropy={float(-(some * np.log2(some)).sum()):.4f}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 200):
                batch = whole.slice(i, 200)
                got = [describe(bytes(m), k) for m, k in zip(batch.column("media").to_pylist(), batch.column("media_type").to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("n_bytes"), pa.array([g[0] for g in got], pa.binary()), batch.column("media"), pa.array([g[1] for g in got], pa.string())], names=schema.names)

    return df.select(id_col, "n_bytes", "media", "media_type").mapInArrow(run, schema)
