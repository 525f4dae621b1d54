"""Media columns: lossless containers and signature sniffing.

`store` wraps each text's bytes, padded with zero bytes to a multiple of 64, as
the 8-bit samples of a media file (the format follows from the payload's crc32)
and gives it a declared type that is wrong for a part of the rows.  `sniff`
finds magic bytes with an Aho-Corasick automaton, lets a validator for each
format confirm structure and lengths, corrects the declared type and carves
media embedded in other bytes.

A null or empty text is 64 zero bytes.  Equal texts give equal files.  Bytes in
which no candidate passes its validator have the type `unknown` and no carved
parts.  Every row is returned, repeated ones too; an empty table gives none; other
columns, of any names, are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

UNIT = 64

# Magic bytes of the formats, at the start of a file.
MAGIC = {
    "wav": b"RIFF",
    "au": b".snd",
    "bmp": b"BM",
    "pgm": b"P5\n",
    "png": b"\x89PNG\r\n\x1a\n",
    "gif": b"GIF8",
    "jpeg": b"\xff\xd8\xff",
}
WRITTEN = ("wav", "au", "bmp", "pgm", "png")


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


# -- writers: one 8-bit sample for each payload byte ------------------------
def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def write(kind: str, data: bytes) -> bytes:
    rows = len(data) // UNIT
    if kind == "wav":
        return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(data)) + data
    if kind == "au":
        return b".snd" + struct.pack(">5I", 24, len(data), 2, 8000, 1) + data
    if kind == "pgm":
        return b"P5\n%d %d\n255\n" % (UNIT, rows) + data
    if kind == "bmp":
        grey = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4)
        grey[:, 3] = 0
        at = 14 + 40 + 1024
        return b"BM" + struct.pack("<IHHI", at + len(data), 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, UNIT, -rows, 1, 8, 0, len(data), 2835, 2835, 256, 0) + grey.tobytes() + data
    lines = np.zeros((rows, UNIT + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(data, np.uint8).reshape(rows, UNIT)
    head = struct.pack(">IIBBBBB", UNIT, rows, 8, 0, 0, 0, 0)
    return MAGIC["png"] + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


# -- validators: (end of the file, samples or None) if the structure holds ---
def _wav(b: bytes, i: int):
    if b[i + 8 : i + 12] != b"WAVE" or i + 12 > len(b):
        return None
    end = i + 8 + struct.unpack_from("<I", b, i + 4)[0]
    if end > len(b):
        return None
    p, fmt, data = i + 12, None, None
    while p + 8 <= end:
        kind, size = b[p : p + 4], struct.unpack_from("<I", b, p + 4)[0]
        if p + 8 + size > end:
            return None
        if kind == b"fmt " and size >= 16:
            fmt = struct.unpack_from("<HHIIHH", b, p + 8)
        elif kind == b"data":
            data = b[p + 8 : p + 8 + size]
        p += 8 + size + (size & 1)
    return (end, data) if fmt and data is not None and fmt[0] == 1 and fmt[4] == fmt[1] * fmt[5] // 8 else None


def _au(b: bytes, i: int):
    if i + 24 > len(b):
        return None
    at, size, coding, rate, channels = struct.unpack_from(">5I", b, i + 4)
    ok = at >= 24 and 1 <= coding <= 27 and 0 < rate <= 768_000 and 0 < channels <= 64 and i + at + size <= len(b)
    return (i + at + size, b[i + at : i + at + size]) if ok else None


def _bmp(b: bytes, i: int):
    if i + 54 > len(b):
        return None
    size, r1, r2, at, head, w, h, planes, bits = struct.unpack_from("<IHHIIiiHH", b, i + 2)
    if r1 or r2 or head not in (40, 52, 56, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or w <= 0 or h == 0 or i + size > len(b):
        return None
    row = (w * bits + 31) // 32 * 4
    if at < 14 + head or at + row * abs(h) > size:
        return None
    return i + size, b[i + at : i + at + row * abs(h)] if bits == 8 and w == row and h < 0 else None


def _pgm(b: bytes, i: int):
    head = b[i + 3 : i + 67].split(b"\n", 2)
    dims = head[0].split()
    if len(head) < 3 or len(dims) != 2 or not all(x.isdigit() for x in (*dims, head[1])) or not 0 < int(head[1]) < 256:
        return None
    at = i + 3 + len(head[0]) + 1 + len(head[1]) + 1
    end = at + int(dims[0]) * int(dims[1])
    return (end, b[at:end]) if at < end <= len(b) else None


def _png(b: bytes, i: int):
    p, head, body = i + 8, None, []
    while p + 12 <= len(b):
        size, kind = struct.unpack_from(">I", b, p)[0], b[p + 4 : p + 8]
        if p + 12 + size > len(b) or zlib.crc32(b[p + 4 : p + 8 + size]) != struct.unpack_from(">I", b, p + 8 + size)[0]:
            return None
        if (head is None) != (kind == b"IHDR"):
            return None
        if kind == b"IHDR":
            head = struct.unpack_from(">IIBBBBB", b, p + 8)
        elif kind == b"IDAT":
            body.append(b[p + 8 : p + 8 + size])
        p += 12 + size
        if kind == b"IEND":
            w, h, bits, colour = head[:4]
            if not body:
                return None
            if (bits, colour) != (8, 0):
                return p, None
            try:
                raw = zlib.decompress(b"".join(body))
            except zlib.error:
                return None
            if len(raw) != h * (w + 1):
                return None
            lines = np.frombuffer(raw, np.uint8).reshape(h, w + 1)
            return p, lines[:, 1:].tobytes() if not lines[:, 0].any() else None
    return None


def _gif(b: bytes, i: int):
    if b[i + 4 : i + 6] not in (b"7a", b"9a") or i + 13 > len(b):
        return None
    p = i + 13 + (3 << ((b[i + 10] & 7) + 1) if b[i + 10] & 0x80 else 0)
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1, None
        if b[p] == 0x21:
            p += 2
        elif b[p] == 0x2C and p + 10 <= len(b):
            p += 11 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 0x80 else 0)
        else:
            return None
        while p < len(b) and b[p]:
            p += b[p] + 1
        p += 1
    return None


def _jpeg(b: bytes, i: int):
    p = i + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        if b[p + 1] == 0xDA:
            end = b.find(b"\xff\xd9", p)
            return (end + 2, None) if end > 0 else None
        size = struct.unpack_from(">H", b, p + 2)[0]
        if size < 2:
            return None
        p += 2 + size
    return None


CHECK = {"wav": _wav, "au": _au, "bmp": _bmp, "pgm": _pgm, "png": _png, "gif": _gif, "jpeg": _jpeg}


class Sniffer:
    """Confirmed media in some bytes, leftmost first, without overlaps."""

    def __init__(self):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for kind, magic in MAGIC.items():
            self.auto.add_word(magic.decode("latin-1"), (kind, len(magic)))
        self.auto.make_automaton()

    def __call__(self, blob: bytes, inside: bool = True) -> list[tuple[str, int, int, bytes | None]]:
        found, free = [], 0
        for last, (kind, size) in self.auto.iter(blob.decode("latin-1")):
            at = last - size + 1
            if at < free:
                continue
            if got := CHECK[kind](blob, at):
                found.append((kind, at, got[0], got[1]))
                free = got[0]
                if not inside or free >= len(blob):
                    break
        return found


def kind_of(data: bytes) -> tuple[str, str]:
    """(format that a payload is stored in, type that it is declared as)."""
    c = zlib.crc32(data)
    kind = WRITTEN[c % len(WRITTEN)]
    return kind, kind if (c >> 8) % 4 else WRITTEN[(c + 1) % len(WRITTEN)]


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, declared, media): the media column of the texts."""

    def make():
        def kernel(ids, texts):
            data = [payload(t) for t in texts]
            kinds = [kind_of(d) for d in data]
            return {id_col: ids, "n_bytes": [len(t.encode()) for t in texts], "declared": [d for _, d in kinds], "media": [write(k, d) for (k, _), d in zip(kinds, data, strict=True)]}

        return kernel

    return map_texts(df, id_col, text_col, make, f"`{id_col}` {dict(df.dtypes)[id_col]}, n_bytes long, declared string, media binary")


def describe(blob: bytes | None, declared: str | None, sniffer: Sniffer) -> dict:
    """Type, samples read back, carved parts and features of one media value."""
    blob = blob or b""
    parts = sniffer(blob)
    whole = bool(parts) and parts[0][1] == 0 and parts[0][2] == len(blob)
    kind = parts[0][0] if whole else "unknown"
    data = parts[0][3] if whole else None
    inner = sniffer(data) if data else []
    carved = inner if whole else parts
    a = np.frombuffer(data or b"", np.uint8)
    mean, top = (int(a.sum()) // len(a), int(a.max())) if len(a) else (0, 0)
    feature = f"type={kind};declared={declared};corrected={int(kind != declared)};samples={len(a)};mean={mean};max={top};carved={'+'.join(f'{k}@{i}-{j}' for k, i, j, _ in carved) or '-'}"
    return {"kind": kind, "data": data or b"", "carved": [(k, blob[i:j] if not whole else data[i:j]) for k, i, j, _ in carved], "feature": feature}


def sniff(df: DataFrame, id_col: str, media_col: str, declared_col: str) -> DataFrame:
    """(id, kind, corrected, data, carved, feature) of a column of media bytes."""
    import pyarrow as pa

    from .common import arrow_schema

    ddl = f"`{id_col}` {dict(df.dtypes)[id_col]}, kind string, corrected boolean, data binary, carved array<struct<kind: string, media: binary>>, feature string"
    schema = arrow_schema(ddl)

    def run(batches):
        sniffer = Sniffer()
        for b in batches:
            got = [describe(m, d, sniffer) for m, d in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            cols = [b.column(0), [g["kind"] for g in got], [g["kind"] != d for g, d in zip(got, b.column(2).to_pylist(), strict=True)], [g["data"] for g in got], [[{"kind": k, "media": m} for k, m in g["carved"]] for g in got], [g["feature"] for g in got]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], names=schema.names)

    return df.select(F.col(id_col).alias(id_col), F.col(media_col).alias("_m"), F.col(declared_col).alias("_d")).mapInArrow(run, ddl)


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text, read it back through the sniffer, and digest both forms."""

    def make():
        sniffer = Sniffer()

        def kernel(ids, texts):
            out = {c: [] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for text in texts:
                data = payload(text)
                kind, declared = kind_of(data)
                media = write(kind, data)
                got = describe(media, declared, sniffer)
                back = got["data"]
                row = (len(text.encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), got["feature"])
                for c, v in zip(out, row, strict=True):
                    out[c].append(v)
            return {id_col: ids, **out}

        return kernel

    return map_texts(df, id_col, text_col, make, f"`{id_col}` {dict(df.dtypes)[id_col]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
