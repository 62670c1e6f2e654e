"""Media columns: payloads stored as 8-bit samples, types found by signature sniffing.

An Aho-Corasick automaton locates the magic bytes of all formats in one pass over a file. A hit counts only when the
format's validator confirms the structure and gives a length; the format at offset 0 is the file's type, whatever was
declared, and valid hits further in, outside one already taken, are embedded media that can be carved.
"""

from __future__ import annotations

import hashlib
import struct
import wave
import zlib
from bisect import bisect_left
from collections.abc import Callable, Sequence
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import text_function

UNIT, RATE = 576, 8000
LOST = 0  # no step leads to place 0


class File:
    """A file whose validators read at offsets of one buffer; the places of a marker are looked up once for all of them."""

    def __init__(self, raw: bytes):
        self.raw = raw
        self._places: dict[bytes, list[int]] = {}
        self._walks: dict[str, dict[int, int]] = {}

    def places(self, marker: bytes) -> list[int]:
        if marker not in self._places:
            out, at = [], self.raw.find(marker)
            while at >= 0:
                out.append(at)
                at = self.raw.find(marker, at + len(marker))
            self._places[marker] = out
        return self._places[marker]

    def after(self, marker: bytes, at: int) -> int:
        """The first place of `marker` from `at` on, or -1."""
        found = self.places(marker)
        i = bisect_left(found, at)
        return found[i] if i < len(found) else -1

    def last(self, marker: bytes, at: int, end: int) -> int:
        """The last place of `marker` from `at` on and before `end`, or -1."""
        found = self.places(marker)
        i = bisect_left(found, end) - 1
        return found[i] if i >= 0 and found[i] >= at else -1

    def walk(self, name: str, state: int, step: Callable[[bytes, int], int]) -> int:
        """Where the steps from `state` end, or -1 if they end nowhere. All states on the way are remembered, so walks that meet are walked once."""
        known = self._walks.setdefault(name, {})
        path = []
        while state not in known:
            path.append(state)
            after = step(self.raw, state)
            if after == LOST or after < 0:
                known[path.pop()] = -1 if after == LOST else -after
                break
            state = after
        end = known[state]
        for s in path:
            known[s] = end
        return end


def _png(f: File, start: int) -> int | None:
    """Lengths of chunks must lead to the end chunk before any checksum is computed; places that lead nowhere are looked at once a file."""
    b, at = f.raw, start + 8
    if len(b) < start + 33 or struct.unpack_from(">I4s", b, at) != (13, b"IHDR"):
        return None
    end = f.walk("png", at, _png_step)
    while at < end:
        n = struct.unpack_from(">I", b, at)[0]
        if zlib.crc32(memoryview(b)[at + 4 : at + 8 + n]) != struct.unpack_from(">I", b, at + 8 + n)[0]:
            return None
        at += 12 + n
    return end - start if end >= 0 else None


def _png_step(b: bytes, at: int) -> int:
    """The chunk after the one at a place; its end as a negative number for the last one; `LOST` for none."""
    if at + 12 > len(b):
        return LOST
    n, kind = struct.unpack_from(">I4s", b, at)
    if at + 12 + n > len(b) or not kind.isalpha():
        return LOST
    return -(at + 12 + n) if kind == b"IEND" else at + 12 + n


def _gif(f: File, start: int) -> int | None:
    """Blocks and the parts of their data are steps of one walk; a place is looked at once a file, however many headers lead to it."""
    b = f.raw
    if len(b) < start + 14:
        return None
    end = f.walk("gif", 2 * (start + 13 + (3 << (b[start + 10] & 7) + 1 if b[start + 10] & 128 else 0)), _gif_step)
    return end - start if end >= 0 else None


def _gif_step(b: bytes, state: int) -> int:
    """As `_png_step`; a state is twice the place, and one more inside the data of a block."""
    at, inside = state >> 1, state & 1
    if at >= len(b):
        return LOST
    if inside:
        return 2 * (at + 1 + b[at]) + 1 if b[at] else 2 * (at + 1)
    if b[at] == 0x3B:
        return -(at + 1)
    if b[at] == 0x2C and at + 10 < len(b):
        return 2 * (at + 11 + (3 << (b[at + 9] & 7) + 1 if b[at + 9] & 128 else 0)) + 1
    return 2 * (at + 2) + 1 if b[at] == 0x21 else LOST


def _jpeg(f: File, start: int) -> int | None:
    b, at = f.raw, start + 2
    while at + 4 <= len(b):
        if b[at] != 0xFF:
            return None
        kind, n = b[at + 1], (b[at + 2] << 8) + b[at + 3]
        if n < 2 or kind < 0xC0:
            return None
        at += 2 + n
        if kind == 0xDA:  # entropy-coded data up to the end marker
            end = f.after(b"\xff\xd9", at)
            return end + 2 - start if end >= 0 else None
    return None


def _wav(f: File, start: int) -> int | None:
    b = f.raw
    if len(b) < start + 44 or b[start + 8 : start + 12] != b"WAVE":
        return None
    end = start + 8 + struct.unpack_from("<I", b, start + 4)[0]
    at, seen = start + 12, set()
    while at + 8 <= min(end, len(b)):
        kind, n = struct.unpack_from("<4sI", b, at)
        seen.add(kind)
        at += 8 + n + n % 2
    return end - start if end <= len(b) and at == end and {b"fmt ", b"data"} <= seen else None


def _bmp(f: File, start: int) -> int | None:
    if len(f.raw) < start + 54:
        return None
    total, _, data, header = struct.unpack_from("<IIII", f.raw, start + 2)
    return total if 54 <= total <= len(f.raw) - start and header in (12, 40, 108, 124) and 14 + header <= data <= total else None


def _pdf(f: File, start: int) -> int | None:
    """Up to the last end mark before the next header: a file that was saved again has several."""
    header = f.after(b"%PDF-", start + 5)
    end = f.last(b"%%EOF", start, header if header >= 0 else len(f.raw))
    return end + 5 - start if end > start and f.raw[start + 5 : start + 6].isdigit() else None


def _zip(f: File, start: int) -> int | None:
    """Up to the end record whose directory lies right before it, as seen from the first member."""
    found, b = f.places(b"PK\x05\x06"), f.raw
    i = bisect_left(found, start)
    if i == len(found) or found[i] + 22 > len(b):
        return None
    n, directory, note = struct.unpack_from("<IIH", b, found[i] + 12)
    end = found[i] + 22 + note
    return end - start if start + directory + n == found[i] and end <= len(b) else None


def _gzip(f: File, start: int) -> int | None:
    d, b = zlib.decompressobj(31), memoryview(f.raw)
    try:
        for at in range(start, len(b), 1 << 16):
            d.decompress(b[at : at + (1 << 16)], 0)
            if d.eof:
                return min(len(b), at + (1 << 16)) - len(d.unused_data) - start
    except zlib.error:
        pass
    return None


#: Magic bytes and media types as their formats define them.
FORMATS: dict[str, tuple[bytes, Callable[[File, int], int | None]]] = {
    "application/gzip": (b"\x1f\x8b\x08", _gzip),
    "application/pdf": (b"%PDF-", _pdf),
    "application/zip": (b"PK\x03\x04", _zip),
    "audio/wav": (b"RIFF", _wav),
    "image/bmp": (b"BM", _bmp),
    "image/gif": (b"GIF8", _gif),
    "image/jpeg": (b"\xff\xd8\xff", _jpeg),
    "image/png": (b"\x89PNG\r\n\x1a\n", _png),
}
_built: list = []


def _automaton():
    if not _built:
        import ahocorasick

        a = ahocorasick.Automaton()
        for kind, (magic, _) in FORMATS.items():
            a.add_word(magic.decode("latin-1"), (kind, len(magic)))
        a.make_automaton()
        _built.append(a)
    return _built[0]


def sniff(raw: bytes) -> list[tuple[str, int, int]]:
    """(type, start, length) of the valid media in a file: the file's own type at 0, if any, then embedded ones.

    Media inside another one are found inside its body, but not those that start before the end of an embedded one.
    """
    out, busy, file = [], 0, File(raw)
    for end, (kind, n) in _automaton().iter(raw.decode("latin-1")):
        at = end - n + 1
        if at and at < busy:
            continue
        size = FORMATS[kind][1](file, at)
        if size:
            out.append((kind, at, size))
            busy = at + size if at else 0
    return out


def payload_of(text: str | None, unit: int = UNIT) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (-len(raw) % unit if raw else unit)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(1), w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(raw: bytes) -> bytes:
    with wave.open(BytesIO(raw), "rb") as w:
        return w.readframes(w.getnframes())


def _digest(raw: bytes, kind: str, embedded: int) -> tuple:
    """Digests of one stored file: the payload is read back from the stored bytes. The feature tells the type, lengths, and of the
    samples the mean, the mean distance from silence, the peak and how often the sign changes (whole numbers)."""
    p = from_wav(raw)
    x = np.frombuffer(p, np.uint8).astype(np.int64) - 128
    loud = np.abs(x)
    turns = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    feature = f"{kind};rate={RATE};samples={len(p)};embedded={embedded};mean={int(x.sum()) // len(x)};level={int(loud.sum()) // len(x)};peak={int(loud.max())};turns={turns};adler={zlib.adler32(p)}"
    return len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature


_DIGEST = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
_DIGEST_KIND = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _columns(rows: list[tuple], names: Sequence[str], kinds: Sequence[pa.DataType]) -> pa.StructArray:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=list(names))


_DIGEST_TYPES = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())


def store_texts(docs: DataFrame, unit: int = UNIT) -> DataFrame:
    """(doc_id, n_bytes, media, declared): each text as a WAV of unsigned 8-bit mono samples; the rest of a positive multiple of
    `unit` is filled with 255. The declared type is the one a store without sniffing would give. A null or empty text is one
    unit of filling; very long texts are stored whole, one at a time; null doc_ids and repeated rows are kept; further columns are ignored; an
    empty table gives no rows."""

    def work(texts: list[str | None]) -> pa.Array:
        both = [payload_of(t, unit) for t in texts]
        return _columns([(n, to_wav(p)) for n, p in both], ("n_bytes", "media"), (pa.int64(), pa.binary()))

    stored = text_function(work, "n_bytes bigint, media binary")
    return docs.select("doc_id", stored("text").alias("of")).select("doc_id", "of.*", F.lit("application/octet-stream").alias("declared"))


def _sniffed(raw: bytes | None, said: str | None, carve: bool) -> tuple[str | None, bool, list[dict]]:
    found = sniff(raw) if raw is not None else []
    own = next((k for k, at, _ in found if at == 0), said)
    return own, own != said, [{"type": k, "start": a, "length": n} | ({"data": raw[a : a + n]} if carve else {}) for k, a, n in found if a]


def sniff_media(df: DataFrame, carve: bool = False) -> DataFrame:
    """`df` (with media BINARY and declared STRING) plus `type`, `corrected` and `embedded`.

    type is the format found at offset 0, else the declared one; corrected tells whether they differ; embedded lists
    (type, start, length), with `carve` also the bytes. A null file has no media and keeps its declared type; columns of
    these names are replaced, others pass through; an empty table gives no rows.
    """
    data = ",data:binary" if carve else ""
    inner = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64()), *([("data", pa.binary())] if carve else [])]))

    @F.arrow_udf(f"type string, corrected boolean, embedded array<struct<type:string,start:bigint,length:bigint{data}>>")
    def run(media: pa.Array, declared: pa.Array) -> pa.Array:
        rows = [_sniffed(m.as_py(), d.as_py(), carve) for m, d in zip(media, declared, strict=True)]
        return _columns(rows, ("type", "corrected", "embedded"), (pa.string(), pa.bool_(), inner))

    names = ("type", "corrected", "embedded")
    row = df.select(F.struct("*").alias("row"), run("media", "declared").alias("of"))
    own = [F.col(f"row.`{c.replace('`', '``')}`").alias(c) for c in df.columns if c not in names]
    return row.select(*own, *(f"of.{c}" for c in names))


def digest_media(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, digests) of stored media (as `sniff_media` returns them): the payload is read back from the stored bytes.

    A file that is null has null digests; null doc_ids and repeated rows are kept; further columns are ignored; an empty table gives no rows."""

    @F.arrow_udf(_DIGEST_KIND)
    def run(media: pa.Array, kind: pa.Array, embedded: pa.Array) -> pa.Array:
        rows = [_digest(m.as_py(), k.as_py(), n.as_py() or 0) if m.is_valid else (None,) * 6 for m, k, n in zip(media, kind, embedded, strict=True)]
        return _columns(rows, _DIGEST, _DIGEST_TYPES)

    return media.select("doc_id", "n_bytes", run("media", "type", F.size("embedded")).alias("of")).select("doc_id", "n_bytes", "of.*")


def text_digests(docs: DataFrame, unit: int = UNIT) -> DataFrame:
    """`digest_media(sniff_media(store_texts(docs)))` in one pass, so no stored file goes back and forth between Spark and Python."""

    def one(text: str | None) -> tuple:
        n, payload = payload_of(text, unit)
        raw = to_wav(payload)
        kind, _, inner = _sniffed(raw, "application/octet-stream", False)
        return n, *_digest(raw, kind, len(inner))

    work = lambda texts: _columns([one(t) for t in texts], ("n_bytes", *_DIGEST), (pa.int64(), *_DIGEST_TYPES))
    return docs.select("doc_id", text_function(work, f"n_bytes bigint, {_DIGEST_KIND}")("text").alias("of")).select("doc_id", "of.*")
