"""Media columns: MPEG audio (layer III) as binary values.

`probe` reads a stream: it skips and parses an ID3v2 tag, finds the first header whose successor is a header of the
same kind too, walks the frames, resynchronises behind damage, parses a Xing/Info or VBRI table, verifies the CRC-16 of
protected frames, reads an ID3v1 tag, and returns the exact duration (samples over rate, a fraction) and the seek offset
of each frame.

`mux` writes a stream that carries any bytes without loss: silent mono frames at 44.1 kHz and 192 kbit/s, whose side
information announces no coded samples, hold UNIT bytes each in their ancillary data. An Info frame with a seek table
leads, and an ID3v2 tag gives the payload's length. `carried` takes the bytes out again, from the offsets that `probe`
found.

Defined results: a null payload is empty, and an empty one becomes one unit of padding; a null stream has no features;
a stream without frames has 0 frames and duration 0; other columns stay as they are.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.shipping import map_arrow

UNIT = 576
PAD = 255

# Fixed values of the format: kbit/s by MPEG version 1 or 2 and layer, rates by version, samples in a frame.
KBITS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1.0: (44100, 48000, 32000), 2.0: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}

RATE, KBIT = 44100, 192
HEAD = 4 + 2 + 17  # header, checksum, side information of a mono frame


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    kbit: int
    rate: int
    padding: int
    mode: int

    @property
    def samples(self) -> int:
        return SAMPLES[1 if self.version == 1 else 2, self.layer]

    @property
    def size(self) -> int:
        if self.layer == 1:
            return (12000 * self.kbit // self.rate + self.padding) * 4
        return self.samples * 125 * self.kbit // self.rate + self.padding

    @property
    def side(self) -> int:
        if self.layer != 3:
            return 0
        return (17 if self.mode == 3 else 32) if self.version == 1 else (9 if self.mode == 3 else 17)

    def like(self, other: Header) -> bool:
        return (self.version, self.layer, self.rate) == (other.version, other.layer, other.rate)


@cache
def header(word: int) -> Header | None:
    """The meaning of four bytes, None if they are no header (free-format streams are none either)."""
    version = {0: 2.5, 2: 2.0, 3: 1.0}.get(word >> 19 & 3)
    layer, kbits, rate = 4 - (word >> 17 & 3), word >> 12 & 15, word >> 10 & 3
    if word >> 21 != 0x7FF or version is None or layer == 4 or kbits in (0, 15) or rate == 3 or word & 3 == 2:
        return None
    return Header(version, layer, not word >> 16 & 1, KBITS[1 if version == 1 else 2, layer][kbits], RATES[version][rate], word >> 9 & 1, word >> 6 & 3)


@cache
def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1 ^ 0x8005 if value & 0x8000 else value << 1) & 0xFFFF
        out.append(value)
    return out


@cache
def crc16(data: bytes) -> int:
    """The format's checksum of a header's second half and the side information."""
    value, table = 0xFFFF, _crc_table()
    for byte in data:
        value = (value << 8 & 0xFF00) ^ table[value >> 8 ^ byte]
    return value


@dataclass
class Probe:
    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, object] = field(default_factory=dict)  # kind, frames, bytes, toc
    version: float = 0
    layer: int = 0
    rate: int = 0
    frames: int = 0
    samples: int = 0
    checked: int = 0
    damaged: int = 0
    resyncs: int = 0
    skipped: int = 0
    offsets: list[int] = field(default_factory=list)
    duration: Fraction = Fraction(0)


def _syncsafe(data: bytes) -> int:
    return data[0] << 21 | data[1] << 14 | data[2] << 7 | data[3]


def _id3v2(data: bytes, out: Probe) -> int:
    """Parses the tag at the front; returns its size."""
    if data[:3] != b"ID3" or len(data) < 10 or any(x & 0x80 for x in data[6:10]):
        return 0
    end = min(10 + _syncsafe(data[6:10]), len(data))
    at, major = 10, data[3]
    while major >= 3 and at + 10 <= end and data[at]:
        name, size = data[at : at + 4], _syncsafe(data[at + 4 : at + 8]) if major == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + 10 : min(at + 10 + size, end)]
        if name[:1] == b"T" and body:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            out.tags[name.decode("latin-1")] = body[1:].decode(code, "replace").rstrip("\0")
        at += 10 + size
    return end


def _table(frame: bytes, h: Header) -> dict[str, object]:
    """The variable-bitrate table that a first frame may hold."""
    at = 4 + h.side + 2 * h.protected
    for start in (at, 4 + h.side):
        if (name := frame[start : start + 4]) in (b"Xing", b"Info") and len(frame) >= start + 8:
            flags, at, out = int.from_bytes(frame[start + 4 : start + 8], "big"), start + 8, {"kind": name.decode()}
            for bit, what in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[what], at = int.from_bytes(frame[at : at + 4], "big"), at + 4
            if flags & 4:
                out["toc"] = frame[at : at + 100]
            return out
    # A frame that ends before the table's fixed part has none; a list that a frame cuts off keeps its whole entries.
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        n_bytes, frames, entries, scale, width, each = struct.unpack(">IIHHHH", frame[46:62])
        toc = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(min(entries, (len(frame) - 62) // width if width else 0))]
        return {"kind": "VBRI", "frames": frames, "bytes": n_bytes, "toc": toc, "each": each}
    return {}


def probe(data: bytes) -> Probe:
    out = Probe()
    at = _id3v2(data, out)
    end = len(data)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        out.tags["ID3v1"] = data[end + 3 : end + 33].split(b"\0")[0].decode("latin-1").rstrip()
    like, synced = None, False
    while at + 4 <= end:
        h = header(int.from_bytes(data[at : at + 4], "big"))
        fits = h is not None and at + h.size <= end and (like is None or h.like(like))
        if fits and not synced and at + h.size + 4 <= end:
            # A false sync inside data has no header of its own kind behind it.
            after = header(int.from_bytes(data[at + h.size : at + h.size + 4], "big"))
            fits = after is not None and after.like(h)
        if not fits:
            out.resyncs += synced
            synced, found = False, data.find(b"\xff", at + 1, end)
            out.skipped += (end if found < 0 else found) - at
            at = end if found < 0 else found
            continue
        if h.protected:
            out.checked += 1
            out.damaged += h.layer == 3 and crc16(bytes(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side])) != int.from_bytes(data[at + 4 : at + 6], "big")
        table = _table(data[at : at + h.size], h) if like is None else {}
        like, synced = like or h, True
        if table:
            out.table = table
        else:
            out.frames += 1
            out.samples += h.samples
            out.offsets.append(at)
        at += h.size
    out.skipped += max(0, end - at)
    if like:
        out.version, out.layer, out.rate, out.duration = like.version, like.layer, like.rate, Fraction(out.samples, like.rate)
    return out


@cache
def _empty_frame(padding: int, name: bytes = b"") -> bytes:
    """A protected silent frame; padding adds a byte."""
    head = 0xFFFA0000 | KBITS[1, 3].index(KBIT) << 12 | padding << 9 | 3 << 6
    side = bytes(17)
    size = header(head).size
    front = head.to_bytes(4, "big") + crc16((head & 0xFFFF).to_bytes(2, "big") + side).to_bytes(2, "big") + side + name
    return front + bytes(size - len(front))


def padded(payload: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of UNIT."""
    return payload + bytes([PAD]) * (-len(payload) % UNIT if payload else UNIT)


def mux(payload: bytes, title: str = "") -> bytes:
    """A stream that carries the padded payload, UNIT bytes a frame."""
    body = padded(payload)
    n = len(body) // UNIT
    text = b"\x03" + title.encode("utf-8", "surrogatepass")
    length = b"\x03" + str(len(payload)).encode()
    frames = b"".join(name + struct.pack(">I", len(x)) + b"\0\0" + x for name, x in ((b"TIT2", text), (b"TLEN", length)))
    size = len(frames)
    tag = b"ID3\x03\0\0" + bytes((size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127)) + frames
    # The bytes owed up to frame i decide whether it has a padding byte.
    starts = np.arange(n + 1, dtype=np.int64) * (144_000 * KBIT) // RATE
    pads = np.diff(starts) - len(_empty_frame(0))
    stream = np.empty((n, len(_empty_frame(1))), np.uint8)
    stream[:] = np.frombuffer(_empty_frame(0) + b"\0", np.uint8)
    stream[pads == 1] = np.frombuffer(_empty_frame(1), np.uint8)
    stream[:, HEAD : HEAD + UNIT] = np.frombuffer(body, np.uint8).reshape(n, UNIT)
    keep = np.ones(stream.shape, bool)
    keep[:, -1] = pads == 1
    audio = stream[keep].tobytes()
    total = len(_empty_frame(0)) + len(audio)
    toc = bytes(int((len(_empty_frame(0)) + starts[n * i // 100]) * 256 // total) for i in range(100))
    info = b"Info" + struct.pack(">III", 7, n, total) + toc
    return tag + _empty_frame(0, info) + audio


def carried(data: bytes, found: Probe) -> bytes:
    """The payload, padding included, from the frames that were found."""
    at = np.array(found.offsets, np.int64)[:, None] + HEAD + np.arange(UNIT)
    return np.frombuffer(data, np.uint8)[at].tobytes() if len(found.offsets) else b""


def feature(found: Probe, data: bytes) -> str:
    """What a media catalogue keeps of a stream, as text; the seek offsets by their checksum."""
    offsets = zlib.crc32(np.array(found.offsets, "<i8").tobytes())
    toc = found.table.get("toc")
    kind = found.table.get("kind", "none")
    return f"mpeg{found.version:g} layer{found.layer} {found.rate}Hz frames={found.frames} duration={found.duration.numerator}/{found.duration.denominator}s table={kind}:{found.table.get('frames', 0)} toc={zlib.crc32(bytes(toc)) if isinstance(toc, bytes) else 0:08x} crc={found.checked - found.damaged}/{found.checked} resyncs={found.resyncs} skipped={found.skipped} last={found.offsets[-1] if found.offsets else -1} offsets={offsets:08x} length={found.tags.get('TLEN', '')}"


def stored(rows: DataFrame, id_col: str = "doc_id", payload: str = "text") -> DataFrame:
    """(doc_id, media): each payload (text as UTF-8, or binary) as a stream."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch):
                media = [mux(x or b"") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return map_arrow(rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(payload).cast("binary").alias("payload")), write, "doc_id long, media binary")


def _portions(batch: pa.RecordBatch, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of some 16 MB, so that what is made of it stays small."""
    step = max(1, int(len(batch) * most // max(batch.nbytes, 1)))
    for at in range(0, len(batch), step):
        yield batch.slice(at, step)


PROBED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("frames", pa.int64()), ("duration_s", pa.float64()), ("seek_offsets", pa.list_(pa.int64()))])


def probed(media: DataFrame) -> DataFrame:
    """Reads each stream back: payload digests, features, exact duration and frame seek offsets."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch):
                rows = []
                for doc, data in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if data is None:
                        rows.append({"doc_id": doc})
                        continue
                    found = probe(data)
                    body = carried(data, found)
                    length = found.tags.get("TLEN", "")
                    rows.append({"doc_id": doc, "n_bytes": int(length) if length.isdigit() else None, "payload_bytes": len(body), "payload_sha256": hashlib.sha256(body).hexdigest(), "tail_crc32": zlib.crc32(body[-32:]), "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "feature": feature(found, data), "frames": found.frames, "duration_s": float(found.duration), "seek_offsets": found.offsets})
                yield pa.RecordBatch.from_pylist(rows, schema=PROBED)

    return map_arrow(media, read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames long, duration_s double, seek_offsets array<long>")
