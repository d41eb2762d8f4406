"""Operator 7, media columns: MPEG audio.

``encode`` stores bytes as an MPEG-1 layer III stream of variable bitrate: an ID3v2 tag, a frame with the
Xing table (frames, bytes, 100 seek points), then mono 48 kHz frames with a CRC whose main data carry the
payload, 384 bytes in a 160 kbit/s frame and a last 192 in one of 80 kbit/s. ``parse`` reads any such
stream, of MPEG-1, 2 and 2.5 and any layer: it reads tags and Xing or VBRI tables, finds each frame header again
after foreign bytes, verifies the CRCs (layer III), and gives the exact duration and the offset of every frame.

Defined results: a null text is stored as the 192 spaces of an empty one; equal texts give equal files;
damaged bytes between frames are skipped and counted; a stream without a frame has duration 0.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import utf8

# Fixed values of the format: kbit/s by bitrate index, for (MPEG-1?, layer); Hz of MPEG-1 by rate index; samples of a frame;
# bytes of side information of a layer III frame, for (MPEG-1?, mono?).
KBITS_III = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
KBITS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): KBITS_III,
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)
SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}
SIDE = {(True, True): 17, (True, False): 32, (False, True): 9, (False, False): 17}
SIDE_MONO = SIDE[True, True]
UNIT, TAG_V1 = 192, 128


@lru_cache(1 << 16)
def crc16(data: bytes) -> int:
    """CRC of a frame: polynomial 0x8005, start 0xFFFF, high bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def _side(n: int) -> bytes:
    """Side information of a mono frame with n bytes of main data: two granules of 59 bits, half the bits each."""
    bits = 0
    for _ in range(2):
        bits = bits << 59 | (n * 4) << 47
    return bits.to_bytes(SIDE_MONO, "big")


@lru_cache(8)
def _frame_start(kbits: int, n: int) -> bytes:
    head = bytes([0xFF, 0xFA, KBITS_III.index(kbits) << 4 | 1 << 2, 0xC0])
    side = _side(n)
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side


def _frames(payload: np.ndarray, kbits: int, n: int) -> bytes:
    start = np.frombuffer(_frame_start(kbits, n), np.uint8)
    out = np.zeros((len(payload) // n, 144 * kbits * 1000 // 48000), np.uint8)
    out[:, : len(start)] = start
    out[:, len(start) : len(start) + n] = payload.reshape(-1, n)
    return out.tobytes()


def padded(data: bytes) -> bytes:
    return data + b" " * (-len(data) % UNIT or (0 if data else UNIT))


def encode(payload: bytes) -> bytes:
    """A whole file around the payload, whose length is a multiple of 192."""
    data = np.frombuffer(payload, np.uint8)
    whole = len(data) // (2 * UNIT) * 2 * UNIT
    body = _frames(data[:whole], 160, 2 * UNIT) + _frames(data[whole:], 80, UNIT)
    count, size = -(-len(data) // (2 * UNIT)), 240 + len(body)
    toc = bytes(min(255, 256 * (240 + min(480 * (count * i // 100), len(body))) // size) for i in range(100))
    xing = (bytes([0xFF, 0xFB, 6 << 4 | 1 << 2, 0xC0]) + bytes(SIDE_MONO) + b"Xing" + struct.pack(">III", 7, count, size) + toc).ljust(240, b"\0")
    text = b"\0payload\0" + str(len(payload)).encode()
    tag = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    n = len(tag)
    return b"ID3\x03\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + tag + xing + body


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    kbits: dict[int, int] = field(default_factory=dict)
    samples: int = 0
    rate: int = 0
    crc_checked: int = 0
    crc_bad: int = 0
    skipped: int = 0
    table: tuple[int, int, bytes] | None = None
    payload: bytes = b""


class Header(NamedTuple):
    """What four bytes say: all frames of a stream agree in the first three fields."""

    version: int
    layer: int
    rate: int
    kbits: int
    size: int
    protected: bool
    mono: bool

    @property
    def kind(self) -> tuple[bool, int]:
        return self.version == 3, self.layer


@lru_cache(4096)
def header(four: bytes) -> Header | None:
    """A frame header, or None if these bytes are none (the free bitrate counts as none)."""
    if len(four) < 4 or four[0] != 0xFF or four[1] < 0xE0:
        return None
    version, layer, rate, bits = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3), four[2] >> 2 & 3, four[2] >> 4
    if version == 1 or layer == 4 or rate == 3 or not 0 < bits < 15:
        return None
    hz = RATES[rate] >> (3 - version if version else 2)
    kind = (version == 3, layer)
    kbits, padding = KBITS[kind][bits], four[2] >> 1 & 1
    size = (12_000 * kbits // hz + padding) * 4 if layer == 1 else SAMPLES[kind] // 8 * 1000 * kbits // hz + padding
    return Header(version, layer, hz, kbits, size, not four[1] & 1, four[3] >> 6 == 3)


def _tags_v2(data: bytes, out: Stream) -> int:
    """Read an ID3v2 tag at the start; the offset behind it."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    safe = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    k, end = 10, 10 + safe(data[6:10])
    while k + 10 < min(end, len(data)) and data[k] > 0:
        n = safe(data[k + 4 : k + 8]) if data[3] == 4 else struct.unpack(">I", data[k + 4 : k + 8])[0]
        out.tags[data[k : k + 4].decode("latin-1")] = data[k + 11 : k + 10 + n].decode("latin-1").strip("\0")
        k += 10 + n
    return end


def _table(data: bytes, at: int, h: Header) -> tuple[int, int, bytes] | None:
    """(frames, bytes, seek points) of a variable-bitrate table in the frame, Xing's or VBRI's."""
    k = at + 4 + 2 * h.protected + SIDE[h.version == 3, h.mono]
    if data[k : k + 4] in (b"Xing", b"Info") and k + 8 <= len(data):
        flags, k, values = data[k + 7], k + 8, []
        for bit in (1, 2):
            values.append(int.from_bytes(data[k : k + 4], "big") if flags & bit else 0)
            k += 4 * bool(flags & bit)
        return *values, data[k : k + 100] if flags & 4 else b""
    if data[at + 36 : at + 40] == b"VBRI" and at + 62 <= len(data):
        size, frames, entries, _, width, _ = struct.unpack(">IIHHHH", data[at + 46 : at + 62])
        return frames, size, data[at + 62 : at + 62 + entries * width]
    return None


def parse(data: bytes) -> Stream:
    """Frames, tags and payload of an MPEG audio stream of any version and layer (module docstring).

    In step, a frame counts if its header agrees with the one before. At the start and behind foreign bytes another
    agreeing header, the closing tag or the end must follow it. A closing tag (ID3v1) is looked for only where a
    frame has ended or no frame can start, never inside a frame. CRCs are verified in layer III.
    """
    out, end, parts, last = Stream(), len(data), [], None
    at = _tags_v2(data, out)
    closing = lambda k: k + TAG_V1 == end and data[k : k + 3] == b"TAG"
    while at < end:
        if closing(at):
            out.tags["TAG"] = data[at + 3 : end].decode("latin-1").replace("\0", " ").strip()
            break
        h = header(data[at : at + 4])
        after = at + h.size if h else 0
        good = h is not None and after <= end
        if good and not (last and h[:3] == last[:3]):
            other = header(data[after : after + 4])
            good = after == end or closing(after) or (other is not None and other[:3] == h[:3])
        if not good:
            found = data.find(b"\xff", at + 1, end)
            found = end if found < 0 else found
            if at < end - TAG_V1 < found and closing(end - TAG_V1):
                found = end - TAG_V1
            out.skipped += found - at
            at, last = found, None
            continue
        first, last = last is None and not out.offsets, h
        if first and h.layer == 3 and out.table is None and (table := _table(data, at, h)):
            out.table, at = table, after
            continue
        out.offsets.append(at)
        out.kbits[h.kbits] = out.kbits.get(h.kbits, 0) + 1
        out.samples, out.rate = out.samples + SAMPLES[h.kind], h.rate
        if h.layer == 3:
            side, begin = SIDE[h.version == 3, h.mono], at + 4 + 2 * h.protected
            if h.protected:
                out.crc_checked += 1
                out.crc_bad += crc16(data[at + 2 : at + 4] + data[begin : begin + side]) != data[at + 4] << 8 | data[at + 5]
            if h.version == 3 and h.mono:
                bits = int.from_bytes(data[begin : begin + side], "big")
                length = ((bits >> 106 & 0xFFF) + (bits >> 47 & 0xFFF)) // 8
                parts.append(data[begin + side : min(after, begin + side + length)])
        at = after
    out.payload = b"".join(parts)
    return out


FEATURES = "media binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, n_samples long, sample_rate int, crc_bad long, seek_offsets array<long>, feature string"


def _row(stored: bytes, n_bytes: int) -> tuple:
    s = parse(stored)
    seek = zlib.crc32(np.array(s.offsets, "<i8").tobytes())
    table_ok = s.table is not None and s.table[:2] == (len(s.offsets), len(stored) - (s.offsets[0] if s.offsets else 0) + 240)
    kinds = "+".join(f"{v}x{k}k" for k, v in sorted(s.kbits.items()))
    feature = f"mp3 {kinds} samples={s.samples}/{s.rate} seconds={s.samples / (s.rate or 1):.6f} crc={s.crc_checked - s.crc_bad}/{s.crc_checked} skipped={s.skipped} table={'ok' if table_ok else 'bad'} seek={seek:08x}"
    return (n_bytes, len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), len(s.offsets), s.samples, s.rate, s.crc_bad, s.offsets, feature)


def media_columns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text as an MPEG file in column ``media``, with what was parsed from the stored bytes."""

    def store(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data = utf8(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([encode(padded(x)) for x in data], pa.binary()), pa.array([len(x) for x in data], pa.int64())], names=["doc_id", "media", "n_bytes"])

    def read(batches):
        names = ["doc_id", *(x.split()[0] for x in FEATURES.split(", "))]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.string()]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [_row(m, n) for m, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=names)

    stored = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(store, "doc_id long, media binary, n_bytes long")
    return stored.mapInArrow(read, f"doc_id long, {FEATURES}")


def op7_media(spark, sf_dir: str) -> DataFrame:
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
