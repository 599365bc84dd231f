"""Operator 3: media columns of MPEG audio.

A payload is stored as a Layer III stream: an ID3v2 tag with its length, a variable-bitrate table (Xing header with
frame count, byte count and 100 seek entries), then one frame for each unit of 576 bytes. The unit stands in the
frame's main data, 1152 bits for each of its four granule channels; behind it, as ancillary data, the frame's number,
the unit's own length and a CRC-32. The CRC-16 of the standard covers header and side information.

Reading walks the frame headers of any MPEG-1/2/2.5 stream of Layers I to III. Where a header is not valid, it
resynchronises at the next place where a frame starts whose end is followed by another valid header or by the end.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.llm.common import chunks, release, small_batches, utf8

UNIT = 576
#: kbit/s by index 1 to 14 (ISO/IEC 11172-3 and 13818-3); fixed values.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
HEADER = b"\xff\xfa\xb0\x04"  # MPEG-1 Layer III with CRC, 192 kbit/s, 44.1 kHz, stereo
OPEN_HEADER = b"\xff\xfb\xb0\x04"  # the same without CRC
SIZE = 144 * 192_000 // 44_100
SIDE = 32
DATA = 4 + 2 + SIDE
TAIL = struct.Struct(">IHHI")  # frame number, unit length, reserved, CRC-32 of the unit


def side_information() -> bytes:
    """Main data from this frame only, no shared scale factors, 1152 bits in each granule of each channel."""
    bits = "0" * 9 + "0" * 3 + "0" * 8 + (f"{1152:012b}" + "0" * 47) * 4
    return int(bits, 2).to_bytes(SIDE, "big")


def _crc_table() -> np.ndarray:
    out = np.zeros(256, np.uint16)
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1) ^ 0x8005 if c & 0x8000 else c << 1
        out[b] = c & 0xFFFF
    return out


CRC_TABLE = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 of each row of bytes: polynomial 0x8005, start 0xFFFF."""
    crc = np.full(len(rows), 0xFFFF, np.uint16)
    for k in range(rows.shape[1]):
        crc = (crc << np.uint16(8)) ^ CRC_TABLE[(crc >> np.uint16(8)) ^ rows[:, k]]
    return crc


def tag(values: dict[str, str]) -> bytes:
    """An ID3v2.3 tag of TXXX frames."""
    body = b""
    for k, v in values.items():
        own = b"\x00" + k.encode("latin-1") + b"\x00" + v.encode("latin-1")
        body += b"TXXX" + struct.pack(">IH", len(own), 0) + own
    n = len(body)
    return b"ID3\x03\x00\x00" + bytes((n >> s) & 127 for s in (21, 14, 7, 0)) + body


def read_tag(media: bytes) -> tuple[int, dict[str, str]]:
    """Bytes that the tag takes, and its text frames; damaged frames end it."""
    if media[:3] != b"ID3" or len(media) < 10 or max(media[6:10]) > 127:
        return 0, {}
    size = 10 + sum(b << s for b, s in zip(media[6:10], (21, 14, 7, 0), strict=True))
    at, found = 10, {}
    while at + 10 <= min(size, len(media)) and media[at] != 0:
        n = struct.unpack(">I", media[at + 4 : at + 8])[0]
        own = media[at + 10 : at + 10 + n]
        if len(own) < n or at + 10 + n > size:
            break
        if media[at : at + 4] == b"TXXX" and own[:1] == b"\x00":
            k, _, v = own[1:].partition(b"\x00")
            found[k.decode("latin-1")] = v.decode("latin-1")
        at += 10 + n
    return min(size, len(media)), found


def payload(text: bytes) -> bytes:
    """The text and bytes 255 up to a positive multiple of the unit."""
    n = max(1, -(-len(text) // UNIT)) * UNIT
    return text + b"\xff" * (n - len(text))


def encode(data: bytes, n_bytes: int) -> bytes:
    """The stream that stores a payload of whole units."""
    units = np.frombuffer(data, np.uint8).reshape(-1, UNIT)
    n = len(units)
    frames = np.zeros((n, SIZE), np.uint8)
    frames[:, :4] = np.frombuffer(HEADER, np.uint8)
    frames[:, 6:DATA] = np.frombuffer(side_information(), np.uint8)
    checked = np.hstack([frames[:, 2:4], frames[:, 6:DATA]])
    frames[:, 4:6] = crc16(checked).astype(">u2").view(np.uint8).reshape(-1, 2)
    frames[:, DATA : DATA + UNIT] = units
    ends = b"".join([TAIL.pack(k, UNIT, 0, zlib.crc32(data[k * UNIT : (k + 1) * UNIT])) for k in range(n)])
    frames[:, DATA + UNIT : DATA + UNIT + TAIL.size] = np.frombuffer(ends, np.uint8).reshape(n, -1)
    total = (n + 1) * SIZE
    seek = bytes(min(255, (1 + p * n // 100) * SIZE * 256 // total) for p in range(100))
    table = OPEN_HEADER + bytes(SIDE) + b"Xing" + struct.pack(">III", 15, n, total) + seek + struct.pack(">I", 0)
    return tag({"payload-bytes": str(n_bytes)}) + table.ljust(SIZE, b"\0") + frames.tobytes()


@dataclass
class Frame:
    at: int
    size: int
    version: int
    layer: int
    rate: int
    kbits: int
    channels: int
    crc: bool
    samples: int
    bound: int  # subbands that Layer I codes for each channel


def header(media: bytes, at: int) -> Frame | None:
    if at + 4 > len(media) or media[at] != 0xFF or media[at + 1] & 0xE0 != 0xE0:
        return None
    b1, b2, b3 = media[at + 1], media[at + 2], media[at + 3]
    version, layer, index, rate = b1 >> 3 & 3, 4 - (b1 >> 1 & 3), b2 >> 4, b2 >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3 or b3 & 3 == 2:
        return None
    hertz = RATES[version][rate]
    kbits = BITRATES[1 if version == 3 else 2, layer][index - 1]
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    pad = b2 >> 1 & 1
    size = (12 * kbits * 1000 // hertz + pad) * 4 if layer == 1 else samples // 8 * kbits * 1000 // hertz + pad
    return Frame(at, size, version, layer, hertz, kbits, 1 if b3 >> 6 == 3 else 2, not b1 & 1, samples, 4 * (1 + (b3 >> 4 & 3)) if b3 >> 6 == 1 else 32)


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    frames: list[Frame] = field(default_factory=list)
    table: dict | None = None
    bad_crc: int = 0
    skipped: int = 0
    resyncs: int = 0


def checked_bytes(f: Frame) -> int:
    """Bytes behind the CRC-16 that it covers, 0 if there is none or (Layer II) it depends on allocation tables."""
    if not f.crc or f.layer == 2:
        return 0
    if f.layer == 3:
        return (SIDE if f.version == 3 else 17) if f.channels == 2 else (17 if f.version == 3 else 9)
    return (32 + f.bound) // 2 if f.channels == 2 else 16


def vbri(media: bytes, at: int) -> dict:
    """The other variable-bitrate table: bytes and frames, and entries of bytes for so many frames each."""
    _, _, _, size, frames, n, scale, width, per = struct.unpack_from(">HHHIIHHHH", media, at + 4) if at + 26 <= len(media) else (0,) * 9
    raw = media[at + 26 : at + 26 + n * width]
    steps = [scale * int.from_bytes(raw[k : k + width], "big") for k in range(0, len(raw) - width + 1, width)] if width else []
    return {"frames": frames, "bytes": size, "frames_per_entry": per, "entries": steps}


def read(media: bytes) -> Stream:
    """Parse a stream: tags, the variable-bitrate table, and every frame whose checksum holds.

    Checksums are those of Layers I and III; frames of Layer II count as good.
    """
    out = Stream()
    at, out.tags = read_tag(media)
    end = len(media)
    old_tag = end - 128 if end >= 128 and media[-128:-125] == b"TAG" else end  # one only if no frame reaches past its start
    synced, held = True, []
    while at < end and at != old_tag:
        f = header(media, at)
        whole = f is not None and at + f.size <= end
        if whole and not synced:
            whole = at + f.size in (old_tag, end) or header(media, at + f.size) is not None
        if not whole:
            out.resyncs += synced
            synced = False
            out.skipped += 1
            at += 1
            continue
        synced = True
        if not held and out.table is None:
            place = at + 4 + (2 * f.crc) + (SIDE if f.channels == 2 else 17) if f.version == 3 else at + 4 + (2 * f.crc) + (17 if f.channels == 2 else 9)
            if media[place : place + 4] in (b"Xing", b"Info"):
                flags = struct.unpack(">I", media[place + 4 : place + 8])[0]
                p, out.table = place + 8, {}
                for bit, name in ((1, "frames"), (2, "bytes")):
                    if flags & bit:
                        out.table[name] = struct.unpack(">I", media[p : p + 4])[0]
                        p += 4
                if flags & 4:
                    out.table["seek"] = media[p : p + 100]
                at += f.size
                continue
            if media[at + 36 : at + 40] == b"VBRI":
                out.table = vbri(media, at + 36)
                at += f.size
                continue
        held.append(f)
        at += f.size
    good = {f.at for f in held if not checked_bytes(f)}
    data = np.frombuffer(media, np.uint8)
    for n in {checked_bytes(f) for f in held} - {0}:
        starts = np.array([f.at for f in held if checked_bytes(f) == n])
        rows = data[np.minimum(starts[:, None] + np.concatenate([[2, 3], np.arange(6, 6 + n)]), len(data) - 1)]
        ok = crc16(rows) == data[starts + 4].astype(np.uint16) << np.uint16(8) | data[starts + 5]
        good |= set(starts[ok].tolist())
    out.frames = [f for f in held if f.at in good]
    out.bad_crc = len(held) - len(out.frames)
    return out


def stored(media: bytes, stream: Stream) -> tuple[bytes, int]:
    """The payload out of the frames in order of their numbers, and how many units fail their CRC-32 or are missing."""
    units, bad = {}, 0
    for f in stream.frames:
        unit = media[f.at + DATA : f.at + DATA + UNIT]
        if f.size < DATA + UNIT + TAIL.size:
            bad += 1
            continue
        number, length, _, crc = TAIL.unpack_from(media, f.at + DATA + UNIT)
        if length != UNIT or zlib.crc32(unit) != crc:
            bad += 1
        else:
            units[number] = unit
    told = (stream.table or {}).get("frames", len(units))
    return b"".join(units[k] for k in sorted(units)), bad + max(0, told - len(units) - bad)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the binary column `media`. A null text counts as empty and is one unit of bytes 255."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            _, offsets = utf8(batch.column("text"))
            for a, b in chunks(offsets, 2_000_000):
                data, own = utf8(batch.column("text").slice(a, b - a))
                raw, own = data.tobytes(), own.tolist()
                texts = [raw[x:y] for x, y in zip(own[:-1], own[1:], strict=True)]
                media = [encode(payload(t), len(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(list(map(len, texts)), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])
        release()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_bytes long, media binary")


FACTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_samples long, sample_rate int, seek_offsets array<long>"


def facts(stored_media: DataFrame) -> DataFrame:
    """Read the column `media` back: digests of the payload and of the stored form, exact duration, seek offsets.

    `feature` names frames, samples and rate (the exact duration is their ratio), checksum failures, resyncs, the
    first and the last frame's offset with a CRC-32 of all offsets, and the mean and deviation of the samples. The exact
    duration is duration_samples / sample_rate seconds, and seek_offsets holds where each frame begins.
    """

    def one(media: bytes) -> tuple:
        s = read(media)
        data, bad = stored(media, s)
        offsets = np.array([f.at for f in s.frames], "<i8")
        samples = np.frombuffer(data, np.uint8)
        rate = s.frames[0].rate if s.frames else 0
        what = (
            f"frames={len(offsets)};samples={sum(f.samples for f in s.frames)};rate={rate};table={(s.table or {}).get('frames', 0)};bad={s.bad_crc + bad};resyncs={s.resyncs};"
            f"seek={int(offsets[0]) if len(offsets) else -1}..{int(offsets[-1]) if len(offsets) else -1}/{zlib.crc32(offsets.tobytes()):08x};"
            f"mean={samples.mean() if len(samples) else 0:.6f};sd={samples.std() if len(samples) else 0:.6f}"
        )
        n = int(s.tags.get("payload-bytes", -1))
        return n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), what, sum(f.samples for f in s.frames), rate, offsets

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            got = [one(m.as_buffer().to_pybytes()) for m in batch.column("media")]
            cols = list(zip(*got, strict=True)) if got else [()] * 10
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
            names = [x.split()[0] for x in FACTS.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=names)
        release()

    return stored_media.select("doc_id", "media").mapInArrow(run, FACTS)


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every text and read it back: one row per document, see `facts`.

    A null text counts as empty; a null doc_id is kept; repeated rows give repeated, equal results; an empty table
    gives none. Texts of any length are stored whole; nothing is ranked, so ties cannot arise. Columns other than doc_id and text are not read.
    """
    return facts(store(small_batches(docs)))
