"""MPEG audio as a column: framing of bytes, and reading of frames, tags, variable-bitrate tables and checksums."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import pick

# Fixed values of the format: kbit/s by (version 1?, layer), sample rates by version.
BITRATES = {
    (True, 1): [32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
# bits of an allocation per subband, layer II: of version 1 by rate and bitrate a channel, and of the lower rates
ALLOCATIONS = {
    "a": [4] * 11 + [3] * 12 + [2] * 4, "b": [4] * 11 + [3] * 12 + [2] * 7, "c": [4] * 2 + [3] * 6, "d": [4] * 2 + [3] * 10, "low": [4] * 4 + [3] * 7 + [2] * 19,
}
SAMPLE_RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    rate: int
    length: int
    samples: int
    side: int
    kbit: int
    channels: int
    shared_from: int


@lru_cache(maxsize=4096)
def header_of(four: bytes) -> Header | None:
    """The frame header in four bytes; None if they are none (free-format frames are not read)."""
    if len(four) < 4 or four[0] != 0xFF or four[1] < 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    index, rate_index, padding = four[2] >> 4, four[2] >> 2 & 3, four[2] >> 1 & 1
    if version == 1 or layer == 4 or index in (0, 15) or rate_index == 3 or four[3] & 3 == 2:
        return None
    bits, rate = BITRATES[version == 3, layer][index - 1] * 1000, SAMPLE_RATES[version][rate_index]
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    length = (12 * bits // rate + padding) * 4 if layer == 1 else samples // 8 * bits // rate + padding
    mono = four[3] >> 6 == 3
    side = ((17 if mono else 32) if version == 3 else (9 if mono else 17)) if layer == 3 else 0
    # joint stereo shares the allocations of the subbands from here on
    shared = 4 * ((four[3] >> 4 & 3) + 1) if four[3] >> 6 == 1 else 32
    return Header(version, layer, not four[1] & 1, rate, length, samples, side, bits // 1000, 1 if mono else 2, shared)


@lru_cache(maxsize=65_536)
def crc16(data: bytes) -> int:
    """The checksum of a frame: polynomial 0x8005, start 0xFFFF."""
    value = 0xFFFF
    for byte in data:
        value ^= byte << 8
        for _ in range(8):
            value = (value << 1 ^ 0x8005 if value & 0x8000 else value << 1) & 0xFFFF
    return value


@dataclass
class Audio:
    """What was read of one file."""

    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: bytes = b""
    checked: int = 0
    failed: int = 0
    skipped: int = 0
    body: bytes = b""

    @property
    def seconds(self) -> float:
        return self.samples / self.rate if self.rate else 0.0


def _id3(data: bytes) -> tuple[int, dict[str, str]]:
    """(bytes taken, text frames) of a leading tag of version 2.3 or 2.4."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0, {}
    plain = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    size, at, tags = plain(data[6:10]), 10, {}
    end = min(10 + size, len(data))
    while at + 10 <= end and data[at] != 0:
        name, n = data[at:at + 4].decode("latin-1"), plain(data[at + 4:at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4:at + 8], "big")
        value = data[at + 10:min(at + 10 + n, end)]
        if name[0] == "T" and value:
            text = value[1:].decode({0: "latin-1", 3: "utf-8"}.get(value[0], "utf-16"), "replace")
            key, _, rest = text.partition("\0")
            tags[f"{name}:{key}" if name == "TXXX" else name] = rest if name == "TXXX" else key
        at += 10 + n
    return min(10 + size, len(data)), tags


def _allocations(head: Header) -> list[int]:
    """Bits of the allocation of every subband of a layer I or II frame."""
    if head.layer == 1:
        return [4] * 32
    if head.version != 3:
        return ALLOCATIONS["low"]
    each = head.kbit // head.channels
    if head.rate == 48000 and each >= 56 or 56 <= each <= 80:
        return ALLOCATIONS["a"]
    if head.rate != 48000 and each >= 96:
        return ALLOCATIONS["b"]
    return ALLOCATIONS["c" if head.rate != 32000 and each <= 48 else "d"]


def frame_checksum(data: bytes, at: int, head: Header) -> int:
    """The checksum that a protected frame at ``at`` should carry.

    It covers the last two bytes of the header and what follows the checksum: the side information in layer III, the allocations in layer I, the
    allocations and two selection bits for every allocated subband and channel in layer II.
    """
    begin = at + 6
    if head.layer == 3:
        return crc16(data[at + 2:at + 4] + data[begin:begin + head.side])
    body = data[begin:min(at + head.length, begin + 64)]
    held, place, used = int.from_bytes(body.ljust(64, b"\0"), "big"), 0, 0
    for band, bits in enumerate(_allocations(head)):
        together = band >= head.shared_from and head.channels == 2
        for _ in range(1 if together else head.channels):
            place += bits
            if held >> (512 - place) & ((1 << bits) - 1):
                used += head.channels if together else 1
    covered = place + (2 * used if head.layer == 2 else 0)
    value = crc16(data[at + 2:at + 4] + body[:covered // 8])
    for i in range(covered // 8 * 8, covered):
        top = (value >> 15) ^ (held >> (511 - i) & 1)
        value = (value << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return value


def _table(data: bytes, at: int, head: Header, audio: Audio) -> bool:
    """Reads a Xing, Info or VBRI table; True if the frame holds one and so no sound."""
    for place in (at + 4 + head.side, at + 6 + head.side):
        if data[place:place + 4] in (b"Xing", b"Info"):
            flags, place = int.from_bytes(data[place + 4:place + 8], "big"), place + 8
            for bit, name in ((1, "table_frames"), (2, "table_bytes")):
                if flags & bit:
                    setattr(audio, name, int.from_bytes(data[place:place + 4], "big"))
                    place += 4
            audio.toc = data[place:place + 100] if flags & 4 else b""
            return True
    if data[at + 36:at + 40] == b"VBRI":
        audio.table_bytes, audio.table_frames = struct.unpack(">II", data[at + 46:at + 54].ljust(8, b"\0"))
        return True
    return False


def read_audio(data: bytes) -> Audio:
    """Walks the frames. Bytes that start no frame are skipped up to the next header that another frame, a tag or the end follows.

    The last 128 bytes are a tag only where no frame that another frame or the end follows reaches into them.
    """
    audio = Audio()
    at, audio.tags = _id3(data)
    end = len(data)
    tag = end - 128 if end - at >= 128 and data[end - 128:end - 125] == b"TAG" else -1
    bodies, known, first = [], False, True
    while at + 4 <= end:
        head = header_of(data[at:at + 4])
        whole = head is not None and at + head.length <= end
        if whole and (not known or at < tag < at + head.length):
            after = at + head.length
            whole = after in (end, tag) or header_of(data[after:after + 4]) is not None
        if not whole and at == tag:
            end = tag
            audio.tags["TIT1"] = data[end + 3:end + 33].rstrip(b"\0 ").decode("latin-1")
            break
        if not whole:
            known = False
            stop = tag if at < tag else end
            found = data.find(b"\xff", at + 1, stop)
            audio.skipped += (found if found >= 0 else stop) - at
            at = found if found >= 0 else stop
            continue
        known = True
        begin = at + 4
        if head.protected:
            begin += 2
            audio.checked += 1
            audio.failed += frame_checksum(data, at, head) != int.from_bytes(data[at + 4:at + 6], "big")
        if not (first and _table(data, at, head, audio)):
            audio.offsets.append(at)
            audio.samples += head.samples
            audio.rate = audio.rate or head.rate
            bodies.append(data[begin + head.side:at + head.length])
        first = False
        at += head.length
    audio.skipped += max(0, end - at)
    audio.body = b"".join(bodies)
    return audio


_SIDE = 17
_FRAMES = [(4 + 2 + _SIDE, 3 * kbit, i + 1) for i, kbit in enumerate(BITRATES[True, 3])]


def _frame(body: bytes) -> bytes:
    """A mono 48 kHz layer III frame with silent granules; ``body`` lies in its ancillary bytes."""
    head, length, index = next(x for x in _FRAMES if x[1] - x[0] >= len(body))
    two = bytes([index << 4 | 1 << 2, 0xC0])
    side = bytes(_SIDE)
    return b"\xff\xfa" + two + crc16(two + side).to_bytes(2, "big") + side + body.ljust(length - head, b"\0")


def write_audio(payload: bytes, tags: dict[str, str]) -> bytes:
    """Frames that carry ``payload`` unchanged behind a tag and a variable-bitrate table with 100 seek points."""
    room = _FRAMES[-1][1] - _FRAMES[-1][0]
    frames = [_frame(payload[i:i + room]) for i in range(0, len(payload), room)]
    text = b"".join(
        b"TXXX" + (len(v := b"\0" + k.encode("latin-1") + b"\0" + x.encode("latin-1"))).to_bytes(4, "big") + b"\0\0" + v for k, x in tags.items()
    )
    n = len(text)
    tag = b"ID3\x03\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + text
    lead = len(_frame(bytes(120)))
    starts = [lead]
    for f in frames:
        starts.append(starts[-1] + len(f))
    toc = bytes(min(255, 256 * starts[len(frames) * i // 100] // starts[-1]) for i in range(100))
    table = _frame(b"Xing" + struct.pack(">III", 15, len(frames), starts[-1]) + toc + bytes(4))
    return tag + table + b"".join(frames)


def framed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: int = 64) -> DataFrame:
    """(doc_id, n_bytes, media): the UTF-8 bytes of ``text`` (null: none), zero-padded to a positive multiple of ``unit``, as MPEG audio."""
    rows = pick(docs, doc_id=doc_id, text=text)

    @F.pandas_udf("binary")
    def media(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            data = (t or "").encode()
            payload = data.ljust(max(unit, -(-len(data) // unit) * unit), b"\0")
            out.append(write_audio(payload, {"bytes": str(len(data)), "payload": str(len(payload)), "crc32": str(zlib.crc32(payload))}))
        return pd.Series(out)

    return rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), media(F.col("text")).alias("media"))


AUDIO_FIELDS = (
    "frames bigint, samples bigint, sample_rate int, seconds double, table_frames bigint, table_bytes bigint, "
    "checked bigint, failed bigint, skipped bigint, tags map<string,string>, seek_offsets array<bigint>, payload binary"
)


def audio_columns(media: DataFrame, column: str = "media", payload: bool = True) -> DataFrame:
    """All columns of ``media`` plus the struct ``audio``: exact duration, checksums, tags, the offset of every frame, and the carried bytes.

    Null and empty files have no frames and the duration 0; files without any frame count all bytes as skipped.
    A payload whose tag's checksum differs is null.
    """

    @F.pandas_udf(AUDIO_FIELDS)
    def read(files: pd.Series) -> pd.DataFrame:
        rows = []
        for data in files:
            a = read_audio(bytes(data) if data is not None else b"")
            body = None
            if payload and "TXXX:payload" in a.tags:
                body = a.body[:int(a.tags["TXXX:payload"])]
                if zlib.crc32(body) != int(a.tags.get("TXXX:crc32", -1)):
                    body = None
            rows.append((
                len(a.offsets), a.samples, a.rate, a.seconds, a.table_frames, a.table_bytes, a.checked, a.failed, a.skipped, a.tags, a.offsets, body
            ))
        names = [f.strip().split(" ")[0] for f in AUDIO_FIELDS.replace("map<string,string>", "map").split(",")]
        out = pd.DataFrame(rows, columns=names)
        for c in ("table_frames", "table_bytes"):
            out[c] = out[c].astype("Int64")
        return out

    return media.withColumn("audio", read(F.col(column)))
