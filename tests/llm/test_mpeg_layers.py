"""Checksums of layers I and II against a bit-by-bit register, and the offsets of the registered query."""

import random

import pytest

from chronolith.llm import mpeg, queries


def register(bits):
    value = 0xFFFF
    for b in bits:
        top = (value >> 15 & 1) ^ b
        value = value << 1 & 0xFFFF
        if top:
            value ^= 0x8005
    return value


def bits_of(data):
    return [x >> (7 - i) & 1 for x in data for i in range(8)]


def frame(layer, index, rate, mode, extension, fill):
    """A protected frame of version 1 with ``fill`` after its checksum, and how many bits the checksum covers."""
    two = bytes([index << 4 | rate << 2, mode << 6 | extension << 4])
    start = bytes([0xFF, 0xE0 | 3 << 3 | (4 - layer) << 1])
    head = mpeg.header_of(start + two)
    body = fill(head.length - 6)
    # an own reading of the allocations
    channels, bound = (1, 32) if mode == 3 else (2, 4 * (extension + 1) if mode == 1 else 32)
    if layer == 1:
        widths = [4] * 32
    else:
        each = mpeg.BITRATES[True, 2][index - 1] // channels
        hz = mpeg.SAMPLE_RATES[3][rate]
        name = "a" if (hz == 48000 and each >= 56) or 56 <= each <= 80 else "b" if hz != 48000 and each >= 96 else "c" if hz != 32000 and each <= 48 else "d"
        limit = {"a": 27, "b": 30, "c": 8, "d": 12}[name]
        widths = [(4 if i < 11 else 3 if i < 23 else 2) if name in "ab" else (4 if i < 2 else 3) for i in range(limit)]
    stream, at, selected = bits_of(body), 0, 0
    for band, width in enumerate(widths):
        for _ in range(1 if band >= bound else channels):
            selected += (channels if band >= bound else 1) if any(stream[at:at + width]) else 0
            at += width
    covered = at + (2 * selected if layer == 2 else 0)
    value = register(bits_of(two) + stream[:covered])
    return start + two + value.to_bytes(2, "big") + body


CASES = [(1, 9, 0, 0, 0), (1, 12, 1, 1, 2), (1, 5, 2, 3, 0), (2, 10, 1, 0, 0), (2, 12, 0, 1, 1), (2, 3, 1, 3, 0), (2, 2, 2, 3, 0), (2, 14, 0, 2, 0), (2, 6, 0, 3, 0), (2, 8, 0, 1, 3)]


@pytest.mark.parametrize("layer, index, rate, mode, extension", CASES)
def test_checksums_of_layers(layer, index, rate, mode, extension):
    draw = random.Random(index)
    fills = [draw.randbytes, lambda n: bytes(n), lambda n: b"\x10" + bytes(n - 1)]
    frames = [frame(layer, index, rate, mode, extension, f) for f in fills]
    good = mpeg.read_audio(b"".join(frames))
    assert (good.checked, good.failed, len(good.offsets)) == (3, 0, 3)
    broken = bytearray(b"".join(frames))
    broken[len(frames[0]) + 6] ^= 0x40
    assert mpeg.read_audio(bytes(broken)).failed == 1


def test_registered_query_keeps_offsets(spark):
    import hashlib
    import zlib

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.QUERIES["op5_mpeg_audio"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        data = docs[r.doc_id].encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert len(r.seek_offsets) >= 1 and list(r.seek_offsets) == sorted(set(r.seek_offsets)) and r.seek_offsets[-1] < r.media_bytes
        assert r.seconds == pytest.approx(len(r.seek_offsets) * 1152 / 48000)
