import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowgrain.llm import flac
from flowgrain.llm.media import payload, to_flac, to_pcm
from flowgrain.llm.queries_media import op10

from .cases import AWKWARD, SMALL, folder, frame


def crc(data, poly, width):
    reg, top = 0, 1 << (width - 1)
    for byte in data:
        reg ^= byte << (width - 8)
        for _ in range(8):
            reg = (reg << 1 ^ poly if reg & top else reg << 1) & (1 << width) - 1
    return reg


def stream(subframes, block, bits=8, layout=0, channels=1, md5=bytes(16)):
    """A stream of one frame from bit strings, written as the format describes."""
    head = bytes([0xFF, 0xF8, 0x70, layout << 4 | {8: 2, 16: 8}[bits], 0]) + struct.pack(">H", block - 1)
    head += bytes([crc(head, 0x07, 8)])
    body = "".join(subframes)
    body += "0" * (-len(body) % 8)
    data = head + int(body, 2).to_bytes(len(body) // 8, "big")
    data += crc(data, 0x8005, 16).to_bytes(2, "big")
    packed = 8000 << 44 | (channels - 1) << 41 | (bits - 1) << 36 | block
    info = struct.pack(">HH", block, block) + bytes(6) + packed.to_bytes(8, "big") + md5
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + data


def signed(x, n):
    return format(x & (1 << n) - 1, f"0{n}b")


def rice(x, k):
    u = x << 1 if x >= 0 else (-x << 1) - 1
    return "0" * (u >> k) + "1" + (format(u & (1 << k) - 1, f"0{k}b") if k else "")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=900), st.text(max_size=300).map(str.encode),
                          st.integers(0, 255).map(lambda b: bytes([b]) * 400)), min_size=1, max_size=5))
def test_round_trip_by_both_readers(raw):
    sent = [payload(r) for r in raw]
    streams = flac.encode(sent)
    for p, s, d in zip(sent, streams, flac.decode(streams), strict=True):
        plain = flac.read_stream(s)
        assert d.pcm == plain.pcm == p
        assert d.offsets.tolist() == plain.offsets.tolist()


def test_every_predictor_and_code_is_used():
    rng = random.Random(3)
    waves = [bytes(int(128 + 100 * np.sin(i / 40)) for i in range(960)), bytes(i % 256 for i in range(960)),
             rng.randbytes(960), b"z" * 960, bytes(128 + rng.randrange(-2, 3) for _ in range(960)),
             bytes(int(128 + 120 * np.sin(i / 9)) for i in range(960))]
    kinds = set()
    for s, w in zip(flac.encode(waves), waves, strict=True):
        d = flac.read_stream(s)
        kinds |= {s[o + 6] for o in d.offsets.tolist()}
        assert d.pcm == w
    assert {0, 2} < kinds and len(kinds) >= 5


def test_long_stream_has_long_frame_numbers_and_seek_points():
    raw = bytes(random.Random(1).choices(b"abcdef ", k=192 * 70000))
    out = flac.encode([raw])[0]
    d = flac.decode([out])[0]
    assert d.pcm == raw
    at = out.index(b"\x83") if out[42] != 0x83 else 42
    size = int.from_bytes(out[at + 1:at + 4], "big")
    frames = at + 4 + size
    for p in range(0, size, 18 * 97):
        sample, offset, n = struct.unpack(">QQH", out[at + 4 + p:at + 22 + p])
        assert n == 192 and d.offsets[sample // 192] == frames + offset


def test_general_predictor_partitions_escape_and_wasted_bits():
    data = [10, 12, 15, 14, 9, 3, -2, -8, -9, -4, 0, 6, 9, 11, 14, 16]
    residual = []
    for i in range(2, 16):
        residual.append(data[i] - ((7 * data[i - 1] - 4 * data[i - 2]) >> 2))
    lpc = "0" + "100001" + "0" + "".join(signed(x, 8) for x in data[:2]) + format(3, "04b") + signed(2, 5) + (
        signed(7, 4) + signed(-4, 4)) + "00" + "0001" + format(2, "04b") + "".join(rice(x, 2) for x in residual[:6]) + (
        "1111" + format(9, "05b") + "".join(signed(x, 9) for x in residual[6:]))
    got = flac.read_stream(stream([lpc], 16))
    assert list(got.pcm) == [x + 128 for x in data]
    assert flac.decode([stream([lpc], 16)])[0].pcm == got.pcm
    wasted = "0" + "000001" + "1" + "01" + "".join(signed(x, 6) for x in range(16))
    assert list(flac.read_stream(stream([wasted], 16)).pcm) == [4 * x + 128 for x in range(16)]


@pytest.mark.parametrize("layout", [1, 8, 9, 10])
def test_stereo(layout):
    rng = random.Random(layout)
    a, b = ([rng.randrange(-3000, 3000) for _ in range(16)] for _ in range(2))
    side = [x - y for x, y in zip(a, b, strict=True)]
    first, second = {1: (a, b), 8: (a, side), 9: (side, b), 10: ([(x + y) >> 1 for x, y in zip(a, b, strict=True)], side)}[layout]
    plain = lambda xs, n: "0" + "000001" + "0" + "".join(signed(x, n) for x in xs)
    raw = np.array([a, b], "<i2").T.tobytes()
    made = stream([plain(first, 17 if layout == 9 else 16), plain(second, 17 if layout in (8, 10) else 16)], 16, 16,
                  layout, 2, hashlib.md5(raw).digest())
    assert flac.read_stream(made).pcm == raw


def test_a_changed_byte_is_found():
    good = flac.encode([payload(b"some text here " * 40)])[0]
    rng = random.Random(2)
    for _ in range(40):
        at = rng.randrange(26, len(good))
        if 42 <= at < 46 + int.from_bytes(good[43:46], "big"):
            continue  # the seek table has no checksum
        bad = bytearray(good)
        bad[at] ^= 1 << rng.randrange(8)
        with pytest.raises((flac.Broken, IndexError)):
            flac.decode([bytes(bad)])


def expect(text):
    raw = (text or "").encode()
    p = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
    return len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])


def test_query_against_plain(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    stored = {r.doc_id: bytes(r.media) for r in to_flac(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}
    rows = op10(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == expect(docs[r.doc_id])
        assert (r.media_bytes, r.media_sha256) == (len(stored[r.doc_id]), hashlib.sha256(stored[r.doc_id]).hexdigest())


def test_awkward_rows(spark, tmp_path):
    docs = frame(spark, AWKWARD).selectExpr("*", "1 as media", "2 as blocks", "3 as n_bytes")
    rows = {r.doc_id: r for r in op10(spark, folder(tmp_path, spark, documents=docs)).collect()}
    for i, t in enumerate(AWKWARD):
        assert (rows[i].n_bytes, rows[i].payload_bytes, rows[i].payload_sha256, rows[i].tail_crc32) == expect(t)
    assert rows[7].media_sha256 == rows[8].media_sha256 and rows[7].feature == rows[8].feature


def test_blocks_can_be_sought(spark):
    docs = frame(spark, ["some words " * 900])
    r = to_pcm(to_flac(docs), block=1000).first()
    assert [b.sample_offset for b in r.blocks] == sorted({-(-s // 192) * 192 for s in range(0, 9984, 1000)})
    at = 0
    for b in r.blocks:
        assert b.sample_offset == at and len(b.pcm) == b.samples
        assert r.media[b.byte_offset:b.byte_offset + 2] == b"\xff\xf8"
        at += b.samples


def test_broken_streams_stay_as_rows(spark):
    good = flac.encode([payload(b"abc")])[0]
    rows = [(1, good), (2, None), (3, b""), (4, good[:-1]), (5, b"fLaC")]
    got = {r.id: r for r in to_pcm(spark.createDataFrame(rows, "id int, media binary")).collect()}
    assert got[1].error is None and len(got[1].blocks) == 1
    assert all(got[i].blocks is None and got[i].error for i in (2, 3, 4, 5))


def test_empty_table(spark, tmp_path):
    assert op10(spark, folder(tmp_path, spark, documents=frame(spark, []))).count() == 0
