import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinlattice.llm import ogg


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


@given(st.binary(max_size=300))
@settings(max_examples=50, deadline=None)
def test_crc_against_bitwise(data):
    assert ogg.page_crc(data) == slow_crc(data)


@pytest.mark.parametrize("sizes", [[0], [255], [254, 256, 0, 510], [70000, 3], [255 * 255], [255 * 254, 255, 1]])
def test_round_trip_of_two_streams(sizes):
    a = [ogg.Packet(bytes([i % 251]) * n, 10 * (i + 1)) for i, n in enumerate(sizes)]
    b = [ogg.Packet(b"h", 0), ogg.Packet(b"x" * 1000, 5)]
    streams, damage = ogg.demux(ogg.mux([ogg.mux_stream(7, a), ogg.mux_stream(9, b)]))
    assert damage == 0 and [p.data for p in streams[7].packets] == [p.data for p in a]
    assert [p.data for p in streams[9].packets] == [b"h", b"x" * 1000] and streams[7].ended and streams[9].ended


def test_damage_is_found_and_others_survive():
    packets = [ogg.Packet(bytes([i % 256]) * 100, i) for i in range(600)]
    pages = ogg.mux_stream(3, packets)
    assert len(pages) == 4
    bad = bytearray(b"".join(pages))
    bad[len(pages[0]) + 400] ^= 1
    streams, damage = ogg.demux(bytes(bad))
    got = [p.data for p in streams[3].packets]
    assert damage >= 1 and got == [packets[0].data, *(p.data for p in packets[256:])]


def test_times_come_from_granules():
    payload, _ = ogg.samples_of("a" * 100_000)
    media = ogg.encode_samples(payload, b"")
    samples, _, seconds, damage = ogg.decode_samples(media)
    assert samples == payload and damage == 0 and seconds == pytest.approx(len(payload) / ogg.RATE)
    streams, _ = ogg.demux(media)
    times = next(ogg.packet_seconds(s) for s in streams.values() if len(s.packets) > 3)
    assert times[1:] == pytest.approx([(i + 1) * ogg.FRAME / ogg.RATE for i in range(len(times) - 1)])


def test_columns(docs):
    rows = [(1, "Grüße"), (2, None), (3, ""), (4, "x" * 576), (5, "y" * 200_000), (6, "Grüße"), (None, "z")]
    df = docs(rows).withColumnRenamed("n_chars", "media")  # a clashing column
    got = {r.doc_id: r for r in ogg.describe(ogg.store(df)).collect()}
    assert len(got) == 7
    for i, t in rows:
        raw = (t or "").encode()
        want = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.damage) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]), 0)
    assert got[1].media_sha256 == got[6].media_sha256 and got[1].feature == got[6].feature
    assert ogg.describe(ogg.store(docs([]))).count() == 0
    assert ogg.demux(struct.pack("<q", 5) + b"OggS")[1] >= 1
