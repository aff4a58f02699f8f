"""Media columns: Ogg containers written to and read from binary columns.

Pages follow the public Ogg bitstream description (RFC 3533): a 27-byte header, lacing values,
a body, and a CRC over the whole page with its checksum field zero. Reading verifies every
checksum, reassembles packets from the lacing values, separates logical streams by serial number,
and derives a packet's time from the granule positions.

Defined cases: null bytes or text count as empty; bytes that are no page are skipped to the next
capture pattern and counted as damage; a page with a wrong checksum is not used and a packet that
ran through it is given up; equal inputs give equal bytes, as serial numbers come from the content.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, map_columns, table

FRAME = 576
RATE = 8000
_REV = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")


def page_crc(page: bytes) -> int:
    """The page checksum: polynomial 0x04C11DB7, most significant bit first, zero start.

    Bit-reversing every byte turns it into the reflected form that zlib computes.
    """
    reflected = zlib.crc32(page.translate(_REV), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_REV), "big")


@dataclass
class Packet:
    data: bytes
    granule: int


@dataclass
class Stream:
    serial: int
    packets: list[Packet] = field(default_factory=list)
    ended: bool = False
    lost: int = 0


def _page(serial: int, number: int, kind: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, kind, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_crc(head + body)
    return b"".join((head[:22], struct.pack("<I", crc), head[26:], body))


def mux_stream(serial: int, packets: list[Packet], per_page: int = 255) -> list[bytes]:
    """Pages of one logical stream; the first packet has the first page to itself."""
    pages: list[bytes] = []
    lacing, body, granule, fresh = bytearray(), [], -1, True

    def flush(last: bool) -> None:
        nonlocal lacing, body, granule, fresh
        kind = (0 if fresh else 1) | (2 if not pages else 0) | (4 if last else 0)
        pages.append(_page(serial, len(pages), kind, granule, bytes(lacing), b"".join(body)))
        lacing, body, granule = bytearray(), [], -1

    for i, p in enumerate(packets):
        left = p.data
        sizes = [255] * (len(left) // 255) + [len(left) % 255]
        at = 0
        for j, size in enumerate(sizes):
            if len(lacing) == per_page:
                flush(False)
                fresh = j == 0
            lacing.append(size)
            body.append(left[at : at + size])
            at += size
        granule = p.granule
        if i == len(packets) - 1:
            flush(True)
        elif i == 0:
            flush(False)
            fresh = True
    return pages


def mux(streams: list[list[bytes]]) -> bytes:
    """Interleave pages: all beginnings first, then the streams in turn."""
    out = [s[0] for s in streams if s]
    rest = [s[1:] for s in streams]
    for i in range(max(map(len, rest), default=0)):
        out += [s[i] for s in rest if i < len(s)]
    return b"".join(out)


def demux(media: bytes) -> tuple[dict[int, Stream], int]:
    """Logical streams by serial number, and how many damaged places were met."""
    streams: dict[int, Stream] = {}
    open_: dict[int, list[bytes] | None] = {}
    expected: dict[int, int] = {}
    at, damage, n = 0, 0, len(media)
    while at < n:
        if media[at : at + 4] != b"OggS" or at + 27 > n:
            at, damage = (media.find(b"OggS", at + 1) + 1 or n + 1) - 1, damage + 1
            continue
        _, version, kind, granule, serial, number, crc, count = _HEAD.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + count]
        body_at = at + 27 + count
        end = body_at + sum(lacing)
        if version or len(lacing) < count or end > n or page_crc(b"".join((media[at : at + 22], b"\0\0\0\0", media[at + 26 : end]))) != crc:
            at, damage = (media.find(b"OggS", at + 1) + 1 or n + 1) - 1, damage + 1
            continue
        s = streams.setdefault(serial, Stream(serial))
        part = open_.get(serial)
        if expected.get(serial, number) != number:  # pages are missing
            damage, s.lost, part = damage + 1, s.lost + (part is not None and bool(part)), None
            skip = bool(kind & 1)
        else:
            skip = bool(kind & 1) and not part
        if not kind & 1:
            part = []
        part = part if part is not None else []
        done: list[Packet] = []
        at, run = body_at, 0
        for size in lacing:
            run += size
            if size < 255:
                piece = media[at : at + run]
                at, run = at + run, 0
                if skip:
                    skip, s.lost = False, s.lost + 1
                else:
                    done.append(Packet(b"".join((*part, piece)) if part else piece, -1))
                part = []
        if run and not skip:
            part.append(media[at : at + run])
        if done:
            done[-1].granule = granule
            s.packets += done
        open_[serial], expected[serial] = part, number + 1
        s.ended |= bool(kind & 4)
        at = end
    return streams, damage


def packet_seconds(stream: Stream, rate: int = RATE) -> list[float]:
    """End time of each packet: pages give the granule of their last packet, the others lie evenly between."""
    times, before, waiting = [0.0] * len(stream.packets), 0, []
    for i, p in enumerate(stream.packets):
        waiting.append(i)
        if p.granule >= 0:
            for k, j in enumerate(waiting, 1):
                times[j] = (before + (p.granule - before) * k / len(waiting)) / rate
            before, waiting = p.granule, []
    for j in waiting:
        times[j] = before / rate
    return times


def encode_samples(payload: bytes, meta: bytes) -> bytes:
    """Two logical streams: 8-bit samples in packets of one frame, and a remark that holds meta."""
    serial = zlib.crc32(payload) & 0xFFFFFFFE
    head = struct.pack("<8sIHH", b"PCM8    ", RATE, 1, FRAME)
    packets = [Packet(head, 0)] + [Packet(payload[i : i + FRAME], i + FRAME) for i in range(0, len(payload), FRAME)]
    remark = [Packet(b"REMARK  ", 0), Packet(meta, len(payload))]
    return mux([mux_stream(serial, packets), mux_stream(serial | 1, remark)])


def decode_samples(media: bytes) -> tuple[bytes, bytes, float, int]:
    """Samples, remark, seconds and damage of what encode_samples has stored."""
    streams, damage = demux(media)
    payload, meta, seconds = b"", b"", 0.0
    for s in streams.values():
        if not s.packets:
            continue
        if s.packets[0].data.startswith(b"PCM8"):
            payload = b"".join(p.data for p in s.packets[1:])
            seconds = packet_seconds(s)[-1]
        elif s.packets[0].data == b"REMARK  ":
            meta = b"".join(p.data for p in s.packets[1:])
    return payload, meta, seconds, damage


def samples_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes of a text, filled with 255 up to a positive multiple of the frame; and how many are the text's."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (-len(raw) % FRAME or (0 if raw else FRAME)), len(raw)


def feature(samples: bytes, seconds: float) -> str:
    """Seconds, root mean square, sign changes and loudest frame of 8-bit samples around 128."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    if not len(x):
        return "empty"
    whole = x[: len(x) // FRAME * FRAME].reshape(-1, FRAME)
    energy = np.einsum("ij,ij->i", whole, whole)
    changes = int(np.count_nonzero(np.signbit(x[1:]) != np.signbit(x[:-1])))
    rms = float(np.sqrt(np.float64(energy.sum(dtype=np.float64)) / len(x)))
    return f"s={seconds:.4f};rms={rms:.3f};zc={changes};peak={int(energy.argmax()) if len(energy) else 0}"


def store(df: DataFrame, key: str = "doc_id", text: str = "text", media: str = "media") -> DataFrame:
    """One row per row of df: its key and the Ogg file that holds its text as samples."""

    def write(keys: list, texts: list) -> dict:
        out = []
        for t in texts:
            payload, n = samples_of(t)
            out.append(encode_samples(payload, struct.pack("<q", n)))
        return {key: keys, media: out}

    return map_columns(df, [F.col(key).cast("long"), F.col(text)], write, f"`{key}` long, `{media}` binary")


def describe(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """Read stored files back: sizes, digests, features and damage."""

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seconds", "damage"]

    def read(keys: list, files: list) -> dict:
        rows = []
        for stored in files:
            stored = stored or b""
            samples, meta, seconds, damage = decode_samples(stored)
            n = struct.unpack("<q", meta)[0] if len(meta) == 8 else len(samples)
            rows.append((n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples, seconds), seconds, damage))
        return {key: keys, **columns(names, rows)}

    schema = f"`{key}` long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double, damage long"
    return map_columns(df, [F.col(key).cast("long"), F.col(media)], read, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return describe(store(table(spark, sf_dir, "documents")))
