import hashlib
import os
import zlib

import pytest

from scoreline.llm import transport_stream as ts


@pytest.mark.parametrize("n", [0, 1, 64, 161, 162, 163, 176, 345, 346, 347, 16383, 16384, 16385, 70000])
def test_round_trip(n):
    payload = os.urandom(n)
    stream, stamps, points, offsets = ts.mux_bytes(payload)
    r = ts.demux_bytes(stream)
    assert (r["pts"], r["random_access"], r["random_offset"]) == (stamps, points, offsets)
    assert all(stream[o] == 0x47 and stream[o + 5] & 0x40 for o in offsets)
    assert r["payload"] == payload and len(stream) % 188 == 0
    assert (r["program"], r["es_pid"], r["stream_type"]) == (1, 257, 6)
    assert r["continuity_errors"] == r["crc_errors"] == r["sync_errors"] == 0
    assert r["units"] == len(r["pts"]) == max(1, -(-n // ts.UNIT))
    assert r["pts"] == [k * ts.UNIT * 90_000 // 8_000 for k in range(r["units"])]
    assert r["random_access"] == r["pts"][:: ts.GOP]


def test_damage_is_counted():
    stream = ts.mux_bytes(os.urandom(50_000))[0]
    lost = stream[: 188 * 40] + stream[188 * 43 :]
    assert ts.demux_bytes(lost)["continuity_errors"] == 1
    twice = stream[: 188 * 40] + stream[188 * 39 : 188 * 40] + stream[188 * 40 :]
    assert ts.demux_bytes(twice)["continuity_errors"] == 0 and ts.demux_bytes(twice)["payload"] == ts.demux_bytes(stream)["payload"]
    bad = bytearray(stream)
    bad[188 * 2] = 0
    assert ts.demux_bytes(bytes(bad))["sync_errors"] == 1
    bad = bytearray(stream)
    bad[10] ^= 1
    assert ts.demux_bytes(bytes(bad))["crc_errors"] == 1
    assert ts.demux_bytes(b"")["packets"] == 0 and ts.demux_bytes(b"\x47" * 100)["sync_errors"] == 1


def test_crc_of_the_standard():
    assert ts.crc32_mpeg(b"123456789") == 0x0376E6E7


def packet(pid, counter, payload, begins=False, flags=None, damaged=False):
    """One packet by hand, filled up through its adaptation field."""
    spare = 184 - len(payload)
    head = bytes([0x47, 0x80 * damaged | 0x40 * begins | pid >> 8, pid & 255])
    if flags is None and not spare:
        return head + bytes([0x10 | counter & 15]) + payload
    field = bytes([spare - 1]) + (bytes([flags or 0]) + b"\xff" * (spare - 2) if spare > 1 else b"")
    return head + bytes([(0x30 if payload else 0x20) | counter & 15]) + field + payload


def section(table, number, body):
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, len(body) + 9 & 255]) + number.to_bytes(2, "big") + b"\xc1\0\0" + body
    return head + ts.crc32_mpeg(head).to_bytes(4, "big")


def carried(pid, data, size=184):
    """Section data in packets of up to `size` bytes of payload."""
    data = b"\0" + data
    return [packet(pid, k, data[i : i + size].ljust(184, b"\xff") if size == 184 else data[i : i + size], begins=i == 0) for k, i in enumerate(range(0, len(data), size))]


def test_streams_of_others():
    """Two programs, a map over three packets, headers cut after five bytes, a marked jump, a damaged packet, a bare stream."""
    pat = section(0, 7, b"\0\0\xe0\x10" + b"\0\x05\xe1\x00" + b"\0\x09\xe2\x00")
    stream = lambda kind, pid, extra=b"": bytes([kind, 0xE0 | pid >> 8, pid & 255, 0xF0 | len(extra) >> 8, len(extra) & 255]) + extra
    info = bytes(range(250)) + bytes(range(250))
    first = section(2, 5, (0xE101).to_bytes(2, "big") + bytes([0xF0 | len(info) >> 8, len(info) & 255]) + info + stream(0x1B, 0x101, b"abcdef") + stream(0x0F, 0x102))
    second = section(2, 9, (0xE201).to_bytes(2, "big") + b"\xf0\0" + stream(0x06, 0x201))
    text = [os.urandom(n) for n in (300, 5, 700)]
    units = [b"\0\0\x01\xe0\0\0\x80\x80\x05" + ts._stamp(90_000 * (k + 1) + (1 << 32)) + t for k, t in enumerate(text)]
    video, count = [], 14
    for k, u in enumerate(units):
        for i, part in enumerate([u[:5], *[u[j : j + 184] for j in range(5, len(u), 184)]]):
            if k == 2 and i == 0:
                count += 5
            video.append(packet(0x101, count, part, begins=i == 0, flags=(0x40 if k != 1 else 0) | (0x80 if k == 2 else 0) if i == 0 else None))
            count += 1
    bare = packet(0x102, 0, b"\0\0\x01\xbe\0\x03xyz", begins=True)
    private = packet(0x201, 3, b"\0\0\x01\xbd\0\x06\x80\0\0abc", begins=True)
    noise = packet(0x101, 9, os.urandom(184), damaged=True)
    maps = carried(0x100, first)
    assert len(maps) >= 3
    packets = [*carried(0, pat), packet(0x1FFF, 0, b"\xff" * 184), maps[0], video[0], maps[1], noise, *video[1:], *maps[2:], bare, *carried(0x200, second, 20), private]
    r = ts.demux_bytes(b"".join(packets))
    assert (r["crc_errors"], r["sync_errors"], r["continuity_errors"], r["damaged_packets"]) == (0, 0, 0, 1)
    assert (r["program"], r["es_pid"], r["stream_type"], r["units"]) == (5, 0x101, 0x1B, 3)
    assert r["payload"] == b"".join(text)
    assert r["pts"] == [90_000 * k + (1 << 32) for k in (1, 2, 3)] and r["random_access"] == [r["pts"][0], r["pts"][2]]
    assert r["random_offset"] == [188 * i for i, p in enumerate(packets) if p in (video[0], next(v for v in video if v[5] & 0x80 and v[3] & 0x20 and v[4]))]
    assert [(s["program"], s["pid"], s["stream_type"], s["payload"]) for s in r["streams"][1:]] == [(5, 0x102, 0x0F, b"xyz"), (9, 0x201, 0x06, b"abc")]
    lost = ts.demux_bytes(b"".join(p for i, p in enumerate(packets) if p is not video[1]))
    assert lost["continuity_errors"] == 1 and len(lost["payload"]) < len(r["payload"])


def test_digests(spark, odd_docs, no_docs):
    rows = ts.digests(ts.store_payloads(odd_docs)).collect()
    assert len(rows) == odd_docs.count()
    texts = {}
    for r in odd_docs.collect():
        raw = (r.text or "").encode()
        texts.setdefault(r.doc_id, set()).add((len(raw), raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")))
    for r in rows:
        match = [p for n, p in texts[r.doc_id] if n == r.n_bytes and hashlib.sha256(p).hexdigest() == r.payload_sha256]
        assert match and r.payload_bytes == len(match[0]) and r.tail_crc32 == zlib.crc32(match[0][-64:]) and r.media_bytes % 188 == 0
    assert ts.digests(ts.store_payloads(no_docs)).count() == 0
    assert ts.demux(ts.mux(odd_docs, payload_col="text")).count() == len(rows)


def test_very_long_text(spark):
    text = "é" * (3 << 20)
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    got = {r.doc_id: r for r in ts.digests(ts.store_payloads(df)).collect()}
    assert got[1].payload_sha256 == hashlib.sha256(text.encode()).hexdigest() and got[1].n_bytes == 6 << 20
    assert len(got[1].pts) == 6 << 10 and len(got[1].random_access) == len(got[1].random_offset) == (6 << 10) // ts.GOP
    streams = ts.demux(ts.store_payloads(df)).where("doc_id = 2").first().streams
    assert len(streams) == 1 and streams[0].payload.rstrip(b"\0") == b"short"
