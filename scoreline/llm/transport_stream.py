"""Operator 1: media columns as MPEG transport streams (ISO/IEC 13818-1).

`mux` stores a binary payload in a transport stream: a program association table, a program map
table and one private elementary stream, cut into access units with a time stamp each; beside the
stream it stores the time stamps, and those and the byte offsets of the random-access points.
`demux` reads streams back, also others' than those of `mux`: it assembles the sections of the program
tables over packets and checks their CRCs, finds the streams of all programs, checks the continuity
counter of each PID (a marked discontinuity is none, an exact repeat of a packet is dropped, a packet
marked as damaged too) and reassembles the elementary packets, wherever their headers are cut. Both
are per-row maps without a shuffle; a row's stream is the largest thing a task holds.

Null and empty payloads give a stream with tables and one empty elementary packet. Repeated rows
give equal streams; there are no ties. Rows keep their id, also a null one; other columns, whatever
their names, are dropped. An empty table gives no rows. A very long payload is one stream of many units.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_texts, shared_dir, slices, tidy

# Fixed values of the standard and of this layout.
PACKET, SYNC, PAT_PID, PMT_PID, ES_PID, NULL_PID = 188, 0x47, 0x0000, 0x0100, 0x0101, 0x1FFF
PROGRAM, PRIVATE_STREAM, STREAM_ID, CLOCK = 1, 0x06, 0xBD, 90_000
# Identifiers of streams whose elementary packets have no optional header.
BARE = {0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF}
#: Bytes of an access unit, samples a second, and access units from one random-access point to the next.
UNIT, RATE, GOP = 1024, 8_000, 4

MEDIA = "doc_id long, n_bytes long, media binary, pts array<long>, random_access array<long>, random_offset array<long>"
STREAMS = "array<struct<program: int, pid: int, stream_type: int, payload: binary, pts: array<long>, random_access: array<long>, random_offset: array<long>>>"
REPORT = (
    "doc_id long, payload binary, program int, es_pid int, stream_type int, packets long, units long, pts array<long>, random_access array<long>, random_offset array<long>, "
    f"continuity_errors long, crc_errors long, sync_errors long, damaged_packets long, streams {STREAMS}"
)


@cache
def _crc_table() -> tuple[int, ...]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return tuple(out)


def crc32_mpeg(data: bytes) -> int:
    table, c = _crc_table(), 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ table[c >> 24 ^ b]
    return c


@cache
def _tables() -> bytes:
    """The packets of the two program tables."""

    def section(pid: int, table_id: int, number: int, body: bytes) -> bytes:
        length = 5 + len(body) + 4
        head = bytes([table_id, 0xB0 | length >> 8, length & 255]) + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
        head += crc32_mpeg(head).to_bytes(4, "big")
        return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + head).ljust(PACKET, b"\xff")

    pat = section(PAT_PID, 0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt_body = (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_STREAM]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"
    return pat + section(PMT_PID, 2, PROGRAM, pmt_body)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, 1 | pts >> 14 & 254, pts >> 7 & 255, 1 | pts << 1 & 254])


def mux_bytes(payload: bytes) -> tuple[bytes, list[int], list[int], list[int]]:
    """The stream, its time stamps, and the stamps and byte offsets of its random-access points."""
    parts, counter, stamps, points, offsets = [_tables()], 0, [], [], []
    written = len(parts[0])
    for k in range(max(1, -(-len(payload) // UNIT))):
        unit = payload[k * UNIT : (k + 1) * UNIT]
        pts = k * UNIT * CLOCK // RATE & (1 << 33) - 1
        stamps.append(pts)
        if k % GOP == 0:
            points.append(pts)
            offsets.append(written)
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + unit
        # the first packet has 8 bytes of adaptation field with the clock, the last is stuffed through one
        n = 1 + max(0, -(-(len(pes) - 176) // 184))
        packets = np.full((n, PACKET), 0xFF, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
        packets[:, 3] = 0x10 | (counter + np.arange(n) & 15)
        counter += n
        start = np.full(n, 4)
        start[0] = 12
        spare = int((PACKET - start).sum()) - len(pes)
        start[-1] += spare
        packets[0, 1] |= 0x40
        packets[0, 3] |= 0x20
        packets[0, 4:12] = np.frombuffer(bytes([7, 0x10 | 0x40 * (k % GOP == 0)]) + (pts << 15 | 0x7E00).to_bytes(6, "big"), np.uint8)
        if spare:
            packets[-1, 3] |= 0x20
            packets[-1, 4] = start[-1] - 5
            if n > 1 and spare > 1:
                packets[-1, 5] = 0
        packets[np.arange(PACKET) >= start[:, None]] = np.frombuffer(pes, np.uint8)
        parts.append(packets.tobytes())
        written += len(parts[-1])
    return b"".join(parts), stamps, points, offsets


class _Packets:
    """A stream's packets with their header fields; those without sync byte, damaged or empty ones are left out."""

    def __init__(self, stream: bytes):
        packets = np.frombuffer(stream, np.uint8)[: len(stream) // PACKET * PACKET].reshape(-1, PACKET)
        synced = packets[:, 0] == SYNC
        self.sync_errors = int((~synced).sum()) + (len(stream) % PACKET > 0)
        self.number = int(synced.sum())
        good = synced & (packets[:, 1] & 0x80 == 0)
        self.damaged = self.number - int(good.sum())
        self.place = np.flatnonzero(good)
        self.bytes = packets = packets[self.place]
        self.pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
        self.begins = packets[:, 1] & 0x40 > 0
        self.field = packets[:, 3] >> 4 & 3
        adapted = (self.field & 2 > 0) & (packets[:, 4] > 0)
        self.marked, self.random = adapted & (packets[:, 5] & 0x80 > 0), adapted & (packets[:, 5] & 0x40 > 0)
        start = np.where(self.field & 2, 5 + packets[:, 4].astype(np.int32), 4)
        start[self.field & 1 == 0] = PACKET
        self.start = np.minimum(start, PACKET)

    def of(self, pid: int) -> tuple[np.ndarray, int]:
        """Positions of a PID's packets without exact repeats, and errors of its continuity counter."""
        at = np.flatnonzero(self.pid == pid)
        if len(at) < 2:
            return at, 0
        counter, filled = self.bytes[at, 3] & 15, (self.field[at] & 1).astype(np.int64)
        # a counter moves with each packet that has payload; one exact repeat is a duplicate, not an error
        step = counter[1:].astype(np.int64) - counter[:-1] & 15
        repeat = (step == 0) & (filled[1:] == 1)
        repeat[repeat] = (self.bytes[at[1:][repeat]] == self.bytes[at[:-1][repeat]]).all(axis=1)
        wrong = (step != filled[1:]) & ~repeat & ~self.marked[at[1:]]
        return at[np.concatenate(([True], ~repeat))], int(wrong.sum())

    def sections(self, at: np.ndarray) -> Iterator[tuple[bytes, bool]]:
        """The sections that a PID's packets carry, over packets and several in one, and whether their CRC holds."""
        data = None
        for i in at.tolist():
            part = self.bytes[i, self.start[i] :].tobytes()
            if self.begins[i] and part:
                if data is not None:
                    data += part[1 : 1 + part[0]]
                    yield from _cut(data)
                data = part[1 + part[0] :]
            elif data is not None:
                data += part
        if data is not None:
            yield from _cut(data)


def _cut(data: bytes) -> Iterator[tuple[bytes, bool]]:
    while len(data) >= 3 and data[0] != 0xFF:
        size = 3 + ((data[1] & 15) << 8 | data[2])
        yield data[:size], len(data) >= size > 8 and crc32_mpeg(data[:size]) == 0
        data = data[size:]


def _stream(packets: _Packets, at: np.ndarray) -> dict:
    """A stream's payload, time stamps and random-access points from its packets, as far as they begin with a unit."""
    begins = np.flatnonzero(packets.begins[at] & (packets.start[at] < PACKET))
    out: dict = {"payload": b"", "units": len(begins), "pts": [], "random_access": [], "random_offset": []}
    if not len(begins):
        return out
    at = at[begins[0] :]
    start = packets.start[at]
    data = packets.bytes[at][np.arange(PACKET) >= start[:, None]].tobytes()
    edge = np.concatenate((np.cumsum(PACKET - start) - (PACKET - start), [len(data)]))
    heads = begins - begins[0]
    parts = []
    for head, s, e in zip(heads.tolist(), edge[heads].tolist(), [*edge[heads[1:]].tolist(), len(data)], strict=True):
        if data[s : s + 3] != b"\x00\x00\x01" or e - s < 6:
            continue
        if size := data[s + 4] << 8 | data[s + 5]:
            e = min(e, s + 6 + size)
        if data[s + 3] in BARE or e - s < 9:
            parts.append(data[s + 6 : e])
            continue
        pts = None
        if data[s + 7] & 0x80 and e - s >= 14:
            pts = (data[s + 9] >> 1 & 7) << 30 | data[s + 10] << 22 | (data[s + 11] >> 1) << 15 | data[s + 12] << 7 | data[s + 13] >> 1
            out["pts"].append(pts)
        if packets.random[at[head]]:
            out["random_access"].append(pts)
            out["random_offset"].append(int(packets.place[at[head]]) * PACKET)
        parts.append(data[s + 9 + data[s + 8] : e])
    out["payload"] = b"".join(parts)
    return out


def demux_bytes(stream: bytes) -> dict:
    """What a transport stream holds; errors are counted, and lost packets leave a gap in the payload.

    streams has every elementary stream of every program; the fields beside it are the first one's.
    """
    packets = _Packets(stream)
    out = {"program": None, "es_pid": None, "stream_type": None, "packets": packets.number, "continuity_errors": 0, "crc_errors": 0, "sync_errors": packets.sync_errors, "damaged_packets": packets.damaged, "streams": []}

    def sections(pid: int, table: int) -> Iterator[bytes]:
        at, wrong = packets.of(pid)
        out["continuity_errors"] += wrong
        for data, good in packets.sections(at):
            out["crc_errors"] += not good
            if good and data[0] == table:
                yield data

    programs: dict[int, int] = {}
    for data in sections(PAT_PID, 0):
        for k in range(8, len(data) - 7, 4):
            if number := data[k] << 8 | data[k + 1]:
                programs.setdefault(number, (data[k + 2] & 31) << 8 | data[k + 3])
    found: dict[int, tuple[int, int]] = {}
    for pid in dict.fromkeys(programs.values()):
        for data in sections(pid, 2):
            k = 12 + ((data[10] & 15) << 8 | data[11])
            while k + 9 <= len(data):
                found.setdefault((data[k + 1] & 31) << 8 | data[k + 2], (data[3] << 8 | data[4], data[k]))
                k += 5 + ((data[k + 3] & 15) << 8 | data[k + 4])
    first = None
    for pid, (program, kind) in found.items():
        at, wrong = packets.of(pid)
        out["continuity_errors"] += wrong
        one = _stream(packets, at)
        first = first or one
        if out["es_pid"] is None:
            out |= {"program": program, "es_pid": pid, "stream_type": kind}
        out["streams"].append({"program": program, "pid": pid, "stream_type": kind} | {n: v for n, v in one.items() if n != "units"})
    return out | (first or {"payload": b"", "units": 0, "pts": [], "random_access": [], "random_offset": []})


def mux(df: DataFrame, id_col: str = "doc_id", payload_col: str = "payload", size_col: str | None = None) -> DataFrame:
    """Rows of MEDIA: the payload of each row (null: empty) as a transport stream.

    n_bytes is size_col, or else the payload's length.
    """

    @tidy
    def run(batches):
        for batch in slices(batches, "payload"):
            buf, starts, ends = raw_texts(batch.column("payload"))
            made = [mux_bytes(buf[s:e].tobytes()) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            types = [pa.binary(), *[pa.list_(pa.int64())] * 3]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array([m[k] for m in made], t) for k, t in enumerate(types))], names=["doc_id", "n_bytes", "media", "pts", "random_access", "random_offset"])

    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    size = F.col(size_col).cast("long") if size_col else F.octet_length(payload).cast("long")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("n_bytes"), payload.alias("payload")).mapInArrow(run, MEDIA)


def demux(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Rows of REPORT: payload, time stamps (90 kHz), random-access points and error counts of each stream.

    A null, empty or damaged stream gives what can be read of it; its errors are counted.
    """
    longs, number = pa.list_(pa.int64()), pa.int64()
    stream = pa.struct([("program", pa.int32()), ("pid", pa.int32()), ("stream_type", pa.int32()), ("payload", pa.binary()), ("pts", longs), ("random_access", longs), ("random_offset", longs)])
    fields = {"payload": pa.binary(), "program": pa.int32(), "es_pid": pa.int32(), "stream_type": pa.int32(), "packets": number, "units": number, "pts": longs, "random_access": longs, "random_offset": longs,
              "continuity_errors": number, "crc_errors": number, "sync_errors": number, "damaged_packets": number, "streams": pa.list_(stream)}

    @tidy
    def run(batches):
        for batch in slices(batches, "media"):
            buf, starts, ends = raw_texts(batch.column("media"))
            rows = [demux_bytes(buf[s:e].tobytes()) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[n] for r in rows], t) for n, t in fields.items())], names=["doc_id", *fields])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).cast("binary").alias("media")).mapInArrow(run, REPORT)


def store_payloads(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 64) -> DataFrame:
    """Pads each text (null: empty) with bytes 0 to a positive multiple of block and stores it as a stream.

    The streams are written to the shared folder; the rows of MEDIA are those read back, with the
    text's own length in n_bytes.
    """
    raw = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    n = F.octet_length(raw)
    pad = F.substring(F.lit(bytes(block)), F.lit(1), F.when(n == 0, block).otherwise(F.pmod(-n, F.lit(block))))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), n.alias("n_bytes"), F.concat(raw, pad).alias("payload"))
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    # streams repeat headers and text, so they pack well; zstd keeps the stored form small
    mux(rows, size_col="n_bytes").write.option("compression", "zstd").parquet(path)
    return spark.read.schema(MEDIA).parquet(path)


def digests(media: DataFrame) -> DataFrame:
    """Per stored stream: size and digests of the payload read back and of the stream, time stamps, random-access points and a feature line."""
    longs = "pts array<long>, random_access array<long>, random_offset array<long>"
    schema = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, {longs}"

    @tidy
    def run(batches):
        for batch in slices(batches, "media"):
            buf, starts, ends = raw_texts(batch.column("media"))
            cols: list[list] = [[] for _ in range(9)]
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                stream = buf[s:e].tobytes()
                r = demux_bytes(stream)
                p = r["payload"]
                feature = (
                    f"program={r['program']} pid={r['es_pid']} type={r['stream_type']} packets={r['packets']} units={r['units']} "
                    f"random={len(r['random_access'])} first={r['pts'][0] if r['pts'] else -1} last={r['pts'][-1] if r['pts'] else -1} "
                    f"continuity={r['continuity_errors']} crc={r['crc_errors']} sync={r['sync_errors']}"
                )
                for c, v in zip(cols, (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(stream), hashlib.sha256(stream).hexdigest(), feature, r["pts"], r["random_access"], r["random_offset"]), strict=True):
                    c.append(v)
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.list_(pa.int64())] * 3]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pts", "random_access", "random_offset"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_bytes", *names])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
