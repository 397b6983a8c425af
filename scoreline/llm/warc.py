"""Operator 5: WARC archives in seekable Zstandard bundles.

Equal payloads are found by digest: in each group of at least `min_bytes` the smallest page id is
the response, the others revisit it. Records are written in page-id order, one shard per task:
`<shard>.warc.zst` holds groups of records as independent Zstandard frames and ends with the seek
table of the seekable format (a skippable frame); the index maps each record to its frame and its
offset inside the frame's content. `read_records` fetches records back through the seek table and
the index; a revisit's payload is that of the record it refers to.

Null html is an empty payload. Characters of a url that can't be printed are stored as percent-encoded
UTF-8. Repeated rows get a record each; where their page id is the smallest
of its group, all of them are responses. A null page id is stored under the empty identifier and is
never what others refer to. An empty table gives no shards. Extra columns are
dropped.
"""

from __future__ import annotations

import struct
import uuid
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, slices, tidy, written
from .flat_ids import _file_system

#: Content bytes after which a frame is closed: small enough to seek, large enough to pack well.
FRAME_BYTES = 256 << 10
# Fixed values of the seekable format.
SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1

INDEX = "shard string, frame int, offset long, length long, page_id long, record_type string"
RECORDS = "page_id long, record_type string, refers_to long, payload_digest string, url string, payload binary"


def decide(pages: DataFrame, min_bytes: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is null for a response.

    Only digests and ids are grouped, with partial aggregation, so a payload that many pages share
    is no hot group; the texts move once, by their own (page_id, digest).
    """
    payload = F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("html")).withColumn("digest", F.sha2("html", 256))
    narrow = rows.where(F.octet_length("html") >= min_bytes).select("page_id", "digest")
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    later = narrow.join(first, "digest").where("page_id is null or page_id <> refers_to").distinct()
    same = F.col("r.page_id").eqNullSafe(F.col("l.page_id")) & (F.col("r.digest") == F.col("l.digest"))
    return rows.alias("r").join(later.alias("l"), same, "left").select("r.page_id", "r.url", "r.html", "r.digest", "l.refers_to")


def record(page_id: int | None, url: str | None, digest: str, refers_to: int | None, payload: bytes, date: str) -> bytes:
    """One WARC/1.1 record; a revisit holds the headers alone."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}",
        "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + "".join(c if c.isprintable() else quote(c) for c in url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of RECORDS of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    number = lambda v: int(v[10:-1]) if v and v != "<urn:page:>" else None
    block = rest[: int(fields["Content-Length"])]
    kind = fields["WARC-Type"]
    return {
        "page_id": number(fields["WARC-Record-ID"]), "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To")),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "url": fields.get("WARC-Target-URI"),
        "payload": block.partition(b"\r\n\r\n")[2] if kind == "response" else None,
    }


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame: sizes of each frame, packed and not, then the footer."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, FOOTER)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file) -> np.ndarray:
    """(start, packed size, size) of each frame, read from the end of an open seekable file."""
    end = file.size()
    file.seek(end - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != FOOTER or flags:
        raise ValueError("not a seekable Zstandard file without checksums")
    file.seek(end - 9 - 8 * count)
    sizes = np.frombuffer(file.read(8 * count), "<u4").reshape(-1, 2).astype(np.int64)
    return np.column_stack((np.cumsum(sizes[:, 0]) - sizes[:, 0], sizes))


def write_archives(decided: DataFrame, folder: str | None = None, frame_bytes: int = FRAME_BYTES, level: int = 3, date: str = "2024-01-01T00:00:00Z") -> tuple[str, DataFrame]:
    """Writes one bundle per task below folder (default: a new shared one); returns it and the index."""
    spark = decided.sparkSession
    folder = folder or shared_dir(spark)

    @tidy
    def run(batches):
        import zstandard

        name, pack, out = f"{TaskContext.get().partitionId():06d}.warc.zst", zstandard.ZstdCompressor(level=level), None
        store, root = _file_system(folder)
        part = f"{root}/{name}.{uuid.uuid4().hex}"
        frames, held, total, rows = [], [], 0, []

        def close() -> None:
            nonlocal held, total
            packed = pack.compress(b"".join(held))
            out.write(packed)
            frames.append((len(packed), total))
            held, total = [], 0

        for batch in slices(batches, "html"):
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(part)
            for page_id, url, html, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                data = record(page_id, url, digest, refers_to, html, date)
                if held and total + len(data) > frame_bytes:
                    close()
                rows.append((name, len(frames), total, len(data), page_id, "response" if refers_to is None else "revisit"))
                held.append(data)
                total += len(data)
        if out is None:
            return
        close()
        out.write(seek_table(frames))
        out.close()
        store.move(part, f"{root}/{name}")
        for i in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 10_000], strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["shard", "frame", "offset", "length", "page_id", "record_type"])

    decided.select("page_id", "url", "html", "digest", "refers_to").sortWithinPartitions("page_id").mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return folder, spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_records(spark: SparkSession, folder: str, index: DataFrame | None = None) -> DataFrame:
    """Rows of RECORDS for the index's rows (all, or any selection); each frame is unpacked once a task."""
    index = spark.read.schema(INDEX).parquet(f"{folder}/index") if index is None else index

    @tidy
    def run(batches):
        import zstandard

        store, root = _file_system(folder)
        unpack, at, file = zstandard.ZstdDecompressor(), (None, None), None
        for batch in batches:
            found: list[dict] = []
            held = 0
            for row in batch.to_pylist():
                if at[0] != row["shard"]:
                    file = store.open_input_file(f"{root}/{row['shard']}")
                    table = read_seek_table(file)
                if at != (row["shard"], row["frame"]):
                    start, packed, size = table[row["frame"]].tolist()
                    file.seek(start)
                    content = unpack.decompress(file.read(packed), max_output_size=size)
                    at = row["shard"], row["frame"]
                found.append(parse(content[row["offset"] : row["offset"] + row["length"]]))
                held += row["length"]
                if held > 4 << 20:
                    yield _records(found)
                    found, held = [], 0
            yield _records(found)

    # frames of one bundle go to several tasks, each frame to one
    dealt = index.select("shard", "frame", "offset", "length").repartition("shard", "frame").sortWithinPartitions("shard", "frame", "offset")
    return dealt.mapInArrow(run, RECORDS)


def _records(rows: list[dict]) -> pa.RecordBatch:
    types = {"page_id": pa.int64(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_digest": pa.string(), "url": pa.string(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in types.items()], names=list(types))


def resolve(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits take the size of what they refer to.

    Digests of responses are computed anew from the payloads read.
    """
    seen = written(records.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to"))
    answers = seen.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("size")).distinct()
    revisits = seen.where("record_type = 'revisit'").join(answers, ["refers_to", "payload_digest"], "left").select("page_id", F.col("size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return seen.where("record_type = 'response'").unionByName(revisits)
