"""Operator 8: flat files of unsigned token ids with 64-bit document offsets.

`write_ids` range-partitions the documents by id and each task encodes its own texts and writes
one shard: `<shard>.bin` holds the ids of all its documents back to back (little-endian, 16 bits
where the vocabulary allows, else 32) and `<shard>.idx` the document ids, then the n + 1 offsets
(little-endian 64-bit). A manifest row per shard gives its totals; the prefix sums over these
totals are the shards' bases in the whole sequence. `read_ids` maps the files into memory (or reads
them, where the store isn't a local file system) and returns each document's ids with its global
start. A shard is written under a name of the attempt's own and renamed when whole, so a task that
runs again after a lost executor leaves the same files.

Null texts are empty, with the end id alone. Documents with equal or null ids keep a row each (null
ids first, then by the text's hash). An empty table gives no shards. Extra columns are dropped.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_text, shared_dir, slices, tidy
from .token_ids import encoder

MANIFEST = "shard int, name string, itemsize int, docs long, tokens long"
ROWS = "doc_id long, start long, n_tokens long, ids binary"


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def write_ids(df: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Writes the shards below folder (default: a new shared one) and returns it with the manifest."""
    spark = df.sparkSession
    folder = folder or shared_dir(spark)

    @tidy
    def run(batches):
        shard, size, n, ids = TaskContext.get().partitionId(), [0], [], []
        enc, name = encoder(tokenizer_path), f"{shard:06d}"
        store, root = _file_system(folder)
        part, out = f"{root}/{name}.{uuid.uuid4().hex}", None
        for batch in slices(batches, "text"):
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{part}.bin")
            coded = enc.encode(batch.column("text").to_pylist(), end_id)
            out.write(b"".join(coded))
            n.extend(len(c) // enc.dtype.itemsize for c in coded)
            ids.extend(batch.column("doc_id").to_pylist())
        if out is None:
            return
        out.close()
        known = np.array([i is not None for i in ids], "<u8")
        with store.open_output_stream(f"{part}.idx") as idx:
            idx.write(np.array([0 if i is None else i for i in ids], "<i8").tobytes())
            idx.write(np.concatenate((size, np.cumsum(np.array(n, "<i8")))).astype("<i8").tobytes())
            idx.write(known.tobytes())
        for kind in ("bin", "idx"):
            store.move(f"{part}.{kind}", f"{root}/{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "name": [name], "itemsize": pa.array([enc.dtype.itemsize], pa.int32()), "docs": [len(ids)], "tokens": [int(np.sum(n))]})

    rows = id_text(df, id_col, text_col)
    tie = F.xxhash64("text")
    shards = rows.repartitionByRange(rows.doc_id, tie).sortWithinPartitions("doc_id", tie).mapInArrow(run, MANIFEST)
    shards.write.parquet(f"{folder}/manifest")
    return folder, spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def bases(manifest: DataFrame) -> DataFrame:
    """The manifest with each shard's base: the ids in the shards before it. One row per shard."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def open_shard(folder: str, name: str, itemsize: int, docs: int):
    """ids, document ids, their validity and offsets of one shard; memory-mapped on a file system."""
    store, root = _file_system(folder)
    dtype = np.dtype(f"<u{itemsize}")
    if store.type_name == "local":
        ids = np.memmap(f"{root}/{name}.bin", dtype, "r")
        idx = np.memmap(f"{root}/{name}.idx", "<i8", "r")
    else:
        ids = np.frombuffer(store.open_input_file(f"{root}/{name}.bin").read_buffer(), dtype)
        idx = np.frombuffer(store.open_input_file(f"{root}/{name}.idx").read_buffer(), "<i8")
    return ids, idx[:docs], idx[2 * docs + 1 :] > 0, idx[docs : 2 * docs + 1]


def read_ids(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Rows of ROWS from the files, plus ids_crc32 over 32-bit little-endian ids; ids null unless with_ids."""
    manifest = bases(spark.read.schema(MANIFEST).parquet(f"{folder}/manifest"))

    @tidy
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, doc_ids, known, offsets = open_shard(folder, row["name"], row["itemsize"], row["docs"])
                for s in range(0, row["docs"], 512):
                    cut = offsets[s : s + 513].tolist()
                    block = [np.asarray(ids[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(np.asarray(doc_ids[s : s + 512]), pa.int64(), mask=~known[s : s + 512]),
                        "start": pa.array(np.asarray(offsets[s : s + len(block)]) + row["base"], pa.int64()),
                        "n_tokens": pa.array([len(x) for x in block], pa.int64()),
                        "ids": pa.array([x.tobytes() for x in block] if with_ids else [None] * len(block), pa.binary()),
                        "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in block], pa.int64()),
                    })

    # a few rows that stand for large files: one task for each
    spread = manifest.repartition(max(1, manifest.count()), "shard")
    return spread.mapInArrow(run, ROWS + ", ids_crc32 long")
