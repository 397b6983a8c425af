"""Operator 4: concatenate-and-cut packing into fixed token windows.

Documents are range-partitioned by id and encoded once into a table of ids with each document's
running token total inside its shard. Two passes give global offsets: the first sums the tokens of
each shard, prefix sums over these totals are the shards' bases; the second adds base and running
total. Sequence and offset of a
token are the quotient and remainder of its global offset by the window, so a document becomes one
piece for every window it meets, and a boundary record marks where a piece was cut. Only the last
sequence isn't full.

Null texts are empty, with the end id alone. Equal and null ids keep a row each (null ids first,
then by the text's hash). An empty table gives no pieces. Extra columns are dropped.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, slices, tidy, written
from .token_ids import encoder

CODED = "shard int, local long, doc_id long, doc_tokens long, itemsize int, ids binary"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "cut_before boolean, cut_after boolean, ids binary"
)


def encode_shards(df: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of CODED, written to the shared folder: the documents in id order with their ids."""

    @tidy
    def run(batches):
        shard, before, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer_path)
        k = enc.dtype.itemsize
        for batch in slices(batches, "text"):
            coded = enc.encode(batch.column("text").to_pylist(), end_id)
            m, lengths = len(coded), np.array([len(c) // k for c in coded], np.int64)
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array(np.full(m, shard, np.int32)),
                "local": pa.array(before + np.cumsum(lengths) - lengths),
                "doc_id": batch.column("doc_id"),
                "doc_tokens": pa.array(lengths),
                "itemsize": pa.array(np.full(m, k, np.int32)),
                "ids": pa.array(coded, pa.binary()),
            })
            before += int(lengths.sum())

    rows = id_text(df, id_col, text_col)
    tie = F.xxhash64("text")
    return written(rows.repartitionByRange(rows.doc_id, tie).sortWithinPartitions("doc_id", tie).mapInArrow(run, CODED))


def offsets(coded: DataFrame) -> DataFrame:
    """(shard, base): the tokens in the shards before each, from the shards' totals."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return coded.groupBy("shard").agg(F.sum("doc_tokens").alias("tokens")).select("shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))


def pack(df: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Rows of PIECES: every token of every document in exactly one piece, `ids` null unless with_ids."""
    coded = encode_shards(df, tokenizer_path, end_id, id_col, text_col)
    # one row per shard, so never more than the partitions of the encoding stage: small enough to broadcast
    placed = coded.join(F.broadcast(offsets(coded)), "shard").withColumn("at", F.col("base") + F.col("local"))

    @tidy
    def run(batches):
        for batch in batches:
            cols: dict[str, list] = {n.strip().split(" ")[0]: [] for n in PIECES.split(",")}
            for doc_id, n, k, ids, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "itemsize", "ids", "at")), strict=True):
                values, s = np.frombuffer(ids, f"<u{k}"), 0
                while s < n:
                    m = min(n - s, window - (at + s) % window)
                    piece = values[s : s + m]
                    for c, v in zip(cols.values(), (doc_id, s, m, zlib.crc32(piece.astype("<u4").tobytes()), n, (at + s) // window, (at + s) % window, s > 0, s + m < n, piece.tobytes() if with_ids else None), strict=True):
                        c.append(v)
                    s += m
            types = [pa.int64()] * 7 + [pa.bool_()] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols.values(), types, strict=True)], names=list(cols))

    return placed.select("doc_id", "doc_tokens", "itemsize", "ids", "at").mapInArrow(run, PIECES)
