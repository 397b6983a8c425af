"""Tables of a fixed size that all tasks fill and add up: count sketches and bit filters.

Their size is a constant, whatever the input, so the driver may hold and broadcast them. A fuller
table only tells fewer rows apart; it is never the last word, exact steps follow it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, tidy

#: Pieces of a table, and groups of tasks whose tables are added up first.
SEGMENTS, GROUPS = 64, 64


def add_up(df: DataFrame, cells: Callable[[pa.RecordBatch], Iterable[np.ndarray]], size: int, bits: bool = False) -> np.ndarray:
    """Counts by cell (as int32; with bits, whether there are any, as packed bits) over all rows; cells(batch) gives arrays of cell numbers.

    Each task fills one table (counts stop at 65,535 a task), packs it and sends its segments; they
    are added up by segment in two steps: first those of each of `GROUPS` groups of tasks, then the groups'.
    """

    @tidy
    def fill(batches):
        import zstandard

        own = np.zeros(size >> 3, np.uint8) if bits else np.zeros(size, np.uint32)
        for batch in batches:
            for at in cells(batch):
                if bits:
                    np.bitwise_or.at(own, at >> 3, (128 >> (at & 7)).astype(np.uint8))
                else:
                    np.add.at(own, at, 1)
        own = own if bits else np.minimum(own, 65_535).astype("<u2")
        pack = zstandard.ZstdCompressor(level=1)
        parts = own.reshape(SEGMENTS, -1)
        yield pa.RecordBatch.from_pydict({"segment": pa.array(np.arange(SEGMENTS), pa.int64()), "table": pa.array([pack.compress(p.tobytes()) for p in parts], pa.binary())})

    def merger(narrow):
        return tidy(lambda batches: merge(batches, narrow))

    def merge(batches, narrow):
        import zstandard

        unpack, sums = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for s, t in zip(batch.column("segment").to_pylist(), batch.column("table").to_pylist(), strict=True):
                part = np.frombuffer(unpack.decompress(t), np.uint8 if bits else "<u2" if narrow else "<i4")
                if s not in sums:
                    sums[s] = part.copy() if bits else part.astype(np.int32)
                elif bits:
                    sums[s] |= part
                else:
                    sums[s] += part
        pack = zstandard.ZstdCompressor(level=1)
        for s, t in sums.items():
            yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int64()), "table": pa.array([pack.compress(t.tobytes())], pa.binary())})

    schema = "segment long, table binary"
    tables = df.mapInArrow(fill, schema).withColumn("group", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    tables = tables.repartition("segment", "group").select("segment", "table").mapInArrow(merger(True), schema)
    rows = tables.repartition("segment").mapInArrow(merger(False), schema).collect()  # SEGMENTS rows of a fixed size
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    out = np.zeros(size // 8 if bits else size, np.uint8 if bits else np.int32)
    width = len(out) // SEGMENTS
    for r in rows:
        out[r["segment"] * width : (r["segment"] + 1) * width] = np.frombuffer(unpack.decompress(r["table"]), out.dtype)
    return out


def twice(df: DataFrame, cells: Callable[[pa.RecordBatch], Iterable[np.ndarray]], size: int) -> np.ndarray:
    """Packed bits: which cells are met at least twice over all rows.

    Tasks fill two tables of bits, cells met and cells met again, that are brought together by segment like those of `add_up`.
    """

    def put(table: np.ndarray, at: np.ndarray) -> None:
        np.bitwise_or.at(table, at >> 3, (128 >> (at & 7)).astype(np.uint8))

    @tidy
    def fill(batches):
        import zstandard

        once, again = np.zeros(size >> 3, np.uint8), np.zeros(size >> 3, np.uint8)
        for batch in batches:
            for met in cells(batch):
                at, count = np.unique(met, return_counts=True)
                known = ((once[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)
                put(again, at[known | (count > 1)])
                put(once, at)
        pack = zstandard.ZstdCompressor(level=1)
        for s, (a, b) in enumerate(zip(once.reshape(SEGMENTS, -1), again.reshape(SEGMENTS, -1), strict=True)):
            yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int64()), "once": pa.array([pack.compress(a.tobytes())], pa.binary()), "again": pa.array([pack.compress(b.tobytes())], pa.binary())})

    @tidy
    def merge(batches):
        import zstandard

        unpack, found = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for s, *packed in zip(*(batch.column(c).to_pylist() for c in ("segment", "once", "again")), strict=True):
                one, two = (np.frombuffer(unpack.decompress(t), np.uint8) for t in packed)
                if s in found:
                    once, again = found[s]
                    again |= two | (once & one)
                    once |= one
                else:
                    found[s] = one.copy(), two.copy()
        pack = zstandard.ZstdCompressor(level=1)
        for s, (a, b) in found.items():
            yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int64()), "once": pa.array([pack.compress(a.tobytes())], pa.binary()), "again": pa.array([pack.compress(b.tobytes())], pa.binary())})

    schema = "segment long, once binary, again binary"
    tables = df.mapInArrow(fill, schema).withColumn("group", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    tables = tables.repartition("segment", "group").select("segment", "once", "again").mapInArrow(merge, schema)
    rows = tables.repartition("segment").mapInArrow(merge, schema).select("segment", "again").collect()  # SEGMENTS rows of a fixed size
    import zstandard

    unpack, out, width = zstandard.ZstdDecompressor(), np.zeros(size >> 3, np.uint8), (size >> 3) // SEGMENTS
    for r in rows:
        out[r["segment"] * width : (r["segment"] + 1) * width] = np.frombuffer(unpack.decompress(r["again"]), np.uint8)
    return out


def probes(keys: np.ndarray, size: int, k: int = 3) -> np.ndarray:
    """k cell numbers for each unsigned 64-bit key, one row for each; size is a power of two."""
    shift = np.uint64(64 - (size.bit_length() - 1))
    return np.stack([mix(keys + np.uint64(0x632BE59BD9B4E019 * (i + 1) % (1 << 64))) >> shift for i in range(k)]).astype(np.int64)


class BitFilter:
    """A Bloom filter over unsigned 64-bit keys, held as packed bits."""

    def __init__(self, packed: np.ndarray, k: int = 3):
        self.size, self.k, self.packed = 8 * len(packed), k, packed

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        at = probes(keys, self.size, self.k)
        return ((self.packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0) if len(keys) else np.zeros(0, bool)


def bit_filter(df: DataFrame, keys: Callable[[pa.RecordBatch], Iterable[np.ndarray]], size: int, k: int = 3) -> BitFilter:
    """The filter of the keys in the arrays that keys(batch) gives, over all rows of df."""
    return BitFilter(add_up(df, lambda b: (probes(x, size, k).ravel() for x in keys(b)), size, bits=True), k)


#: Bits for each key of a filter that is sized by its keys, and the fewest and most bits of one.
BITS_A_KEY, LEAST_BITS, MOST_BITS = 8, 1 << 20, 1 << 30


def bits_for(keys: int) -> int:
    """Bits of a filter over so many keys: a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (max(1, BITS_A_KEY * keys) - 1).bit_length()))


class Among:
    """Whether long values may be among the keys of a written table: `test` in a task, `maybe` as a boolean column.

    It holds for all keys and a few others, so rows without it needn't be moved to be joined with them.
    """

    def __init__(self, keys: DataFrame, column: str):
        bits = bit_filter(keys.select(column), lambda b: [_hashed(b.column(column))], bits_for(keys.count()))
        self.shared = keys.sparkSession.sparkContext.broadcast(bits)  # at most MOST_BITS bits

    def __getstate__(self):
        return {"shared": self.shared}

    def test(self, values: pa.Array) -> pa.Array:
        return pa.array(self.shared.value.may_hold(_hashed(values)))

    def maybe(self, values):
        @F.arrow_udf("boolean")
        def test(values: pa.Array) -> pa.Array:
            return self.test(values)

        return test(values)

    def destroy(self) -> None:
        self.shared.destroy()


def _hashed(values: pa.Array) -> np.ndarray:
    return mix(np.ascontiguousarray(values.to_numpy(zero_copy_only=False).astype(np.int64)).view(np.uint64))
