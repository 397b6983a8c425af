"""Shared pieces of the corpus operators: shared storage, text slicing and vectorised word hashing."""

from __future__ import annotations

import ctypes
import functools
import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python helper looks at together; bounds its memory whatever a batch holds.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors share.

    Where a local session has no such setting (tests), a temporary folder is set; elsewhere that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that `written` gave and nothing reads any more; each must be a bare one."""
    for df in tables:
        spark = df.sparkSession
        base = spark.conf.get("spark.checkpoint.dir").rstrip("/").removeprefix("file://")
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if base in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@functools.cache
def _trim() -> Callable[[], object]:
    try:
        trim = ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda: None
    return lambda: trim(0)


def tidy(run: Callable) -> Callable:
    """A map over batches that hands a worker's unused memory back when it ends."""

    @functools.wraps(run)
    def inner(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        _trim()()

    return inner


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, id_col: str, text_col: str, id_as: str = "doc_id", text_as: str = "text") -> DataFrame:
    """Just the id (as long) and the text, so that further columns of any name can't clash."""
    return df.select(F.col(id_col).cast("long").alias(id_as), F.col(text_col).cast("string").alias(text_as))


def raw_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A string column's UTF-8 bytes in one array, with starts and ends by row; a null is empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    starts, ends = offsets[:-1].copy(), offsets[1:].copy()
    if column.null_count:
        gone = np.asarray(column.is_null())
        ends[gone] = starts[gone]
    return buf, starts, ends


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about `limit` bytes of text each (a longer text stands alone)."""
    for batch in batches:
        _, starts, ends = raw_texts(batch.column(text))
        sizes = ends - starts
        begin = total = 0
        for i, n in enumerate(sizes.tolist()):
            if i > begin and total + n > limit:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        if batch.num_rows > begin:
            yield batch.slice(begin)


def text_digest(text, key: bytes):
    """(a 64-bit key of the text, 128 bits of a digest of it) as columns; both can't be foreseen without the key."""
    sha = F.sha2(F.concat(F.lit(key.hex()), text), 256)
    return F.xxhash64(sha), F.unhex(F.substring(sha, 1, 32))


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


# ------------------------------------------------------------------ words and their hashes
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_STEP, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_BELOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LOW, _HIGH, _HALF = np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000), np.uint64(32)
#: Bytes from which a word's hash is a keyed digest of its own.
LONG_WORD = 256


def secret() -> bytes:
    """A key for the hashes of one run, drawn on the driver and sent with the tasks."""
    return os.urandom(16)


@functools.lru_cache(4)
def _multipliers(key: bytes, salt: int) -> np.ndarray:
    """Two rows of unsigned 64-bit multipliers: of a word's length and of each of its 32-bit parts."""
    count = 2 * (LONG_WORD // 4 + 1)
    raw = b"".join(hashlib.blake2b(i.to_bytes(8, "little"), key=key, salt=salt.to_bytes(8, "little")).digest() for i in range(-(-count // 8)))
    return np.frombuffer(raw, "<u8", count).reshape(2, -1)


def word_hashes(buf: np.ndarray, begin: np.ndarray, end: np.ndarray, key: bytes, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of buf[begin:end] for every pair; buf has 8 bytes to spare at its end.

    Each half is a multilinear hash: the upper 32 bits of the sum, modulo 2**64, of the length and the
    32-bit parts of the word, each by a secret multiplier of its own. Whatever two words are, they share a
    half with a chance of 2**-32 over the keys, so who doesn't know the key can't build words that collide. A
    word of over LONG_WORD bytes gets a keyed BLAKE2b digest. Other salts give independent hashes.
    """
    by = _multipliers(key, salt)
    size = end - begin
    one, two = size.astype(np.uint64) * by[0, 0], size.astype(np.uint64) * by[1, 0]
    if not len(size):
        return one
    loads = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    x = loads[begin] & _BELOW[np.minimum(size, 8)]
    low, high = x & _LOW, x >> _HALF
    one += low * by[0, 1] + high * by[0, 2]
    two += low * by[1, 1] + high * by[1, 2]
    at, k = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 1
    while len(at):
        x = loads[begin[at] + 8 * k] & _BELOW[np.minimum(size[at] - 8 * k, 8)]
        low, high = x & _LOW, x >> _HALF
        one[at] += low * by[0, 2 * k + 1] + high * by[0, 2 * k + 2]
        two[at] += low * by[1, 2 * k + 1] + high * by[1, 2 * k + 2]
        k += 1
        at = at[size[at] > 8 * k]
    out = mix((one & _HIGH) | (two >> _HALF))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[begin[i] : end[i]].tobytes(), digest_size=8, key=key, salt=salt.to_bytes(8, "little")).digest(), "little")
    return out


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _STEP + right * _TURN)


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of many texts, with a 64-bit hash each where a key is given.

    first[i]:first[i + 1] are the words of text i; begin and end are byte positions in buf.
    """

    def __init__(self, column: pa.Array, lower: bool = False, key: bytes | None = None):
        raw, starts, ends = raw_texts(column)
        sizes = ends - starts
        # one separator after each text keeps words of neighbours apart
        at = np.concatenate(([0], np.cumsum(sizes + 1)))
        whole = np.full(int(at[-1]) + 8, 0x0A, np.uint8)
        buf = whole[:-8]
        if len(starts) and np.array_equal(starts[1:], ends[:-1]):
            keep = np.ones(len(buf), bool)
            keep[at[1:] - 1] = False
            buf[keep] = raw[starts[0] : ends[-1]]
        else:
            for s, e, t in zip(starts.tolist(), ends.tolist(), at.tolist(), strict=False):
                buf[t : t + e - s] = raw[s:e]
        self.buf = buf
        if lower:
            whole = _LOWER[whole]
            buf = whole[:-8]
        word = ~_SEP[buf]
        edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
        self.begin, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.begin, at)
        self.counts = np.diff(self.first)
        self._whole, self._key = whole, key
        self.hash = None if key is None else word_hashes(whole, self.begin, self.end, key)

    def windows(self, size: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the window of `size` words that starts at each word, and whether it lies in one text.

        Halves are hashed together, pair by pair, each time through the finaliser. Another salt
        gives an independent hash, which starts from other hashes of the words.
        """
        n = len(self.begin)
        good, out = np.zeros(n, bool), np.zeros(n, np.uint64)
        if n >= size:
            # part: hashes of `width` words; done: of the first `taken` words of the window
            part = word_hashes(self._whole, self.begin, self.end, self._key, salt) if salt else self.hash
            done, taken, width = None, 0, 1
            while True:
                if size & width:
                    done = part if done is None else _joined(done[: len(part) - taken], part[taken : taken + len(done)])
                    taken += width
                if taken == size:
                    break
                part = _joined(part[:-width], part[width:])
                width *= 2
            start = np.arange(n - size + 1)
            out[: n - size + 1] = mix(done[: n - size + 1] + np.uint64(size))
            last = np.repeat(self.first[1:], self.counts)
            good[: n - size + 1] = start + size <= last[: n - size + 1]
        return out, good


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
