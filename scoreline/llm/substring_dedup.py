"""Operator 6: removal of repeated passages by fixed-block anchors.

A word goes if a window of `window` words that covers it also starts in a document with a smaller
id. Each such window holds a whole block of window // 2 words that lies at a multiple of that in
the other document:
- the index holds each document's non-overlapping blocks at those multiples;
- every rolling window of block length of every document probes it. A bit filter over the index,
  with 8 bits for each block (counted from the texts' bytes), lets most probes drop before they are sent; the rest
  are counted exactly by hash, and an anchor is a block that different texts hold;
- hits are extended: around each anchor, all windows of full length are hashed, the smallest
  document id of each hash is found by grouped aggregation, and runs of windows that a smaller
  document has make the maximal repeats. No pairs of documents are formed.

The filter's share of false hits is the same at every size up to 2**30 bits (about 13 GB of text at 4 bytes a word);
past that it rises, and results stay whole. Hashes that stand in more than 1 of `HOT_SHARE` rows, so at
most HOT_SHARE of them, are joined by broadcast, all others by shuffle: no task gathers a hot passage.

Equal texts take part once, as the one with the smallest id; the others are whole repeats if they
have `window` words. Everything is judged on the input. Windows are compared by two independent
hashes of 64 bits, each from word hashes of its own under a key drawn for each run, whole texts by 192
bits of a digest under that key.

Null and empty texts have no words. Rows with a null id are kept whole and remove nothing; a
repeated id isn't smaller than itself. Repeated rows keep a row each. An empty table gives no rows.
Extra columns are dropped, or kept as they are with `texts`, whatever their names. Texts of any length
are taken whole; one longer than a slice is hashed alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, batch_of, dropped, mix, secret, signed, slices, text_digest, tidy, written
from .sketches import Among, bit_filter, bits_for

#: Salt of the second hash of a window.
SECOND = 1
#: A hash is hot where it stands in more than 1 of so many rows.
HOT_SHARE = 4096


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.ascontiguousarray(batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64))


def _blocks(words: Words, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the rolling block at each word, whether it is inside its text, and whether it is of the index."""
    rolling, inside = words.windows(block)
    place = np.arange(len(rolling)) - np.repeat(words.first[:-1], words.counts)
    return rolling, inside, inside & (place % block == 0)


def _hot_join(rows: DataFrame, keys: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows joined with the written keys (on, n rows each): the hot keys by broadcast, the others by shuffle."""
    hot = F.col("n") * HOT_SHARE > total  # fewer than HOT_SHARE keys
    few, many = F.broadcast(keys.where(hot).drop("n")), keys.where(~hot).drop("n")
    if keys.where(hot).isEmpty():
        return rows.join(many, on)
    return rows.join(few, on).unionByName(rows.join(few.select(*on), on, "left_anti").join(many, on))


def block_count(rows: DataFrame, block: int) -> int:
    """About how many blocks the index has, from the bytes of all texts; a word is taken to have 4, its separator included."""
    return (rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // (4 * block)  # one row


def probes_sent(rows: DataFrame, block: int, key: bytes) -> DataFrame:
    """(text_key, block_hash, aligned): the rolling blocks that the filter over the index lets through. Written."""

    def indexed(batch):
        for b in slices([batch], "text"):
            rolling, _, aligned = _blocks(Words(b.column("text"), key=key), block)
            yield rolling[aligned]

    bits = bit_filter(rows.select("text"), indexed, bits_for(block_count(rows, block)))
    index = rows.sparkSession.sparkContext.broadcast(bits)  # at most MOST_BITS bits
    schema = pa.schema([("text_key", pa.int64()), ("block_hash", pa.int64()), ("aligned", pa.bool_())])

    @tidy
    def probe(batches):
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"), key=key)
            rolling, inside, aligned = _blocks(words, block)
            at = np.flatnonzero(inside)
            at = at[index.value.may_hold(rolling[at])]
            keys = np.repeat(_numbers(batch, "text_key"), words.counts)[at]
            yield batch_of(schema, text_key=keys, block_hash=signed(rolling[at]), aligned=aligned[at])

    probes = written(rows.select("text_key", "text").mapInArrow(probe, "text_key long, block_hash long, aligned boolean"))
    index.destroy()
    return probes


def _anchors(rows: DataFrame, block: int, key: bytes) -> DataFrame:
    """(text_key, hits): the blocks of each text that also stand in another text, one of them at an index place. Written."""
    probes = probes_sent(rows, block, key)
    shared = probes.groupBy("block_hash").agg(F.min("text_key").alias("low"), F.max("text_key").alias("high"), F.max("aligned").alias("aligned"), F.count("*").alias("n")).where("low <> high and aligned")
    shared = written(shared.select("block_hash", "n"))
    found = _hot_join(probes.select("text_key", "block_hash"), shared, ["block_hash"], probes.count()).distinct()
    hits = written(found.groupBy("text_key").agg(F.collect_list("block_hash").alias("hits")))
    dropped(probes, shared)
    return hits


def _candidates(rows: DataFrame, hits: DataFrame, window: int, block: int, key: bytes) -> DataFrame:
    """(doc_id, text_key, place, window_hash, second): all windows around anchors, of the first document of each text. Written."""
    # only texts with anchors move; those let through wrongly find no hits
    wanted = Among(hits, "text_key")
    texts = rows.where(wanted.maybe("text_key")).select("text_key", "digest", "text").groupBy("text_key", "digest").agg(F.first("text").alias("text"))
    first = rows.groupBy("text_key", "digest").agg(F.min("doc_id").alias("doc_id"))
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("place", pa.int32()), ("window_hash", pa.int64()), ("second", pa.int64())])

    @tidy
    def extend(batches):
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"), key=key)
            rolling, inside, _ = _blocks(words, block)
            full, whole = words.windows(window)
            again, _ = words.windows(window, SECOND)
            near = np.zeros(len(rolling) + 1, np.int32)
            hits = batch.column("hits")
            for i, (s, e) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                own = np.sort(hits[i].values.to_numpy())
                values = signed(rolling[s:e])
                at = np.searchsorted(own, values)
                hit = s + np.flatnonzero((own[np.minimum(at, len(own) - 1)] == values) & inside[s:e])
                # windows that hold the block start at most window - block words before it
                np.add.at(near, np.maximum(s, hit - (window - block)), 1)
                np.add.at(near, hit + 1, -1)
            at = np.flatnonzero((np.cumsum(near)[:-1] > 0) & whole)
            owner = np.repeat(np.arange(batch.num_rows), words.counts)[at]
            yield batch_of(schema, doc_id=_numbers(batch, "doc_id")[owner], text_key=_numbers(batch, "text_key")[owner], place=(at - words.first[owner]).astype(np.int32), window_hash=signed(full[at]), second=signed(again[at]))

    joined = texts.join(hits, "text_key").join(first, ["text_key", "digest"]).select("doc_id", "text_key", "hits", "text")
    out = written(joined.mapInArrow(extend, "doc_id long, text_key long, place int, window_hash long, second long"))
    wanted.destroy()
    dropped(hits)
    return out


def repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", key: bytes | None = None) -> DataFrame:
    """(doc_id, text_key, whole, places): what to remove, for the rows that lose words.

    text_key is the text's hash under the key (common.text_digest); whole marks copies of a text with a smaller id, places are the
    starts of the other repeated windows. One row for each (doc_id, text_key).
    """
    block, key = window // 2, key or secret()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text_key, digest = text_digest(text, key)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key.alias("text_key"), digest.alias("digest"), text.alias("text")).where("doc_id is not null")
    windows = _candidates(rows, _anchors(rows, block, key), window, block, key)
    same = ["window_hash", "second"]
    lowest = windows.groupBy(*same).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high").drop("high")
    lowest = written(lowest)
    later = _hot_join(windows, lowest, same, windows.count()).where("doc_id > low")
    places = later.groupBy("doc_id", "text_key").agg(F.collect_list("place").alias("places")).withColumn("whole", F.lit(False))
    keys = rows.select("doc_id", "text_key", "digest").distinct()
    first = rows.groupBy("text_key", "digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high")
    copies = keys.join(first, ["text_key", "digest"]).where("doc_id > low").select("doc_id", "text_key", F.lit(None).cast("array<int>").alias("places"), F.lit(True).alias("whole"))
    out = written(places.select("doc_id", "text_key", "places", "whole").unionByName(copies).select("doc_id", "text_key", "whole", "places"))
    dropped(windows, lowest)
    return out


def _kept(words: Words, i: int, whole: bool, places: np.ndarray | None, window: int) -> np.ndarray | None:
    """Which words of text i stay; None: all."""
    n = int(words.counts[i])
    if whole:
        return np.zeros(n, bool) if n >= window else None
    if places is None or not len(places):
        return None
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + window, -1)
    return np.cumsum(edge)[:-1] == 0


def _kept_text(words: Words, i: int, stay: np.ndarray | None) -> bytes:
    s, e = int(words.first[i]), int(words.first[i + 1])
    raw = words.buf[words.begin[s] : words.end[e - 1]].tobytes() if e > s else b""
    parts = raw.split()
    return b" ".join(parts if stay is None else [p for p, k in zip(parts, stay.tolist(), strict=True) if k])


def removed(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row; with texts, docs' own columns, cut.

    With texts, a row that loses no word keeps its text as it is; one that loses some has the words
    left, joined by one space.
    """
    drawn = secret()
    found = repeats(docs, window, id_col, text_col, drawn)
    own = docs.columns
    source = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own))) if texts else docs.select(F.col(id_col).cast("long").alias("c0"), F.col(text_col).cast("string").alias("c1"))
    id_at, text_at = (f"c{own.index(id_col)}", f"c{own.index(text_col)}") if texts else ("c0", "c1")
    kept = source.columns
    key, _ = text_digest(F.coalesce(F.col(text_at).cast("string"), F.lit("")), drawn)
    # only rows that may lose words move to be joined
    asked = Among(found, "text_key")
    same = (F.col(id_at).cast("long") == found.doc_id) & (key == found.text_key)
    joined = source.where(asked.maybe(key)).join(found.hint("merge"), same, "left").select(*kept, "whole", "places")

    def judge(batch):
        words = Words(batch.column(text_at))
        whole, places = batch.column("whole").to_pylist(), batch.column("places")
        stay = [_kept(words, i, bool(whole[i]), places[i].values.to_numpy().astype(np.int64) if places[i].is_valid else None, window) for i in range(batch.num_rows)]
        return words, stay

    @tidy
    def digest(batches):
        for batch in slices(batches, text_at):
            words, stay = judge(batch)
            gone = [0 if k is None else int((~k).sum()) for k in stay]
            sha = [hashlib.sha256(_kept_text(words, i, k)).hexdigest() for i, k in enumerate(stay)]
            yield pa.RecordBatch.from_arrays([batch.column("c0"), pa.array(words.counts.astype(np.int64)), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    @tidy
    def cut(batches):
        for batch in slices(batches, text_at):
            words, stay = judge(batch)
            old = batch.column(text_at)
            new = pa.array([old[i].as_py() if k is None else _kept_text(words, i, k).decode() for i, k in enumerate(stay)], pa.string())
            yield pa.RecordBatch.from_arrays([new if c == text_at else batch.column(c) for c in kept], names=kept)

    @tidy
    def untouched(batches):
        for batch in slices(batches, text_at):
            batch = batch.filter(pc.invert(asked.test(batch.column("key"))))
            words = Words(batch.column(text_at))
            sha = [hashlib.sha256(_kept_text(words, i, None)).hexdigest() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("c0"), pa.array(words.counts.astype(np.int64)), pa.array(np.zeros(batch.num_rows, np.int64)), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    if not texts:
        schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
        return joined.mapInArrow(digest, schema).unionByName(source.withColumn("key", key).mapInArrow(untouched, schema))
    return joined.mapInArrow(cut, source.schema).unionByName(source.where(~asked.maybe(key))).toDF(*own)
