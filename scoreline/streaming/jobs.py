"""Incremental jobs with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import partial
from itertools import batched, chain
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import confidence, direction
from ..operators import monitor, rolling

ALPHAS = rolling.ALPHAS
VALUES = "roll_mean double, ema3 double, ema5 double, run long"
FORM = f"key long, id long, ts timestamp, value double, {VALUES}, seen long, late boolean"
_FORM_ROW = Row(*(c.strip().split(" ")[0] for c in FORM.split(",")))
#: Rows of a key that go to the state's worker and back as one.
PACK = 512
#: Rows that a task gathers at a time to pack them.
HELD = 1_000_000
#: Transforming state needs the store that Spark brings for it.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ingest(stream: DataFrame, key: str, ts: str, delay: str = "1 day") -> DataFrame:
    """Rows once by key; state is dropped when the watermark has passed a key's time."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def alert_stream(predictions: DataFrame, threshold: float = 0.65) -> DataFrame:
    p = F.col("prob_over")
    return predictions.where(confidence(p) >= threshold).select("prediction_id", "ts", direction(p).alias("direction"), confidence(p).alias("confidence"))


def settle_stream(predictions: DataFrame, finals: DataFrame, wait: str = "2 days", delay: str = "1 hour", unsettled: bool = False) -> DataFrame:
    """predictions (game, p_ts, prob_over, line) with finals (game, f_ts, total) up to `wait` later.

    Both sides are watermarked and the times bounded, so state on both is finite. With unsettled, a prediction
    that no final met comes out once, with nulls, when both streams have passed its wait.
    """
    p, f = predictions.withWatermark("p_ts", delay).alias("p"), finals.withWatermark("f_ts", delay).alias("f")
    joined = p.join(f, F.expr(f"p.game = f.game AND f.f_ts >= p.p_ts AND f.f_ts <= p.p_ts + INTERVAL {wait}"), "left_outer" if unsettled else "inner")
    over = F.col("total") > F.col("line")
    return joined.select("p.game", "p_ts", "f_ts", "prob_over", "line", "total", over.alias("over"), (over == (F.col("prob_over") >= 0.5)).alias("is_correct"))


def rate_stream(log: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(start, requests, p95) of each window once the watermark has closed it; with slide, windows overlap.

    p95 is exact: the state holds a count of each distinct latency of the open windows.
    """
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return log.withWatermark("ts", delay).groupBy(w.alias("w")).agg(F.count("*").alias("requests"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency)").alias("p95")).select(F.col("w.start").alias("start"), "requests", "p95")


def sketch_stream(log: DataFrame, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """monitor.latency_sketches of a stream: rows of closed windows, which monitor.roll_up merges to longer ones."""
    return monitor.latency_sketches(log.withWatermark("ts", delay), width)


class Before:
    """Values of a key before its next row: of its last n values their mean, of all of them exponential means and signed run."""

    __slots__ = ("n", "values", "ema3", "ema5", "run")

    def __init__(self, n: int, values: Iterable[float | None] = (), ema3: float | None = None, ema5: float | None = None, run: int = 0):
        self.n, self.values, self.ema3, self.ema5, self.run = n, list(values), ema3, ema5, run

    def get(self) -> tuple:
        known = [x for x in self.values if x is not None] if None in self.values else self.values
        return sum(known) / len(known) if known else None, self.ema3, self.ema5, self.run

    def add(self, v: float | None) -> None:
        self.values.append(v)
        if len(self.values) > self.n:
            del self.values[0]
        if v is not None:
            a, b = ALPHAS
            self.ema3 = v if self.ema3 is None else a * v + (1 - a) * self.ema3
            self.ema5 = v if self.ema5 is None else b * v + (1 - b) * self.ema5
            if v != 0:
                self.run = max(self.run, 0) + 1 if v > 0 else min(self.run, 0) - 1


class Form(StatefulProcessor):
    """State of a key, in one value: its last n values, count, exponential means, run and place.

    It is read and written once for each key of a micro-batch, as each call costs more than a row does. It is
    dropped when a key has been silent for `idle_ms`; rows after that have `seen` 0 again.
    """

    def __init__(self, n: int, idle_ms: int):
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.form = handle.getValueState("form", "values array<double>, seen long, ema3 double, ema5 double, run long, ts long, id long", self.idle_ms)

    def folded(self, rows: Iterable[tuple]) -> Iterator[tuple]:
        """The columns of FORM after the key, for (id, ts, value) of the key."""
        # nulls first, as in form_batch
        place = lambda ts, i: (ts is not None, ts or 0, i is not None, i or 0)
        got = sorted(((place(ts, i), i, ts, v) for i, ts, v in rows), key=itemgetter(0))
        if not got:
            return
        values, seen, ema3, ema5, run, *last = self.form.get() or ([], 0, None, None, 0, None, None)
        before, reached = Before(self.n, values, ema3, ema5, run), place(*last) if seen else None
        for at, i, ts, v in got:
            v = None if v is None or v != v else v
            if reached is not None and at <= reached:
                yield i, ts, v, None, None, None, None, seen, True
                continue
            yield i, ts, v, *before.get(), seen, False
            before.add(v)
            seen, last, reached = seen + 1, (ts, i), at
        self.form.update((before.values, seen, before.ema3, before.ema5, before.run, *last))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers) -> Iterator[Row]:
        own = int(key[0]) if key[0] else None
        for r in self.folded((r.id, r.ts, r.value) for r in rows):
            yield _FORM_ROW(own, *r)

    def close(self) -> None:
        pass


class PackedForm(Form):
    """Form of rows that hold arrays of ids, times and values; its rows hold arrays too, as each row on the way costs more than its values."""

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers) -> Iterator[Row]:
        own = int(key[0]) if key[0] else None
        flat = chain.from_iterable(zip(r.id, r.ts, r.value, strict=True) for r in rows)
        for some in batched(self.folded(flat), PACK):
            # tuples, as Spark's worker looks through each list's values for rows
            yield _FORM_ROW(own, *zip(*some, strict=True))


def _packed(batches: Iterable[pa.RecordBatch], size: int = PACK, held: int = HELD) -> Iterator[pa.RecordBatch]:
    """Rows of one name as few rows of arrays, of at most `size` each; up to `held` rows are gathered for that."""

    def packed(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(some).sort_by("name").combine_chunks()
        name, *rest = (t[c].chunk(0) for c in ("name", "id", "ts", "value"))
        ends = np.union1d(pc.run_end_encode(name).run_ends.to_numpy(), np.arange(size, t.num_rows, size))
        offsets = pa.array(np.append(0, ends), pa.int32())
        return pa.RecordBatch.from_arrays([name.take(offsets[:-1]), *(pa.ListArray.from_arrays(offsets, x) for x in rest)], t.schema.names)

    some, count = [], 0
    for batch in batches:
        if batch.num_rows:
            some.append(batch)
            count += batch.num_rows
        if count >= held:
            yield packed(some)
            some, count = [], 0
    if some:
        yield packed(some)


def form_stream(rows: DataFrame, n: int = 20, idle: pd.Timedelta = pd.Timedelta(days=400)) -> DataFrame:
    """(key, id, ts, value) with the mean of the n values before, their exponential means and signed run.

    A value of 0 leaves a run as it is; a null counts in none of them but takes a place among the n. State is n
    values and six numbers a key. A row not after its key's last one is late: it gets no values and
    changes no state; keep_form recomputes its key. Start the query inside state_store(spark).

    A micro-batch's rows are brought together by key and packed, some hundreds a row, before they meet the state.
    """
    # a null key is a key: grouped as text, as null keys don't find each other; times are whole numbers in the state
    named = rows.select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("name"), "id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("value").cast("double").alias("value"))
    together = named.withColumn("id", F.col("id").cast("long")).repartition("name")
    packed = together.mapInArrow(_packed, "name string, id array<long>, ts array<long>, value array<double>")
    arrays = FORM.replace("ts timestamp", "ts long").split(", ")
    arrays = ", ".join([arrays[0], *("{} array<{}>".format(*c.split(" ")) for c in arrays[1:])])
    out = packed.groupBy("name").transformWithState(PackedForm(n, int(idle.total_seconds() * 1000)), arrays, "Append", "ProcessingTime")
    return out.select("key", F.inline(F.arrays_zip(*_FORM_ROW[1:]))).withColumn("ts", F.timestamp_micros("ts"))


def _form_of_sorted(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of (key, ts, id) with what came before; a key may go on in the next batch."""
    key, before = object(), Before(n)
    for batch in batches:
        got = []
        for k, v in zip(batch.column("key").to_pylist(), batch.column("value").to_pylist(), strict=True):
            if k != key:
                key, before = k, Before(n)
            got.append(before.get())
            before.add(v)
        columns = zip(*got, strict=True) if got else [()] * 4
        kinds = (pa.float64(), pa.float64(), pa.float64(), pa.int64())
        names = [c.split(" ")[0] for c in VALUES.split(", ")]
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], [*batch.schema.names, *names])


def form_batch(rows: DataFrame, n: int = 20) -> DataFrame:
    """What form_stream gives when no row is late, of a whole table, without `seen` and `late`.

    One exchange by key and one sort; rows then pass once, so a task holds a key's last n values and no more of it.
    """
    own = rows.select("key", "id", "ts", F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double")).alias("value"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema), VALUES])
    return own.repartition("key").sortWithinPartitions("key", "ts", "id").mapInArrow(partial(_form_of_sorted, n=n), schema)


def keep_form(rows: DataFrame, folder: str, n: int = 20, idle: pd.Timedelta = pd.Timedelta(days=400)) -> Callable[[], None]:
    """Folds a stream into a maintained table below folder, late rows included; returns what runs it over all there is now.

    A micro-batch's rows go to `form/batch=<id>`, late ones also to the side table `late`. Keys that the state
    knows wrongly (a late row so far, or rows that their expired state forgot) are computed from all
    their rows whenever they get new ones, into `rebuilt/batch=<id>`. Each write replaces its own batch, so a batch
    may run twice. current_form gives each row's newest values.
    """
    spark: SparkSession = rows.sparkSession

    def fold(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        at = lambda kind: f"{folder}/{kind}/batch={number:012d}"
        batch.write.mode("overwrite").parquet(at("form"))
        got = session.read.schema(FORM).parquet(at("form"))
        got.where("late").write.mode("overwrite").parquet(at("late"))
        every = _all(session, folder, "form").where(F.col("batch") <= number)
        begun = F.max(F.when(F.col("seen") == 0, F.col("batch")))  # a state that begins after the key's first batch has forgotten rows
        keys = every.groupBy("key").agg(F.max("batch").alias("newest"), F.bool_or("late").alias("late"), (begun > F.min("batch")).alias("forgot"))
        wrong = keys.where((F.col("newest") == number) & (F.col("late") | F.col("forgot")))
        rows = every.join(wrong.select(F.col("key").alias("_key")), F.col("key").eqNullSafe(F.col("_key")), "left_semi")
        form_batch(rows, n).write.mode("overwrite").parquet(at("rebuilt"))

    def run() -> None:
        with state_store(spark):
            q = form_stream(rows, n, idle).writeStream.foreachBatch(fold).option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        finally:
            q.stop()

    return run


def _all(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    form = FORM if kind != "rebuilt" else f"key long, id long, ts timestamp, value double, {VALUES}"
    return spark.read.schema(f"{form}, batch long").parquet(f"{folder}/{kind}")


def current_form(spark: SparkSession, folder: str) -> DataFrame:
    """(key, id, ts, value) with its values of the newest batch that computed it: of what a key's last rebuild left, and of what was streamed since."""
    values = ["key", "id", "ts", "value", "roll_mean", "ema3", "ema5", "run"]
    # a late row's key was rebuilt with it
    streamed, rebuilt = _all(spark, folder, "form").where(~F.col("late")), _all(spark, folder, "rebuilt")
    upto = rebuilt.groupBy(F.col("key").alias("_key")).agg(F.max("batch").alias("_upto"))
    of_key = F.col("key").eqNullSafe(F.col("_key"))
    last = rebuilt.join(upto, of_key & (F.col("batch") == F.col("_upto")), "left_semi")
    since = streamed.join(upto, of_key & (F.col("batch") <= F.col("_upto")), "left_anti")
    return last.select(*values).unionByName(since.select(*values))


@contextmanager
def state_store(spark: SparkSession):
    """Queries started inside keep their state in RocksDB and run no batch without data; the session's own settings come back after.

    By processing time such a query would run empty batches without end, to look for expired state, and
    never be through with what there is. Expired state isn't given to rows, so nothing waits for these.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def drain(stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream over what its source holds now, into Parquet files below path, and returns them."""
    spark: SparkSession = stream.sparkSession
    q = stream.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")
