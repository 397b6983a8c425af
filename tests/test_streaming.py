"""Streams give what the batch operators give."""

import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from scoreline.operators import monitor
from scoreline.sources import store
from scoreline.streaming import jobs


def _stream(spark, rows, schema):
    path = store.shared_path(spark)
    spark.createDataFrame(rows, schema).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


SCHEMA = "key long, id long, ts timestamp, value double"


def _rows(n=90):
    rng, t0 = random.Random(4), datetime(2024, 1, 1)
    return [(rng.choice([1, 1, 1, 2, None]), i, t0 + timedelta(hours=i // 2), rng.choice([None, 0.0, float((i * 7) % 11 - 5), 3.0])) for i in range(n)]


def _want(rows, n):
    """Row by row: mean of the n rows before, both exponential means, run."""
    out, state = {}, {}
    for key, i, _, v in rows:
        values, emas, run = state.get(key, ([], [None, None], 0))
        known = [x for x in values[-n:] if x is not None]
        out[i] = (sum(known) / len(known) if known else None, *emas, run)
        if v is not None:
            emas = [v if y is None else a * v + (1 - a) * y for a, y in zip((0.3, 0.5), emas, strict=True)]
            run = run if v == 0 else max(run, 0) + 1 if v > 0 else min(run, 0) - 1
        state[key] = ([*values, v], emas, run)
    return out


def _check(got, want):
    assert len(got) == len(want)
    for r in got:
        have = (r.roll_mean, r.ema3, r.ema5, r.run)
        assert all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-9) for x, y in zip(have, want[r.id], strict=True)), (r, want[r.id])


def test_form_of_a_stream_and_of_a_table(spark):
    rows = _rows()
    with jobs.state_store(spark):
        got = jobs.drain(jobs.form_stream(_stream(spark, rows, SCHEMA), n=5), store.shared_path(spark)).collect()
    _check(got, _want(rows, 5))
    assert not any(r.late for r in got)
    _check(jobs.form_batch(spark.createDataFrame(rows, SCHEMA).repartition(3), 5).collect(), _want(rows, 5))


def test_late_rows_end_equal_to_the_batch(spark):
    rows, folder = _rows(), store.shared_path(spark)
    parts = [rows[:40], rows[44:70], rows[40:44] + rows[70:]]  # four rows come after their time
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        jobs.keep_form(stream, f"{folder}/kept", n=5)()
    _check(jobs.current_form(spark, f"{folder}/kept").collect(), _want(rows, 5))
    late = spark.read.parquet(f"{folder}/kept/late").where("late")
    assert {r.id for r in late.collect()} == {40, 41, 42, 43}
    # rows come again without a new batch: nothing changes
    jobs.keep_form(stream, f"{folder}/kept", n=5)()
    _check(jobs.current_form(spark, f"{folder}/kept").collect(), _want(rows, 5))


def test_form_after_a_forgotten_state(spark):
    rows, folder = [r for r in _rows() if r[0] == 1], store.shared_path(spark)
    for part in (rows[:20], rows[20:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        jobs.keep_form(stream, f"{folder}/kept", n=5, idle=pd.Timedelta(milliseconds=1))()
    _check(jobs.current_form(spark, f"{folder}/kept").collect(), _want(rows, 5))
    form = spark.read.parquet(f"{folder}/kept/form")
    assert form.where("seen = 0").count() == 2


def test_unsettled_predictions_come_out_when_their_wait_is_over(spark):
    t0 = datetime(2024, 1, 1)
    p = [(i, t0 + timedelta(days=i), 0.7, 100.0) for i in range(10)]
    f = [(i, t0 + timedelta(days=i, hours=5), 110.0) for i in (0, 2)] + [(4, t0 + timedelta(days=7), 90.0), (50, t0 + timedelta(days=9), 1.0)]
    preds, finals = _stream(spark, p, "game long, p_ts timestamp, prob_over double, line double"), _stream(spark, f, "game long, f_ts timestamp, total double")
    got = {r.game: r for r in jobs.drain(jobs.settle_stream(preds, finals, unsettled=True), store.shared_path(spark)).collect()}
    assert {g for g, r in got.items() if r.is_correct} == {0, 2}
    # 4's final came after two days; from 7 on, two days and the delay haven't passed
    assert {g for g, r in got.items() if r.total is None} == {1, 3, 4, 5, 6}


def test_rates_of_closed_windows_and_sketches(spark):
    rng, t0 = random.Random(7), datetime(2024, 1, 1)
    rows = [(t0 + timedelta(seconds=rng.randrange(5 * 3600)), float(rng.randrange(1000))) for _ in range(3000)]
    schema = "ts timestamp, latency double"
    log, last = spark.createDataFrame(rows, schema), max(r[0] for r in rows)
    closed = lambda width: F.col("start") + F.expr(f"INTERVAL {width}") <= F.lit(last) - F.expr("INTERVAL 10 MINUTES")
    show = lambda df: sorted((r.start, r.requests) for r in df.collect())
    want = monitor.request_rate(log, "1 hour").where(closed("1 HOUR"))
    got = jobs.drain(jobs.rate_stream(_stream(spark, rows, schema)), store.shared_path(spark))
    assert show(got) == show(want) and got.count() >= 3
    slid = jobs.drain(jobs.rate_stream(_stream(spark, rows, schema), slide="15 minutes"), store.shared_path(spark))
    every = log.groupBy(F.window("ts", "1 hour", "15 minutes").alias("w")).agg(F.count("*").alias("requests")).select(F.col("w.start").alias("start"), "requests")
    assert show(slid) == show(every.where(closed("1 HOUR")))
    # five-minute sketches of the stream, merged to hours, have ranks within the stated error
    sketches = jobs.drain(jobs.sketch_stream(_stream(spark, rows, schema)), store.shared_path(spark))
    hours = {r.start: r for r in monitor.roll_up(sketches).collect()}
    assert sum(r.requests for r in hours.values()) == log.where(F.col("ts") < last.replace(minute=last.minute // 5 * 5, second=0) - timedelta(minutes=10)).count() or len(hours) >= 4
    for start, r in list(hours.items())[:3]:
        own = [v for t, v in rows if start <= t < start + timedelta(hours=1)]
        if len(own) == r.requests:
            for q, v in ((0.5, r.p50), (0.95, r.p95)):
                assert sum(x < v for x in own) / len(own) - 0.01 <= q <= sum(x <= v for x in own) / len(own) + 0.01
    assert monitor.roll_up(sketches, slide="30 minutes").count() > len(hours)


def test_ingest_drops_repeats(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(i % 5, t0) for i in range(20)]
    s = _stream(spark, rows, "game_id long, ts timestamp")
    assert sorted(r.game_id for r in jobs.drain(jobs.ingest(s, "game_id", "ts"), store.shared_path(spark)).collect()) == [0, 1, 2, 3, 4]


def test_rates_of_a_full_hour_are_exact(spark):
    # 40,000 distinct latencies in an hour: percentile_approx of accuracy 1,000 was off by ranks
    values = list(range(40_000))
    random.Random(3).shuffle(values)
    t0 = datetime(2024, 1, 1)
    rows = [(t0 + timedelta(milliseconds=80 * i), float(v)) for i, v in enumerate(values)] + [(t0 + timedelta(hours=3), 0.0)]
    got = jobs.drain(jobs.rate_stream(_stream(spark, rows, "ts timestamp, latency double")), store.shared_path(spark)).collect()
    assert [(r.requests, r.p95) for r in got] == [(40_000, 37_999.0)]


def test_form_of_a_key_reads_and_writes_its_state_once():
    from pyspark.sql import Row

    class Handle:
        """State that counts its calls."""

        calls, state = [], None

        def getValueState(self, *a):
            return self

        def get(self):
            self.calls.append("get")
            return self.state

        def update(self, state):
            self.calls.append("update")
            self.state = state

    handle, form, row = Handle(), jobs.Form(5, 1000), Row("id", "ts", "value")
    form.init(handle)
    rows = _rows()
    # a row without a time comes first, as in the batch; one that comes later is late
    own = [row(1000, None, 2.0)] + [row(i, int(t.timestamp() * 1e6), v) for key, i, t, v in rows if key == 1]
    got = list(form.handleInputRows(("1",), iter(own[10:0:-1] + own[:1]), None))
    got += list(form.handleInputRows(("1",), iter([*own[11:], row(1001, None, 1.0)]), None))
    assert handle.calls == ["get", "update"] * 2
    assert [r.id for r in got if r.late] == [1001]
    _check([r for r in got if not r.late], _want([(1, r.id, r.ts, r.value) for r in own], 5))
    assert list(form.handleInputRows(("1",), iter([]), None)) == []


def test_kept_form_of_rows_without_a_time(spark):
    t0, folder = datetime(2024, 1, 1), store.shared_path(spark)
    rows = [(1, 1, None, 2.0), *((1, i, t0 + timedelta(hours=i), float(i % 5 - 2)) for i in range(2, 12)), (2, 20, None, 1.0), (2, 21, t0, 3.0)]
    late = [(1, 0, None, -1.0), (1, 12, t0 + timedelta(hours=12), 1.0), (2, 22, t0 + timedelta(hours=1), 0.5)]
    for part in (rows, late):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        jobs.keep_form(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), f"{folder}/kept", n=5)()
    # nulls first: the row 0 comes before the row 1
    _check(jobs.current_form(spark, f"{folder}/kept").collect(), _want(late[:1] + rows + late[1:], 5))
    assert [r.id for r in spark.read.parquet(f"{folder}/kept/late").where("late").collect()] == [0]


def test_forgotten_state_is_never_taken_for_all_rows(spark):
    # the second run begins a key's state anew, the third goes on from that state
    rows, folder = [r for r in _rows() if r[0] == 1], store.shared_path(spark)
    for part, idle in ((rows[:20], pd.Timedelta(milliseconds=1)), (rows[20:23], pd.Timedelta(days=400)), (rows[23:], pd.Timedelta(days=400))):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        jobs.keep_form(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), f"{folder}/kept", n=5, idle=idle)()
    assert spark.read.parquet(f"{folder}/kept/form").where("seen = 0").count() == 2
    _check(jobs.current_form(spark, f"{folder}/kept").collect(), _want(rows, 5))


def test_rows_of_a_key_meet_the_state_packed():
    import pyarrow as pa

    rows = [(str(i % 3), i, None if i == 7 else 100 - i, float(i)) for i in range(60)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("name", "id", "ts", "value"), r, strict=True)) for r in rows[a : a + 25]]) for a in (0, 25, 50)]
    batches.insert(1, batches[0].slice(0, 0))
    for held, most in ((1000, 3 + 60 // 16), (30, 2 * 3 + 60 // 16)):
        got = [r for b in jobs._packed(batches, 16, held) for r in b.to_pylist()]
        assert len(got) <= most and all(len(r["id"]) <= 16 for r in got)
        assert sorted((r["name"], *x) for r in got for x in zip(r["id"], r["ts"], r["value"], strict=True)) == sorted(rows)


def test_form_of_a_table_is_one_pass_over_its_rows(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    plan = jobs.form_batch(df, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1 and "Join" not in plan
    # a key goes on from one batch of rows to the next
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        _check(jobs.form_batch(df, 5).collect(), _want(_rows(), 5))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_equal_rows_of_a_late_key_are_all_kept(spark):
    t0, folder = datetime(2024, 1, 1), store.shared_path(spark)
    row = (1, 5, t0, 1.0)
    for part in ([row, row], [(1, 6, t0 + timedelta(hours=1), 2.0)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        jobs.keep_form(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), f"{folder}/kept", n=5)()
    assert sorted((r.id, r.roll_mean) for r in jobs.current_form(spark, f"{folder}/kept").where("roll_mean IS NOT NULL").collect()) == [(5, 1.0), (6, 1.0)]
    assert jobs.current_form(spark, f"{folder}/kept").count() == 3
