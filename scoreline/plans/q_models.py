"""Queries of training, scoring, backtests and streams. Model values have no SQL twin; tests cover them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import drift, rolling, training
from ..sources import adapt, store, tables
from ..streaming import jobs
from . import backtest, retrain
from .base import G, P, query, rounded, s6
from .concurrent import each
from .features import DROPPED
from .q_features import SPORT_STATS, sport_matrix

SETTINGS = training.Settings()
_FEW = training.Boosting(rounds=3, leaves=6, depth=3)
#: Few shallow trees, for tests of the jobs.
QUICK = training.Settings(rounds=5, depth=3, small_rounds=3, boosted=_FEW, small_boosted=_FEW)
#: Folder of the models of an application's input, so that queries share one training.
_TRAINED: dict[tuple, str] = {}
_METRICS = "sport string, n long, accuracy double, log_loss double, brier double, mean_edge double, sure_accuracy double, sure_n long, auc double, lift double"


def _united(parts):
    return reduce(lambda a, b: a.unionByName(b), parts)


def _matrix(spark, sf, sport, folder):
    """A sport's whole matrix, in the folder of an application's models; written once."""
    path = f"{folder}/matrix/{sport}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        sport_matrix(spark, sf, sport).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _folder(spark, sf) -> str:
    key = (spark.sparkContext.applicationId, sf, repr(SETTINGS), training.LEAST)
    return _TRAINED.get(key) or _TRAINED.setdefault(key, store.shared_path(spark))


def registry(spark, sf) -> str:
    """A registry with a model of each sport that has games enough, trained on its whole feature matrix, and the matrices."""
    folder = _folder(spark, sf)
    if not training.listed(spark, folder).isEmpty():
        return folder

    def train(sport):
        games = _matrix(spark, sf, sport, folder)
        return sport, training.train(games, tables.feature_columns(games, DROPPED), SETTINGS)

    done = [(sport, t) for sport, t in each(spark, train, SPORT_STATS) if t is not None]
    if not done:
        raise ValueError(f"no sport has {training.LEAST} labelled games")
    for sport, t in done:
        training.save(t, sport, "v1", folder)
    return folder


def _models(spark, sf):
    """(sport, its matrix, its registered model)."""
    folder = registry(spark, sf)
    sports = [r["sport"] for r in training.listed(spark, folder).where("active").select("sport").orderBy("sport").collect()]
    return [(s, spark.read.parquet(f"{folder}/matrix/{s}"), training.load(spark, folder, s)) for s in sports]


@query("m1_ensemble")
def m1(spark, sf):
    held = lambda games: rolling.time_split(games.where("result_over is not null"), ["sport"]).where("part = 'holdout'")
    return _united(training.score(m.model, held(games), m.features, SETTINGS).select("game_id", "prob_a", "prob_b") for _, games, m in _models(spark, sf))


_AB = P + ", ab AS (SELECT prediction_id, prob_over AS a, CAST(game_id * 104729 % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS b FROM predictions), bl AS (SELECT *, 0.5::DOUBLE * a + 0.5::DOUBLE * b AS p, abs(a - b) / 2 AS h FROM ab)\n"


def _two(spark, sf):
    return adapt.predictions(spark, sf).select("prediction_id", F.col("prob_over").alias("a"), ((F.col("game_id") * 104729 % 1000).cast("double") / 1000.0).alias("b"))


@query("m2_blend", _AB + f"SELECT prediction_id, {s6('p', 'prob')} FROM bl")
def m2(spark, sf):
    w = training.Settings().weights
    return rounded(_two(spark, sf).select("prediction_id", (w[0] * F.col("a") + w[1] * F.col("b")).alias("prob")))


@query("m3_isotonic")
def m3(spark, sf):
    scored = store.stored(adapt.predictions(spark, sf).select("prediction_id", F.col("prob_over").alias("prob"), F.col("result_over").alias("label")))
    return training.calibrator(scored).transform(scored).select("prediction_id", "prob", "calibrated")


@query("m4_interval", _AB + "SELECT prediction_id, round(greatest(0, p - h), 4) + 0.0 AS low, round(least(1, p + h), 4) + 0.0 AS high FROM bl")
def m4(spark, sf):
    a, b = F.col("a"), F.col("b")
    low, high = training.interval(training.Settings().weights[0] * a + training.Settings().weights[1] * b, a, b)
    return _two(spark, sf).select("prediction_id", (low + F.lit(0.0)).alias("low"), (high + F.lit(0.0)).alias("high"))


@query("m5_importance")
def m5(spark, sf):
    return _united(training.importance(m.model, m.features, SETTINGS).withColumn("sport", F.lit(sport)) for sport, _, m in _models(spark, sf))


@query("m6_train")
def m6(spark, sf):
    return training.listed(spark, registry(spark, sf)).select(F.from_json("metrics", _METRICS).alias("m")).select("m.*")


_ENOUGH = f"{G}, n AS (SELECT sport, count(*) AS n FROM games GROUP BY sport)"


@query("m6_registered", _ENOUGH + f" SELECT sport, n AS rows, n - CAST(floor(n * 0.85::DOUBLE) AS BIGINT) AS held FROM n WHERE n >= {training.LEAST}")
def m6_registered(spark, sf):
    """Labelled games of each registered model, and those its metrics are of."""
    return training.listed(spark, registry(spark, sf)).select("sport", "rows", F.from_json("metrics", _METRICS)["n"].alias("held"))


@query("m7_registry", P + ", r AS (SELECT sport, model_version AS version, max(game_date) AS trained_at FROM predictions GROUP BY sport, model_version), l AS (SELECT sport, max_by(version, (trained_at, version)) AS v FROM r GROUP BY sport) SELECT sport, version, trained_at, version = v AS active FROM r JOIN l USING (sport)")
def m7(spark, sf):
    r = adapt.predictions(spark, sf).groupBy("sport", F.col("model_version").alias("version")).agg(F.max("game_date").alias("trained_at"))
    return training.active_runs(r)


def predictions(spark, sf):
    """The prediction table of all games by the registered models, written: (sport, game_id, model_version, prob, low, high), null without a model."""
    parts = [
        training.score(m.model, training.impute(games, m.medians, m.features), m.features, SETTINGS).select("sport", "game_id", F.lit(m.version).alias("model_version"), "prob", "low", "high")
        for _, games, m in _models(spark, sf)
    ]
    games, null = adapt.games(spark, sf), F.lit(None)
    rest = games.join(_united(p.select("sport") for p in parts).distinct(), "sport", "left_anti").select("sport", "game_id", null.cast("string").alias("model_version"), *(null.cast("double").alias(c) for c in ("prob", "low", "high")))
    return store.stored(_united([*parts, rest]))


@query("m8_batch_scoring")
def m8(spark, sf):
    """A row for each game; null values where its sport has too few games for a model."""
    return predictions(spark, sf).select("game_id", "prob", "low", "high")


@query("m8_prediction_table", _ENOUGH + f" SELECT sport, game_id, CASE WHEN n >= {training.LEAST} THEN 'v1' END AS model_version, CASE WHEN n >= {training.LEAST} THEN true END AS valid FROM games JOIN n USING (sport)")
def m8_table(spark, sf):
    """valid: a probability with its interval in [0, 1]."""
    p = predictions(spark, sf)
    return p.select("sport", "game_id", "model_version", (F.col("prob").between(0, 1) & (F.col("low") >= 0) & (F.col("low") <= F.col("high")) & (F.col("high") <= 1)).alias("valid"))


@query("m9_backtest")
def m9(spark, sf):
    """Each fold fits models of its own, so only the matrices are asked for."""
    folder = _folder(spark, sf)

    def run(sport):
        games = _matrix(spark, sf, sport, folder)
        return sport, backtest.run(games, tables.feature_columns(games, DROPPED), settings=SETTINGS)

    return _united(b.folds.withColumn("sport", F.lit(sport)) for sport, b in each(spark, run, SPORT_STATS) if b.status == "ok")


@query("d6_registered_drift")
def d6_registered(spark, sf):
    """Each sport's last 300 games against what its registered model was trained on, and the decision."""
    models = _models(spark, sf)
    recent = lambda games: rolling.recent_split(games, ["sport"], 300).where("recent")
    report = store.stored(_united(retrain.drift_report(m, recent(games), sport) for sport, games, m in models))
    found = report.groupBy("sport").agg(F.count("*").alias("checked"), F.count_if("drifted").alias("drifted_features"))
    have = adapt.games(spark, sf).select("sport").distinct().withColumn("trained", F.col("sport").isin([s for s, _, _ in models]))
    return drift.decision(report, have).join(found, "sport", "left")


# ------------------------------------------------------------------ streams over the events
def _events(spark, sf):
    schema = adapt.table(spark, sf, "events").schema
    # as a pattern, so that a single file will do where a stream expects a folder
    return spark.readStream.schema(schema).parquet(f"{sf}/[e]vents.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("t1_stream_ingest", "SELECT event_id, user_id FROM events")
def t1(spark, sf):
    e = _events(spark, sf)
    twice = e.select("event_id", "ts", "user_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return jobs.drain(jobs.ingest(twice, "event_id", "ts"), store.shared_path(spark)).select("event_id", "user_id")


@query("t2_alert_stream", f"WITH p AS (SELECT event_id AS prediction_id, CAST(event_id * 7919 % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS p FROM events) SELECT prediction_id, CASE WHEN p >= 0.5::DOUBLE THEN 'over' ELSE 'under' END AS direction, {s6('2 * abs(p - 0.5::DOUBLE)', 'confidence')} FROM p WHERE 2 * abs(p - 0.5::DOUBLE) >= 0.65::DOUBLE")
def t2(spark, sf):
    p = _events(spark, sf).select(F.col("event_id").alias("prediction_id"), "ts", ((F.col("event_id") * 7919 % 1000).cast("double") / 1000.0).alias("prob_over"))
    return rounded(jobs.drain(jobs.alert_stream(p), store.shared_path(spark)).drop("ts"))


@query("t3_settlement_stream", "WITH p AS (SELECT event_id // 2 AS game, ts AS p_ts, CAST(event_id * 7919 % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS prob, 50.0::DOUBLE AS line FROM events WHERE event_id % 2 = 0), f AS (SELECT event_id // 2 AS game, ts AS f_ts, value AS total FROM events WHERE event_id % 2 = 1) SELECT game, total > line AS over, (total > line) = (prob >= 0.5::DOUBLE) AS is_correct FROM p JOIN f USING (game) WHERE f_ts >= p_ts AND f_ts <= p_ts + INTERVAL 2 DAY")
def t3(spark, sf):
    return jobs.drain(jobs.settle_stream(*_two_streams(spark, sf)), store.shared_path(spark)).select("game", "over", "is_correct")


def _two_streams(spark, sf):
    game = F.floor(F.col("event_id") / 2).alias("game")
    p = _events(spark, sf).where("event_id % 2 = 0").select(game, F.col("ts").alias("p_ts"), ((F.col("event_id") * 7919 % 1000).cast("double") / 1000.0).alias("prob_over"), F.lit(50.0).alias("line"))
    f = _events(spark, sf).where("event_id % 2 = 1").select(game, F.col("ts").alias("f_ts"), F.col("value").alias("total"))
    return p, f


@query("t3_settlement_outer", """WITH p AS (SELECT event_id // 2 AS game, ts AS p_ts, CAST(event_id * 7919 % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS prob, 50.0::DOUBLE AS line FROM events WHERE event_id % 2 = 0), f AS (SELECT event_id // 2 AS game, ts AS f_ts, value AS total FROM events WHERE event_id % 2 = 1),
m AS (SELECT least((SELECT max(p_ts) FROM p), (SELECT max(f_ts) FROM f)) - INTERVAL 2 DAY - INTERVAL 2 HOUR AS done)
SELECT game, total > line AS over, (total > line) = (prob >= 0.5::DOUBLE) AS is_correct FROM m, p LEFT JOIN f USING (game) WHERE p_ts < done AND (f_ts IS NULL OR (f_ts >= p_ts AND f_ts <= p_ts + INTERVAL 2 DAY)) UNION ALL
SELECT game, NULL, NULL FROM m, p JOIN f USING (game) WHERE p_ts < done AND NOT (f_ts >= p_ts AND f_ts <= p_ts + INTERVAL 2 DAY)""")
def t3_outer(spark, sf):
    """Settled and unsettled predictions whose wait both streams have passed by more than their delay of an hour."""
    settled = jobs.drain(jobs.settle_stream(*_two_streams(spark, sf), unsettled=True), store.shared_path(spark))
    last = [adapt.table(spark, sf, "events").where(f"event_id % 2 = {k}").agg(F.max(F.col("ts").cast("timestamp")).alias(f"m{k}")) for k in (0, 1)]
    done = F.least("m0", "m1") - F.expr("INTERVAL 2 DAYS 2 HOURS")
    # a row of two times
    return settled.join(F.broadcast(last[0].join(last[1])), F.col("p_ts") < done).select("game", "over", "is_correct")


@query("t4_rate_stream", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS requests, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1 HAVING time_bucket(INTERVAL 1 HOUR, any_value(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def t4(spark, sf):
    """Hours that the watermark has closed."""
    out = jobs.drain(jobs.rate_stream(_events(spark, sf).select("ts", F.col("value").alias("latency"))), store.shared_path(spark))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


_FORM = """WITH e AS (SELECT event_id AS id, user_id AS key, ts, value - 50 AS v FROM events), g AS (SELECT *, CASE WHEN v > 0 THEN 1 WHEN v < 0 THEN -1 END AS s FROM e),
d AS (SELECT *, CASE WHEN s = lag(s) OVER (PARTITION BY key ORDER BY ts, id) THEN 0 ELSE 1 END AS n FROM g WHERE s IS NOT NULL), r AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY ts, id) AS run FROM d),
a AS (SELECT *, s * row_number() OVER (PARTITION BY key, run ORDER BY ts, id) AS after FROM r),
t AS (SELECT g.*, after, list(g.v) OVER h AS l FROM g LEFT JOIN a USING (id) WINDOW h AS (PARTITION BY g.key ORDER BY g.ts, g.id ROWS BETWEEN 128 PRECEDING AND 1 PRECEDING))
SELECT id, round(avg(v) OVER w, 8) + 0.0 AS roll_mean, CASE WHEN len(l) > 0 THEN round(list_reduce(l, lambda y, x: 0.3::DOUBLE * x + 0.7::DOUBLE * y), 8) + 0.0 END AS ema3, CASE WHEN len(l) > 0 THEN round(list_reduce(l, lambda y, x: 0.5::DOUBLE * x + 0.5::DOUBLE * y), 8) + 0.0 END AS ema5,
CAST(coalesce(last_value(after IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS run FROM t WINDOW w AS (PARTITION BY key ORDER BY ts, id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"""


def _form_rows(events):
    return events.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") - 50).alias("value"))


def _form(df):
    return df.select("id", *((F.round(c, 8) + F.lit(0.0)).alias(c) for c in ("roll_mean", "ema3", "ema5")), "run")


@query("t5_form_stream", _FORM)
def t5(spark, sf):
    with jobs.state_store(spark):
        return _form(jobs.drain(jobs.form_stream(_form_rows(_events(spark, sf))), store.shared_path(spark)))


@query("t5_kept_form", _FORM)
def t5_kept(spark, sf):
    """The events in three files that each cover all days, one a micro-batch: most rows of the later ones are late."""
    folder, rows = store.shared_path(spark), _form_rows(adapt.table(spark, sf, "events"))
    rows.repartition(3, "id").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    jobs.keep_form(stream, f"{folder}/kept")()
    return _form(jobs.current_form(spark, f"{folder}/kept"))
