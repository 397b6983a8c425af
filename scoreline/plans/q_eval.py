"""Queries of evaluation, betting, settlement, drift and monitoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.scalars import confidence
from ..operators import drift, metrics, monitor, settle, training
from ..sources import adapt, store, tables
from .base import G, P, query, rounded, s6
from .q_market import _SETTLED, settled

SPORTS = ("mlb", "nba", "nfl")


def _united(parts):
    return reduce(lambda a, b: a.unionByName(b), parts)

_SC = P + ", sc AS (SELECT game_id, sport, game_date, prob_over AS prob, result_over AS label FROM predictions)\n"
_RIGHT = "CASE WHEN (prob >= 0.5::DOUBLE) = (label = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
_CLIP = "greatest(2.220446049250313e-16::DOUBLE, least(1 - 2.220446049250313e-16::DOUBLE, prob))"
_CONF = "2 * abs(prob - 0.5::DOUBLE)"
_WIN = "(100.0::DOUBLE / 110.0::DOUBLE)"
_KELLY = f"greatest(0.0::DOUBLE, least(0.25::DOUBLE, (greatest(prob, 1 - prob) * ({_WIN} + 1) - 1) / {_WIN})) * 100"
_BETS = _SC + f""", b AS (SELECT *, {_CONF} AS confidence, (prob >= 0.5::DOUBLE) = (label = 1) AS won, CASE WHEN (prob >= 0.5::DOUBLE) = (label = 1) THEN 100 * {_WIN} ELSE -100.0::DOUBLE END AS flat_pnl,
{_KELLY} AS kelly_stake, CASE WHEN (prob >= 0.5::DOUBLE) = (label = 1) THEN {_KELLY} * {_WIN} ELSE -({_KELLY}) END AS kelly_pnl FROM sc)\n"""


def scored(spark, sf):
    return adapt.predictions(spark, sf).select("game_id", "sport", "game_date", F.col("prob_over").alias("prob"), F.col("result_over").alias("label"))


@query("e1_classification", _SC + f"SELECT sport, count(*) AS n, {s6(f'avg({_RIGHT})', 'accuracy')}, {s6(f'avg(-(label * ln({_CLIP}) + (1 - label) * ln(1 - {_CLIP})))', 'log_loss')}, {s6('avg(pow(prob - label, 2))', 'brier')}, {s6('avg(abs(prob - 0.5::DOUBLE))', 'mean_edge')}, {s6(f'avg(CASE WHEN {_CONF} >= 0.6::DOUBLE THEN {_RIGHT} END)', 'sure_accuracy')}, count(*) FILTER (WHERE {_CONF} >= 0.6::DOUBLE) AS sure_n FROM sc GROUP BY sport")
def e1(spark, sf):
    return rounded(metrics.classification(scored(spark, sf), ["sport"]))


@query("e2_auc", _SC + f"""SELECT sport, {s6('(sum(CASE WHEN label = 1 THEN rk END) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (CAST(sum(label) AS DOUBLE) * (count(*) - sum(label)))', 'auc')}
FROM (SELECT *, rank() OVER (PARTITION BY sport ORDER BY prob) + (count(*) OVER (PARTITION BY sport, prob) - 1) / 2.0::DOUBLE AS rk FROM sc) GROUP BY sport""")
def e2(spark, sf):
    return rounded(metrics.auc(scored(spark, sf), ["sport"]))


@query("e3_lift", _SC + f"SELECT sport, {s6(f'(avg({_RIGHT}) - 0.5::DOUBLE) / 0.5::DOUBLE * 100', 'lift')} FROM sc GROUP BY sport")
def e3(spark, sf):
    return rounded(metrics.classification(scored(spark, sf), ["sport"]).select("sport", metrics.lift(F.col("accuracy")).alias("lift")))


@query("e4_flat_bets", _BETS + f"SELECT game_id, won, {s6('flat_pnl', 'flat_pnl')} FROM b")
def e4(spark, sf):
    return rounded(metrics.bets(scored(spark, sf)).select("game_id", "won", "flat_pnl"))


@query("e5_kelly", _BETS + f"SELECT game_id, {s6('kelly_stake', 'kelly_stake')}, {s6('kelly_pnl', 'kelly_pnl')} FROM b")
def e5(spark, sf):
    return rounded(metrics.bets(scored(spark, sf)).select("game_id", "kelly_stake", "kelly_pnl"))


_RET = "round(sum(flat_pnl), 3) + 0.0 AS flat_total, round(sum(kelly_pnl), 3) + 0.0 AS kelly_total"


@query("e6_roi", _BETS + f"SELECT sport, count(*) AS bets, {_RET}, {s6('sum(flat_pnl) / (count(*) * 100)', 'roi_flat')}, {s6('sum(kelly_pnl) / (count(*) * 100)', 'roi_kelly')} FROM b WHERE confidence >= 0.2::DOUBLE GROUP BY sport")
def e6(spark, sf):
    out = metrics.returns(metrics.bets(scored(spark, sf)), ["sport"], 0.2)
    three = lambda c: (F.round(c, 3) + F.lit(0.0)).alias(c)
    return rounded(out.select("sport", "bets", three("flat_total"), three("kelly_total"), "roi_flat", "roi_kelly"))


@query("e7_sharpe", _BETS + f"SELECT sport, {s6('CASE WHEN count(*) < 2 OR stddev_samp(flat_pnl) < 1e-10 THEN 0 ELSE avg(flat_pnl) / stddev_samp(flat_pnl) * sqrt(252) END', 'sharpe')} FROM b GROUP BY sport")
def e7(spark, sf):
    return rounded(metrics.returns(metrics.bets(scored(spark, sf)), ["sport"]).select("sport", "sharpe"))


# whole dollars keep prefix sums exact in any order
_UNIT = _SC + ", b AS (SELECT *, CASE WHEN (prob >= 0.5::DOUBLE) = (label = 1) THEN 91.0::DOUBLE ELSE -100.0::DOUBLE END AS pnl FROM sc), c AS (SELECT *, sum(pnl) OVER (PARTITION BY sport ORDER BY game_date, game_id) AS cumulative FROM b), d AS (SELECT *, max(cumulative) OVER (PARTITION BY sport ORDER BY game_date, game_id) AS peak FROM c)\n"


def _unit(spark, sf):
    return metrics.bets(scored(spark, sf)).withColumn("flat_pnl", F.when(F.col("won"), 91.0).otherwise(-100.0))


@query("e8_max_drawdown", _UNIT + f"SELECT sport, {s6('max((peak - cumulative) / (abs(peak) + 1e-9::DOUBLE))', 'max_drawdown')} FROM d GROUP BY sport")
def e8(spark, sf):
    return rounded(metrics.max_drawdown(_unit(spark, sf), ["sport"]))


@query("w15_equity", _UNIT + "SELECT game_id, cumulative, peak, round((peak - cumulative) / (abs(peak) + 1e-9::DOUBLE), 6) + 0.0 AS drawdown FROM d")
def w15(spark, sf):
    return rounded(metrics.equity(_unit(spark, sf), ["sport"]).select("game_id", "cumulative", "peak", "drawdown"))


_EDGES = ", ".join(f"{e!r}::DOUBLE" for e in metrics.EDGES[1:])


@query("e9_calibration", _SC + f""", k AS (SELECT *, least(9, len(list_filter([{_EDGES}], lambda e: e <= prob))) AS bin FROM sc), a AS (SELECT sport, bin, round(avg(prob), 4) AS mean_prob, round(avg(label), 4) AS over_rate, count(*) AS n FROM k GROUP BY sport, bin)
SELECT s.sport, CAST(r.bin AS INT) AS bin, mean_prob, over_rate, coalesce(n, 0) AS n FROM (SELECT DISTINCT sport FROM sc) s CROSS JOIN (SELECT unnest(range(10)) AS bin) r LEFT JOIN a ON a.sport = s.sport AND a.bin = r.bin""")
def e9(spark, sf):
    return metrics.calibration(scored(spark, sf), ["sport"])


@query("e10_settle", f"{P}, {_SETTLED} SELECT prediction_id, actual, \"close\", over, is_correct, clv, is_push FROM s")
def e10(spark, sf):
    return settled(spark, sf).select("prediction_id", "actual", "close", "over", "is_correct", (F.col("clv") + F.lit(0.0)).alias("clv"), "is_push")


@query("e11_auto_settle", f"{P}SELECT prediction_id, game_id, total > total_line AS over, (total > total_line) = (prob_over >= 0.5::DOUBLE) AS is_correct, 0.0::DOUBLE AS clv FROM predictions WHERE NOT is_settled")
def e11(spark, sf):
    return settle.auto_settle(adapt.predictions(spark, sf).where("NOT is_settled"), adapt.games(spark, sf))


_ALERTS = "2 * abs(prob_over - 0.5::DOUBLE) >= 0.65::DOUBLE"


@query("e12_alerts", f"""{P}SELECT prediction_id, upper(sport) AS sport, home_team, away_team, CASE WHEN prob_over >= 0.5::DOUBLE THEN 'over' ELSE 'under' END AS direction, round(prob_over, 4) AS prob_over, round(2 * abs(prob_over - 0.5::DOUBLE), 4) AS confidence, total_line,
printf('%s %s @ %s: %s %.1f (%.1f%%)', upper(sport), CAST(away_team AS VARCHAR), CAST(home_team AS VARCHAR), CASE WHEN prob_over >= 0.5::DOUBLE THEN 'OVER' ELSE 'UNDER' END, total_line, 200 * abs(prob_over - 0.5::DOUBLE)) AS message, false AS fired FROM predictions WHERE {_ALERTS}""")
def e12(spark, sf):
    return settle.alerts(adapt.predictions(spark, sf))


@query("e13_unfired", f"{P}SELECT prediction_id FROM predictions WHERE {_ALERTS} AND prediction_id % 2 = 1")
def e13(spark, sf):
    return settle.unfired(settle.alerts(adapt.predictions(spark, sf)).withColumn("fired", F.col("prediction_id") % 2 == 0)).select("prediction_id")


# ------------------------------------------------------------------ drift
_FEATURES = ["home_score", "away_score", "total", "total_line"]
_LONG = G + f", flagged AS (SELECT *, season >= 1997 AS cur FROM games), lng AS (SELECT cur, unnest({_FEATURES!r}) AS feature, unnest([{', '.join(f'CAST({f} AS DOUBLE)' for f in _FEATURES)}]) AS value FROM flagged)"
_PSI = """, ed AS (SELECT feature, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM lng WHERE NOT cur GROUP BY feature),
bn AS (SELECT feature, len(list_filter(edges, lambda e: e <= value)) AS bin, count(*) FILTER (WHERE cur) AS c, count(*) FILTER (WHERE NOT cur) AS r FROM lng JOIN ed USING (feature) GROUP BY 1, 2),
fl AS (SELECT ed.feature, k.bin, coalesce(c, 0) AS c, coalesce(r, 0) AS r FROM ed CROSS JOIN (SELECT unnest(range(10)) AS bin) k LEFT JOIN bn ON bn.feature = ed.feature AND bn.bin = k.bin),
sh AS (SELECT feature, CASE WHEN c = 0 THEN 1e-4::DOUBLE ELSE c / CAST(sum(c) OVER (PARTITION BY feature) AS DOUBLE) END AS pc, CASE WHEN r = 0 THEN 1e-4::DOUBLE ELSE r / CAST(sum(r) OVER (PARTITION BY feature) AS DOUBLE) END AS pr FROM fl),
psi AS (SELECT feature, sum((pc - pr) * ln(pc / pr)) AS psi FROM sh GROUP BY feature)"""
_KS = """, pv AS (SELECT feature, value, count(*) FILTER (WHERE cur) AS c, count(*) FILTER (WHERE NOT cur) AS r FROM lng GROUP BY 1, 2),
gp AS (SELECT feature, abs(sum(c) OVER w / CAST(sum(c) OVER (PARTITION BY feature) AS DOUBLE) - sum(r) OVER w / CAST(sum(r) OVER (PARTITION BY feature) AS DOUBLE)) AS gap FROM pv WINDOW w AS (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ks AS (SELECT feature, max(gap) AS ks_stat FROM gp GROUP BY feature)"""


def _drift_rows(spark, sf):
    return drift.long_form(adapt.games(spark, sf).withColumn("current", F.col("season") >= 1997), _FEATURES)


@query("d1_psi", _LONG + _PSI + f" SELECT feature, {s6('psi', 'psi')} FROM psi")
def d1(spark, sf):
    return rounded(drift.psi(_drift_rows(spark, sf)))


@query("d2_ks", _LONG + _KS + f" SELECT feature, {s6('ks_stat', 'ks_stat')} FROM ks")
def d2(spark, sf):
    return rounded(drift.ks(_drift_rows(spark, sf)).select("feature", "ks_stat"))


@query("d3_detect", _LONG + _PSI + _KS + f" SELECT feature, {s6('psi', 'psi')}, {s6('ks_stat', 'ks_stat')}, psi >= 0.25::DOUBLE AS drifted, CASE WHEN psi < 0.1::DOUBLE THEN 'none' WHEN psi < 0.25::DOUBLE THEN 'minor' ELSE 'major' END AS severity FROM psi JOIN ks USING (feature)")
def d3(spark, sf):
    return rounded(drift.detect(store.stored(_drift_rows(spark, sf))).drop("ks_pvalue"))


_AS_OF = "TIMESTAMP '1998-06-01'"
_WINDOWED = _LONG.replace("season >= 1997 AS cur FROM games", f"game_date >= {_AS_OF} - INTERVAL 30 DAY AS cur FROM games WHERE game_date >= {_AS_OF} - INTERVAL 210 DAY")


@query("d4_window_drift", _WINDOWED + _PSI + f" SELECT feature, {s6('psi', 'psi')} FROM psi")
def d4(spark, sf):
    g = drift.window_flag(adapt.games(spark, sf), "game_date", F.expr("TIMESTAMP_NTZ'1998-06-01 00:00:00'"))
    return rounded(drift.psi(drift.long_form(g, _FEATURES)))


_RECENT = G + f", ps AS (SELECT *, row_number() OVER (PARTITION BY sport ORDER BY game_date, game_id) - 1 AS i, count(*) OVER (PARTITION BY sport) AS n FROM games), flagged AS (SELECT *, i >= greatest(100, n - 300) AS cur FROM ps), each AS (SELECT cur, sport, unnest({_FEATURES!r}) AS feature, unnest([{', '.join(f'CAST({f} AS DOUBLE)' for f in _FEATURES)}]) AS value FROM flagged), lng AS (SELECT cur, concat(sport, '/', feature) AS feature, value FROM each)"


@query("d5_recent_drift", _RECENT + _PSI + f" SELECT feature, {s6('psi', 'psi')}, CASE WHEN psi < 0.1::DOUBLE THEN 'none' WHEN psi < 0.25::DOUBLE THEN 'minor' ELSE 'major' END AS severity FROM psi")
def d5(spark, sf):
    """Every sport's last 300 games against those before, by sport and feature."""
    from ..operators.rolling import recent_split

    g = recent_split(adapt.games(spark, sf), ["sport"], 300).withColumnRenamed("recent", "current")
    rows = _united(drift.long_form(g.where(F.col("sport") == s), _FEATURES).withColumn("feature", F.concat(F.lit(f"{s}/"), "feature")) for s in SPORTS)
    return rounded(drift.psi(rows).select("feature", "psi", drift.severity(F.col("psi")).alias("severity")))


@query("d6_retrain_decision", f"{G}, r AS (SELECT sport, bool_or(total > 340) AS drifted FROM games GROUP BY sport) SELECT sport, CASE WHEN sport = 'mlb' OR drifted THEN 'train' ELSE 'keep' END AS action, CASE WHEN sport = 'mlb' THEN 'no_model' WHEN drifted THEN 'drift_psi' END AS reason FROM r")
def d6(spark, sf):
    g = adapt.games(spark, sf)
    return drift.decision(g.select("sport", (F.col("total") > 340).alias("drifted")), g.select("sport").distinct().withColumn("trained", F.col("sport") != "mlb"))


# ------------------------------------------------------------------ monitoring
@query("g10_live_accuracy", f"{P}, {_SETTLED} SELECT model_version, sport, count(is_correct) AS settled, count(*) FILTER (WHERE is_correct) AS correct, {s6('avg(CAST(is_correct AS INT))', 'accuracy')} FROM s GROUP BY model_version, sport")
def g10(spark, sf):
    return rounded(monitor.live_accuracy(settled(spark, sf)))


@query("g11_update_summary", f"{G}SELECT count(*) AS found, count(*) FILTER (WHERE game_id % 3 = 0) AS added, count(*) FILTER (WHERE game_id % 3 <> 0) AS skipped FROM games WHERE game_id % 3 = 0 OR game_id % 10 = 0")
def g11(spark, sf):
    g = adapt.games(spark, sf)
    return tables.append_summary(g.where("game_id % 3 <> 0"), g.where("game_id % 3 = 0 OR game_id % 10 = 0"))


_RUNS = G + ", runs AS (SELECT sport, concat(sport, '_', season) AS version, max(game_date) AS trained_at, CASE WHEN season % 2 = 0 THEN 'drift_psi' ELSE 'new_games' END AS reason FROM games WHERE season < 1998 GROUP BY sport, season), lat AS (SELECT sport, max(trained_at) AS trained_at, max_by(version, trained_at) AS version, count(*) AS n FROM runs GROUP BY sport)\n"


def runs(spark, sf):
    g = adapt.games(spark, sf).where("season < 1998")
    return g.groupBy("sport", "season").agg(F.max("game_date").alias("trained_at")).select("sport", F.concat("sport", F.lit("_"), F.col("season").cast("string")).alias("version"), "trained_at", F.when(F.col("season") % 2 == 0, "drift_psi").otherwise("new_games").alias("reason"))


@query("g12_since_retrain", _RUNS + "SELECT sport, count(*) FILTER (WHERE game_date > trained_at) AS new_games, count(*) FILTER (WHERE game_date > trained_at) >= 30 AS retrain FROM lat JOIN games USING (sport) GROUP BY sport")
def g12(spark, sf):
    return monitor.since_retrain(adapt.games(spark, sf), monitor.latest_model(runs(spark, sf)))


@query("g13_medians", f"{G}SELECT sport, " + ", ".join(s6(f"quantile_cont(CAST({f} AS DOUBLE), 0.5)", f) for f in _FEATURES) + " FROM games GROUP BY sport")
def g13(spark, sf):
    return rounded(monitor.medians(adapt.games(spark, sf), _FEATURES, ["sport"]))


@query("g14_profile", f"{G}SELECT sport, count(*) AS games, {s6('avg(result_over)', 'over_rate')}, {s6('avg(total)', 'mean_total')} FROM games GROUP BY sport")
def g14(spark, sf):
    return rounded(monitor.profile(adapt.games(spark, sf)))


@query("g15_log_rollup", f"{P}, d AS (SELECT sport, CASE WHEN prob_over >= 0.5::DOUBLE THEN 'over' ELSE 'under' END AS direction FROM predictions) SELECT sport, direction, count(*) AS predictions FROM d GROUP BY ROLLUP (sport, direction)")
def g15(spark, sf):
    return monitor.log_rollup(adapt.predictions(spark, sf))


@query("g15_last_day", f"{P}SELECT count(*) AS predictions FROM predictions WHERE game_date >= (SELECT max(game_date) FROM predictions) - INTERVAL 1 DAY")
def g15_day(spark, sf):
    p = adapt.predictions(spark, sf)
    last = F.broadcast(p.agg(F.max("game_date").alias("last")))  # one row
    return p.join(last, F.col("game_date") >= F.col("last") - F.expr("INTERVAL 1 DAY")).agg(F.count("*").alias("predictions"))


@query("g16_percentiles", f"{P}SELECT sport, " + ", ".join([s6(f"quantile_cont(2 * abs(prob_over - 0.5::DOUBLE), {q})", f"confidence_p{int(q * 100)}") for q in (0.5, 0.75, 0.9)] + [s6(f"quantile_cont(prob_over, {q})", f"prob_p{int(q * 100)}") for q in (0.25, 0.5, 0.75)]) + " FROM predictions GROUP BY sport")
def g16(spark, sf):
    return rounded(monitor.percentiles(adapt.predictions(spark, sf)))


_BK = [0.1 * k for k in range(1, 11)]


@query("g16_bucket_quantile", f"""{P}, v AS (SELECT sport, len(list_filter([{', '.join(f'{e!r}::DOUBLE' for e in _BK)}], lambda e: e < 2 * abs(prob_over - 0.5::DOUBLE))) AS b FROM predictions), c AS (SELECT sport, b, count(*) AS n FROM v GROUP BY 1, 2),
u AS (SELECT *, sum(n) OVER (PARTITION BY sport ORDER BY b) AS upto, 0.9::DOUBLE * sum(n) OVER (PARTITION BY sport) AS rk FROM c), f AS (SELECT sport, min_by(ed[b + 1] + (ed2[b + 1] - ed[b + 1]) * (rk - (upto - n)) / n, b) AS q FROM (SELECT *, [0.0::DOUBLE, {', '.join(f'{e!r}::DOUBLE' for e in _BK)}] AS ed, [{', '.join(f'{e!r}::DOUBLE' for e in [*_BK, _BK[-1]])}] AS ed2 FROM u WHERE upto >= rk) GROUP BY sport)
SELECT sport, {s6('q', 'quantile')} FROM f""")
def g16_bucket(spark, sf):
    p = adapt.predictions(spark, sf).select("sport", confidence(F.col("prob_over")).alias("c"))
    return rounded(monitor.bucket_quantile(p, ["sport"], "c", _BK, 0.9))


@query("g17_request_rate", f"SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, count(*) AS requests, {s6('quantile_cont(value, 0.95)', 'p95')} FROM events GROUP BY 1")
def g17(spark, sf):
    return rounded(monitor.request_rate(adapt.table(spark, sf, "events").select("ts", F.col("value").alias("latency"))))


@query("g17_rate_rollup", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS requests, true AS within FROM events GROUP BY 1")
def g17_rollup(spark, sf):
    """Hours out of five-minute sketches; within: the share of requests up to the sketch's p95 is within 1 % of 95 %, or at its own neighbours."""
    log = adapt.table(spark, sf, "events").select("ts", F.col("value").alias("latency"))
    hours = monitor.roll_up(monitor.latency_sketches(log))
    rows = log.select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start"), "latency")
    each = rows.join(hours.select(F.col("start").cast("timestamp_ntz").alias("start"), "requests", "p95"), "start").groupBy("start", "requests")
    upto, below = F.count_if(F.col("latency") <= F.col("p95")) / F.count("*"), F.count_if(F.col("latency") < F.col("p95")) / F.count("*")
    slack = F.lit(0.01) + 1 / F.count("*")
    return each.agg(((upto >= 0.95 - slack) & (below <= 0.95 + slack)).alias("within")).select("start", "requests", "within")


@query("g18_retrains_per_day", _RUNS + "SELECT CAST(trained_at AS DATE) AS day, sport, reason, count(*) AS retrains FROM runs GROUP BY 1, 2, 3")
def g18(spark, sf):
    return monitor.retrains_per_day(runs(spark, sf))


@query("g19_dashboard", f"{P}, {_SETTLED}, n AS (SELECT * FROM s ORDER BY game_date DESC, prediction_id DESC LIMIT 1000) SELECT count(*) AS predictions, {s6('avg(CAST(is_correct AS INT)) * 100', 'accuracy_pct')}, {s6('avg(clv)', 'mean_clv')}, count(*) FILTER (WHERE {_ALERTS}) AS alerts FROM n")
def g19(spark, sf):
    return rounded(monitor.dashboard(settled(spark, sf)))


@query("g20_latest_model", _RUNS + "SELECT sport, version, trained_at FROM lat")
def g20(spark, sf):
    return monitor.latest_model(runs(spark, sf))


@query("g21_latest_psi", f"{G}, r AS (SELECT sport, 'total' AS feature, game_date AS check_ts, CAST(max(total) AS DOUBLE) AS psi FROM games GROUP BY 1, 3) SELECT sport, feature, max_by(psi, check_ts) AS psi FROM r GROUP BY 1, 2")
def g21(spark, sf):
    r = adapt.games(spark, sf).groupBy("sport", F.col("game_date").alias("check_ts")).agg(F.max("total").cast("double").alias("psi")).withColumn("feature", F.lit("total"))
    return monitor.latest_psi(r)


@query("g22_training_status", _RUNS + ", g AS (SELECT sport, count(*) AS games, max(game_date) AS last_game FROM games GROUP BY sport) SELECT g.sport, any_value(g.games) AS games, any_value(last_game) AS last_game, any_value(version) AS version, any_value(lat.n) AS runs, count(*) FILTER (WHERE game_date > trained_at) AS added FROM g JOIN lat USING (sport) JOIN games USING (sport) GROUP BY g.sport")
def g22(spark, sf):
    return monitor.training_status(adapt.games(spark, sf), runs(spark, sf))


@query("s1_recent_predictions", f"{P}SELECT prediction_id, sport, game_date FROM predictions WHERE sport = 'nba' ORDER BY game_date DESC, prediction_id DESC LIMIT 50")
def s1(spark, sf):
    return adapt.predictions(spark, sf).where("sport = 'nba'").orderBy(F.desc("game_date"), F.desc("prediction_id")).limit(50).select("prediction_id", "sport", "game_date")


@query("s2_top_features", _LONG + f", v AS (SELECT feature, abs(corr(value, CAST(cur AS INT))) AS importance FROM lng GROUP BY feature) SELECT feature, {s6('importance', 'importance')} FROM v ORDER BY importance DESC, feature LIMIT 20")
def s2(spark, sf):
    v = _drift_rows(spark, sf).groupBy("feature").agg(F.abs(F.corr("value", F.col("current").cast("double"))).alias("importance"))
    return rounded(monitor.top_features(v, 20))


@query("s2_top_importance")
def s2_importance(spark, sf):
    """The features that each sport's model leans on most, by its own importances."""
    from . import q_models

    return _united(monitor.top_features(training.importance(m.model, m.features, q_models.SETTINGS), 20).withColumn("sport", F.lit(sport)) for sport, _, m in q_models._models(spark, sf))


@query("s3_top_variance", _LONG + f", v AS (SELECT feature, var_samp(value) AS variance FROM lng WHERE NOT cur GROUP BY feature) SELECT feature, {s6('variance', 'variance')} FROM v ORDER BY variance DESC, feature LIMIT 3")
def s3(spark, sf):
    v = _drift_rows(spark, sf).where("NOT current").groupBy("feature").agg(F.var_samp("value").alias("variance"))
    return rounded(v.orderBy(F.desc("variance"), "feature").limit(3))


@query("s5_versions", _RUNS + "SELECT sport, version, trained_at FROM runs ORDER BY trained_at DESC, sport")
def s5(spark, sf):
    return runs(spark, sf).select("sport", "version", "trained_at").orderBy(F.desc("trained_at"), "sport")
