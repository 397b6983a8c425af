"""Known values, boundaries and invariants of the operators."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from scoreline.functions import scalars as S
from scoreline.operators import composites, drift, injuries, lines, matchup, metrics, monitor, rolling, runs, schedule, settle, training
from scoreline.plans import backtest, features
from scoreline.sources import store, tables

GAME = "game_id long, sport string, season int, game_date timestamp_ntz, home_team string, away_team string, home_score long, away_score long, total long, total_line double, result_over int"


def games(spark, rows):
    """rows: (id, day, home, away, home score, away score[, line])."""
    out = []
    for i, day, h, a, hs, as_, *rest in rows:
        line = rest[0] if rest else 100.5
        out.append((i, "nba", 2024, datetime(2024, 1, day), h, a, hs, as_, hs + as_, line, int(hs + as_ > line)))
    return spark.createDataFrame(out, GAME)


def one(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("game_id").collect()]


def test_parsing(spark):
    df = spark.createDataFrame([("42 ", "3.5", "45.5%", "30:15", "7-13", "NW 12 mph"), ("x", None, "dnp", "late", "7-0", "8 to left"), ("-3", " 2 ", "1", "10:30", "a-b", "calm")], "a string, b string, c string, d string, e string, f string")
    c = F.col
    got = df.select(S.safe_int(c("a"), -1), S.safe_float(c("b"), -1.0), S.stat_clean(c("c")), S.clock_minutes(c("d")), F.round(S.fraction(c("e"), 0.5), 4), S.wind_mph(c("f"))).collect()
    assert [tuple(r) for r in got] == [(42, 3.5, 45.5, 30.25, 0.5385, 12.0), (-1, -1.0, 0.0, 30.0, 0.5, 8.0), (-3, 2.0, 1.0, 10.5, 0.5, 0.0)]
    assert df.select(S.safe_int(c("b"), 7)).first()[0] == 7  # '3.5' isn't whole


def test_injury_comments(spark):
    rows = [("DNP - Coach's Decision", "none"), ("Coach's Decision - knee", "none"), ("DND - Injury/Illness", "key"), ("Illness", "key"), ("NWT - Left Ankle", "injury"), (None, "none"), ("", "none")]
    df = spark.createDataFrame(rows, "c string, want string")
    assert all(r.k == r.want for r in df.select("want", S.injury_kind(F.col("c")).alias("k")).collect())


def test_rounding_is_to_even_and_clipped(spark):
    df = spark.createDataFrame([(100.25,), (100.75,), (10.0,), (400.0,)], "x double")
    assert [r[0] for r in df.select(S.half_points(F.col("x"), 28.0, 280.0)).collect()] == [100.0, 101.0, 28.0, 280.0]


def test_iso_time(spark):
    df = spark.createDataFrame([("2024-01-01T12:00:00Z",), ("2024-01-01T12:00:00",), ("2024-01-01T14:00:00+02:00",), ("soon",), (None,)], "s string")
    assert [r[0] for r in df.select(F.unix_seconds(S.iso_time(F.col("s")))).collect()] == [1704110400] * 3 + [None] * 2


def test_rolling_sees_only_earlier_games_of_its_side(spark):
    g = games(spark, [(1, 1, "A", "B", 10, 0), (2, 2, "B", "A", 7, 50), (3, 3, "A", "B", 20, 0), (4, 4, "A", "B", 40, 0)])
    out = one(rolling.rolling(g, ["score"], (3,), (0.5,)), "home_score_roll3_mean", "home_score_roll3_std", "home_score_ema5")
    assert out[0] == (None, 0.0, None) and out[1] == (None, 0.0, None)
    assert out[2] == (10.0, 0.0, 10.0)
    assert out[3][0] == 15.0 and out[3][1] == pytest.approx(7.0710678) and out[3][2] == 15.0


def test_no_feature_sees_its_own_or_a_later_game(spark):
    rows = [(i, 1 + i, "ABC"[i % 3], "ABC"[(i + 1) % 3], 40 + 3 * i, 50 + i * i % 17) for i in range(12)]
    changed = [r if r[0] != 6 else (*r[:4], 999, 0) for r in rows]
    build = lambda r: features.build_features(store.stored(games(spark, r)), "nba", ["score"])
    a, b = (build(r).drop("home_score", "away_score", "total", "result_over", "opp_def_score_ratio") for r in (rows, changed))
    first = lambda d: {r.game_id: r for r in d.where("game_id <= 6").collect()}
    assert first(a) == first(b)
    assert a.where("game_id > 6").exceptAll(b).count() > 0


def test_streaks(spark):
    g = games(spark, [(1, 1, "A", "B", 90, 20), (2, 2, "A", "B", 90, 20), (3, 3, "B", "A", 10, 10), (4, 4, "A", "B", 1, 2), (5, 5, "A", "B", 0, 0)])
    assert one(runs.win_streak(g), "home_win_streak", "away_win_streak") == [(0, 0), (1, -1), (-2, 2), (2, -2), (-1, 1)]
    assert one(runs.over_streak(g), "home_team_over_streak") == [(0,), (1,), (0,), (2,), (-1,)]


def test_schedule(spark):
    g = games(spark, [(1, 1, "A", "B", 1, 0), (2, 2, "A", "C", 1, 0), (3, 5, "B", "A", 1, 0), (4, 9, "A", "B", 1, 0)])
    assert one(schedule.rest_days(g), "home_rest_days", "home_back_to_back") == [(7.0, 0), (1.0, 1), (7.0, 0), (7.0, 0)]
    assert one(schedule.games_within(g), "home_games_7d") == [(0,), (1,), (0,), (1,)]
    assert one(schedule.density(g), "home_games_3d_all", "away_games_3d_all")[2] == (0, 1)
    assert one(schedule.season_progress(g), "season_progress") == [(0.0,), (0.125,), (0.5,), (1.0,)]
    places = spark.createDataFrame([("A", 0.0, 0.0), ("B", 0.0, 1.0)], "team string, lat double, lon double")
    km = one(schedule.travel(g, places), "home_travel_km", "away_travel_km")
    assert km[0] == (0.0, 0.0) and km[2][1] == pytest.approx(111.19, abs=0.01)


def test_head_to_head_needs_two_earlier_days(spark):
    g = games(spark, [(1, 1, "A", "B", 100, 20), (2, 1, "B", "A", 1, 1), (3, 2, "A", "B", 0, 0)])
    assert one(matchup.head_to_head(g), "h2h_over_rate", "h2h_avg_total") == [(0.5, 100.5), (0.5, 100.5), (0.5, 61.0)]


def test_division_flag_of_unknown_teams(spark):
    g = games(spark, [(1, 1, "A", "B", 1, 0), (2, 1, "A", "X", 1, 0), (3, 1, "X", "Y", 1, 0)])
    d = spark.createDataFrame([("A", "east"), ("B", "east")], "team string, division string")
    assert one(matchup.division_flag(g, d), "is_division_game") == [(1,), (0,), (0,)]


def test_bets(spark):
    df = spark.createDataFrame([(1, 0.6, 1), (2, 0.6, 0), (3, 0.4, 0), (4, 0.99, 1), (5, 0.5, 1)], "game_id long, prob double, label int")
    out = one(metrics.bets(df), "flat_pnl", "kelly_stake")
    assert [round(x, 2) for x, _ in out] == [90.91, -100.0, 90.91, 90.91, 90.91]
    assert out[3][1] == 25.0 and out[4][1] == 0.0


def test_sharpe_and_auc_degenerate(spark):
    df = spark.createDataFrame([("a", 1, 0.6, 1), ("b", 2, 0.6, 1), ("b", 3, 0.7, 1)], "k string, game_id long, prob double, label int")
    assert {r.k: r.sharpe for r in metrics.returns(metrics.bets(df), ["k"]).collect()} == {"a": 0.0, "b": 0.0}
    assert {r.auc for r in metrics.auc(df, ["k"]).collect()} == {0.5}


def test_drawdown_starts_at_the_first_value(spark):
    rows = [("k", i, datetime(2024, 1, 1 + i // 2), p) for i, p in enumerate([100.0, -50.0, -50.0, 200.0])]
    b = spark.createDataFrame(rows, "k string, game_id long, game_date timestamp_ntz, flat_pnl double")
    assert metrics.max_drawdown(b, ["k"]).first().max_drawdown == pytest.approx(1.0)
    assert [r.cumulative for r in metrics.equity(b, ["k"]).orderBy("game_id").collect()] == [100.0, 50.0, 0.0, 200.0]


def test_calibration_bins(spark):
    df = spark.createDataFrame([("k", p, 1) for p in (0.0, 0.3, 0.30000000000000004, 0.95, 1.0)], "k string, prob double, label int")
    n = {r.bin: r.n for r in metrics.calibration(df, ["k"]).collect()}
    assert n == {0: 1, 1: 0, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0, 9: 2}


def test_psi_of_equal_and_shifted(spark):
    ref = [("f", float(i % 100), False) for i in range(1000)]
    rows = lambda cur: spark.createDataFrame(ref + cur, "feature string, value double, current boolean")
    same = drift.detect(rows([("f", float(i % 100), True) for i in range(500)])).first()
    moved = drift.detect(rows([("f", float(i % 100 + 60), True) for i in range(500)])).first()
    assert same.psi < 0.01 and same.severity == "none" and same.ks_pvalue > 0.9
    assert moved.psi > 0.25 and moved.drifted and moved.ks_pvalue < 0.01


def test_settlement(spark):
    open_ = spark.createDataFrame([(1, 10, 0.7, 100.0), (2, 11, 0.2, 100.0), (3, 12, 0.9, 100.0)], "prediction_id long, game_id long, prob_over double, bet_line double")
    results = spark.createDataFrame([(10, 105.0, 103.0), (11, 101.0, 101.0), (12, 1.0, None)], "game_id long, actual double, close double")
    got = [(r.prediction_id, r.is_correct, r.clv, r.is_push) for r in settle.settle(open_, results).orderBy("prediction_id").collect()]
    assert got == [(1, True, 3.0, False), (2, True, -1.0, True)]


def test_alert_threshold_is_inclusive(spark):
    p = spark.createDataFrame([(1, "nba", "A", "B", 0.875, 200.5), (2, "nba", "A", "B", 0.874, 200.5)], "prediction_id long, sport string, home_team string, away_team string, prob_over double, total_line double")
    got = settle.alerts(p, 0.75).collect()
    assert [r.prediction_id for r in got] == [1] and got[0].message == "NBA B @ A: OVER 200.5 (75.0%)"


def test_append_skips_known_games(spark):
    h = spark.createDataFrame([(1, "a"), (2, "b")], "game_id long, x string")
    b = spark.createDataFrame([(2, 5), (3, 6)], "game_id long, y int")
    assert sorted(map(tuple, tables.append(h, b).collect())) == [(1, "a", None), (2, "b", None), (3, None, 6)]
    assert tuple(tables.append_summary(h, b).first()) == (2, 1, 1)


def test_upsert_keeps_the_latest(spark):
    cols = "player_id long, sport string, status string, version int"
    a, b = spark.createDataFrame([(1, "nba", "out", 1), (2, "nba", "out", 3)], cols), spark.createDataFrame([(1, "nba", "active", 1), (2, "nba", "active", 2)], cols)
    assert {r.player_id: r.status for r in injuries.upsert(a, b, ["player_id", "sport"], "version").collect()} == {1: "active", 2: "out"}


def test_as_of_quote_age(spark):
    t = lambda m: datetime(2024, 1, 1, 0, m)
    q = spark.createDataFrame([("g", t(0), 1.0), ("g", t(10), 2.0)], "k string, at timestamp_ntz, line double")
    a = spark.createDataFrame([("g", t(10), 1), ("g", t(9), 2), ("g", t(26), 3), ("h", t(1), 4)], "k string, at timestamp_ntz, request_id long")
    assert {r.request_id: r.line for r in lines.latest_quote(a, q, ["k"]).collect()} == {1: 2.0, 2: 1.0, 3: None, 4: None}


def test_composites_without_inputs(spark):
    g = games(spark, [(1, 1, "A", "B", 1, 0)])
    out = composites.luck(composites.shooting_flags(composites.situational(g)), "nfl")
    assert one(out, "home_luck_factor", "home_hot_shooting") == [(0.0, 0.0)]
    assert "altitude_boost" not in out.columns


def test_bucket_quantile(spark):
    df = spark.createDataFrame([("k", v) for v in (0.5, 1.5, 1.5, 3.0)], "k string, v double")
    assert monitor.bucket_quantile(df, ["k"], "v", [1.0, 2.0], 0.5).first().quantile == 1.5
    assert monitor.bucket_quantile(df, ["k"], "v", [1.0, 2.0], 0.99).first().quantile == 2.0


def test_training_and_backtest(spark):
    rows = [(i, 1 + i % 28, "ABCD"[i % 4], "ABCD"[(i + 1) % 4], 40 + i % 30, 50 + i % 7, 85.5 + i % 5) for i in range(700)]
    g = store.stored(games(spark, rows).withColumn("game_date", F.col("game_date") + F.make_interval(days=F.col("game_id").cast("int"))).withColumn("x", F.col("game_id").cast("double") % 30))
    s = training.Settings(small_rounds=(2, 2), small_depths=(2, 2))
    done = training.train(g, ["x", "total_line"], s)
    m = done.metrics.first()
    assert done.rows == 700 and 0.5 < m.accuracy <= 1 and training.train(g.limit(100), ["x"], s) is None
    p = training.score(done.model, g, ["x", "total_line"], s)
    assert p.where("prob < 0 or prob > 1 or low > prob + 0.0001 or high < prob - 0.0001").count() == 0
    assert training.importance(done.model, ["x", "total_line"], s).agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    cal = training.calibrator(p.select("prob", F.col("result_over").alias("label")))
    c = [r.calibrated for r in cal.transform(p.select("prob")).orderBy("prob").collect()]
    assert c == sorted(c) and 0 <= c[0] and c[-1] <= 1
    b = backtest.run(g, ["x", "total_line"], 3, settings=s)
    assert b.status == "ok" and b.folds.count() == 2
    assert backtest.run(g.limit(50), ["x"], 3, settings=s).status == "insufficient_data"


def test_scores_are_calibrated_on_validation(spark):
    import numpy as np

    # x says little, so the blend of few rounds keeps near 1/2 while 9 of 10 validation games go over
    rows = [(i, float(i % 2), int(i % 10 != 0) if i >= 600 else i % 2, i >= 600) for i in range(900)]
    df = store.stored(spark.createDataFrame(rows, "game_id long, x double, result_over int, late boolean"))
    s = training.Settings(small_rounds=(1, 1), small_depths=(1, 1))
    late = df.where("late")
    model = training.fit(df.where("NOT late"), late, ["x"], 900, s)
    got = training.score(model, late, ["x"], s)
    mean = got.agg(F.avg("prob")).first()[0]
    assert mean == pytest.approx(0.9, abs=1e-6)  # an isotonic fit keeps the mean of its labels
    half = F.abs(F.col("prob_a") - F.col("prob_b")) / 2
    gap = got.select(F.col("low") - F.greatest(F.lit(0.0), F.col("prob") - half)).collect()
    assert np.abs([g[0] for g in gap]).max() < 1e-4


def test_quantiles_in_blocks_equal_those_of_one_sort(spark):
    import numpy as np

    from scoreline.operators import ranks

    rng = np.random.default_rng(3)
    by = {"ties": rng.integers(0, 7, 500).astype(float), "skewed": np.exp(rng.normal(size=900) * 4), "one": np.array([4.0]), None: rng.normal(size=50)}
    rows = [(k, float(v)) for k, vs in by.items() for v in vs] + [("none", None), ("one", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.quantiles for r in ranks.quantiles(df, ["k"], "v", [0.0, 0.1, 0.5, 0.9, 1.0]).collect()}
    assert got.pop("none") == [None] * 5
    assert set(got) == set(by)
    for k, vs in by.items():
        assert got[k] == pytest.approx(np.quantile(vs, [0, 0.1, 0.5, 0.9, 1]).tolist(), rel=1e-12)
    counts = df.where("v is not null").groupBy("k", "v").agg(F.count("*").alias("n"))
    for r in ranks.cumulative(counts, ["k"], "v", ["n"], blocks=4).collect():
        assert (r.n_upto, r.n_all) == ((by[r.k] <= r.v).sum(), len(by[r.k]))
    assert ranks.quantiles(df.limit(0), ["k"], "v", [0.5]).count() == 0


def test_drift_without_a_current_row_gives_no_statistic(spark):
    rows = spark.createDataFrame([("a", 1.0, False), ("a", 2.0, False)], "feature string, value double, current boolean")
    assert drift.ks(rows).count() == 0 and drift.psi(rows).count() == 0


def test_medians_count_only_values_near_them(spark, monkeypatch):
    import math

    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(k, float(a), int(b), None, float("nan") if i % 3 == 0 else float(a)) for k in ("x", None) for i, (a, b) in enumerate(zip(rng.normal(size=2001).round(4), rng.integers(0, 3, 2001), strict=True))]
    df = spark.createDataFrame([*rows, ("one", 2.0, None, None, 1.0)], "k string, `a b` double, c int, d double, e double")
    counted, quantiles = [], monitor.quantiles
    monkeypatch.setattr(monitor, "quantiles", lambda rows, *a: counted.append(rows) or quantiles(rows, *a))
    got = {r["k"]: r for r in monitor.medians(df, ["a b", "c", "d", "e"], ["k"]).collect()}
    for k in ("x", None):
        part = [r for r in rows if r[0] == k]
        assert got[k]["a b"] == pytest.approx(np.median([r[1] for r in part]), abs=1e-6) and got[k]["c"] == np.median([r[2] for r in part]) and got[k]["d"] is None
        assert got[k]["e"] == pytest.approx(sorted(r[4] if i % 3 else math.inf for i, r in enumerate(part))[1000], abs=1e-6)
    assert (got["one"]["a b"], got["one"]["c"]) == (2.0, None)
    near = counted[0].where("k = 'x' AND _feature = 0").select("_value").distinct().count()
    assert 2 <= near < 150  # of some 2,000 values
