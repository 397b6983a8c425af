"""Queries of the point-in-time features (windows and composites)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.keys import SIDES
from ..operators import composites, lines, matchup, rolling, runs, schedule
from ..sources import adapt, store
from . import features
from .base import G, T, query, r6, rounded, s6, s9
from .concurrent import each


def _side(side: str, frame: str, name: str = "w", order: str = "game_date, game_id") -> str:
    return f"WINDOW {name} AS (PARTITION BY sport, {side}_team ORDER BY {order} {frame})"


def _both(select: str, tail: str = "") -> str:
    """The same over home and away appearances, united as `app`."""
    return (
        "app AS (SELECT sport, game_id, game_date, 'home' AS side, home_team AS team, home_score AS scored, away_score AS allowed FROM games "
        "UNION ALL SELECT sport, game_id, game_date, 'away', away_team, away_score, home_score FROM games)" + select + tail)  # fmt: skip


ROLL_SQL = ", ".join(
    x for s in SIDES for n in rolling.WINDOWS for x in (
        s6(f"avg({s}_score) OVER {s[0]}{n}", f"{s}_score_roll{n}_mean"), s6(f"coalesce(stddev_samp({s}_score) OVER {s[0]}{n}, 0)", f"{s}_score_roll{n}_std"),
        f"max({s}_score) OVER {s[0]}{n} AS {s}_score_roll{n}_max", f"min({s}_score) OVER {s[0]}{n} AS {s}_score_roll{n}_min"))
ROLL_WINDOWS = "WINDOW " + ", ".join(f"{s[0]}{n} AS (PARTITION BY sport, {s}_team ORDER BY game_date, game_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for s in SIDES for n in rolling.WINDOWS)


@query("w1_rolling", f"{G}SELECT game_id, {ROLL_SQL} FROM games {ROLL_WINDOWS}")
def w1(spark, sf):
    df = rolling.rolling(adapt.games(spark, sf), ["score"], alphas=())
    return rounded(df.select("game_id", *(c for c in df.columns if "_roll" in c)))


@query("w1_rolling_long", f"""{G}, long AS (SELECT sport, game_id, game_date, 'home' AS side, home_team AS team, unnest(['score', 'plays']) AS stat, unnest([home_score, home_plays]) AS value FROM games
UNION ALL SELECT sport, game_id, game_date, 'away', away_team, unnest(['score', 'plays']), unnest([away_score, away_plays]) FROM games)
SELECT game_id, side, stat, 5 AS "window", {s6("avg(value) OVER w", "mean")}, {s6("coalesce(stddev_samp(value) OVER w, 0)", "std")}, CAST(max(value) OVER w AS DOUBLE) AS max, CAST(min(value) OVER w AS DOUBLE) AS min
FROM long WINDOW w AS (PARTITION BY sport, side, team, stat ORDER BY game_date, game_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
def w1_long(spark, sf):
    return rounded(rolling.rolling_long(adapt.games(spark, sf), ["score", "plays"], (5,)).drop("sport"))


def _ema_sql(a: str, c: str, side: str) -> str:
    l = f"list(CAST({c} AS DOUBLE)) OVER {side[0]}"  # noqa: E741
    return f"CASE WHEN count(*) OVER {side[0]} > 0 THEN list_reduce({l}, lambda y, x: {a}::DOUBLE * x + (1 - {a}::DOUBLE) * y) END"


@query("w2_ema", f"""{G}SELECT game_id, {", ".join(s6(_ema_sql(a, f"{s}_score", s), f"{s}_score_ema{n}") for s in SIDES for a, n in (("0.3", 3), ("0.5", 5)))}
FROM games WINDOW {", ".join(f"{s[0]} AS (PARTITION BY sport, {s}_team ORDER BY game_date, game_id ROWS BETWEEN 128 PRECEDING AND 1 PRECEDING)" for s in SIDES)}""")
def w2(spark, sf):
    g = adapt.games(spark, sf)
    for s in SIDES:
        g = rolling.exponential(g, s, ["score"])
    return g.select("game_id", *(r6(f"{s}_score_ema{int(a * 10)}", f"{s}_score_ema{int(a * 10)}") for s in SIDES for a in rolling.ALPHAS))


@query("w3_league_over_rate", f"{G}SELECT game_id, {s6('avg(result_over) OVER (PARTITION BY sport ORDER BY game_date, game_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)', 'league_over_rate')} FROM games")
def w3(spark, sf):
    return rounded(rolling.league_over_rate(adapt.games(spark, sf)).select("game_id", "league_over_rate"))


def _over_sql(s: str) -> str:
    return f"""{s}a AS (SELECT *, CASE WHEN result_over = lag(result_over) OVER w THEN 0 ELSE 1 END AS n FROM games {_side(s, "")}),
{s}b AS (SELECT *, sum(n) OVER (PARTITION BY sport, {s}_team ORDER BY game_date, game_id) AS run FROM {s}a),
{s}c AS (SELECT *, (CASE WHEN result_over = 1 THEN 1 ELSE -1 END) * row_number() OVER (PARTITION BY sport, {s}_team, run ORDER BY game_date, game_id) AS signed FROM {s}b),
{s}d AS (SELECT game_id, CAST(coalesce(lag(signed) OVER w, 0) AS INT) AS {s}_team_over_streak FROM {s}c {_side(s, "")})"""


@query("w4_over_streak", f"{G}, {_over_sql('home')}, {_over_sql('away')} SELECT * FROM homed JOIN awayd USING (game_id)")
def w4(spark, sf):
    return runs.over_streak(adapt.games(spark, sf)).select("game_id", "home_team_over_streak", "away_team_over_streak")


@query("w5_win_streak", f"""{G}, {_both("")}, d AS (SELECT *, CASE WHEN scored > allowed THEN 1 ELSE 0 END AS won FROM app WHERE scored <> allowed),
e AS (SELECT *, CASE WHEN won = lag(won) OVER (PARTITION BY sport, team ORDER BY game_date, game_id) THEN 0 ELSE 1 END AS n FROM d),
f AS (SELECT *, sum(n) OVER (PARTITION BY sport, team ORDER BY game_date, game_id) AS run FROM e),
h AS (SELECT *, (CASE WHEN won = 1 THEN 1 ELSE -1 END) * row_number() OVER (PARTITION BY sport, team, run ORDER BY game_date, game_id) AS after FROM f),
i AS (SELECT app.game_id, app.side, coalesce(last_value(h.after IGNORE NULLS) OVER (PARTITION BY app.sport, app.team ORDER BY app.game_date, app.game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM app LEFT JOIN h ON app.game_id = h.game_id AND app.side = h.side)
SELECT game_id, CAST(max(CASE WHEN side = 'home' THEN s END) AS INT) AS home_win_streak, CAST(max(CASE WHEN side = 'away' THEN s END) AS INT) AS away_win_streak,
CAST(max(CASE WHEN side = 'home' THEN s END) - max(CASE WHEN side = 'away' THEN s END) AS INT) AS win_streak_diff FROM i GROUP BY game_id""")
def w5(spark, sf):
    return runs.win_streak(adapt.games(spark, sf)).select("game_id", "home_win_streak", "away_win_streak", "win_streak_diff")


def _rest_sql(s: str) -> str:
    gap = f"CAST(floor(({T} - lag({T}) OVER {s[0]}) / 86400.0) AS BIGINT)"
    return f"CAST(coalesce({gap}, 7) AS DOUBLE) AS {s}_rest_days, CASE WHEN {gap} <= 1 THEN 1 ELSE 0 END AS {s}_back_to_back"


_SIDES_W = "WINDOW h AS (PARTITION BY sport, home_team ORDER BY game_date, game_id), a AS (PARTITION BY sport, away_team ORDER BY game_date, game_id)"


@query("w6_rest_days", f"{G}, r AS (SELECT game_id, {_rest_sql('home')}, {_rest_sql('away')} FROM games {_SIDES_W}) SELECT *, home_rest_days - away_rest_days AS home_rest_advantage, 1 AS home_advantage FROM r")
def w6(spark, sf):
    return schedule.rest_days(adapt.games(spark, sf)).select("game_id", *(f"{s}_{c}" for s in SIDES for c in ("rest_days", "back_to_back")), "home_rest_advantage", "home_advantage")


@query("w7_games_within", f"""{G}, t AS (SELECT *, {T} AS t FROM games) SELECT game_id, {", ".join(f"count(*) OVER (PARTITION BY sport, {s}_team ORDER BY t RANGE BETWEEN {d * 86400} PRECEDING AND 1 PRECEDING) AS {s}_games_{d}d" for s in SIDES for d in (7, 14))} FROM t""")
def w7(spark, sf):
    return schedule.games_within(adapt.games(spark, sf)).select("game_id", *(f"{s}_games_{d}d" for s in SIDES for d in (7, 14)))


@query("w8_density", f"""{G}, {_both("")}, t AS (SELECT *, {T} AS t FROM app), d AS (SELECT game_id, side, {", ".join(f"count(*) OVER (PARTITION BY sport, team ORDER BY t RANGE BETWEEN {(d + 1) * 86400 - 1} PRECEDING AND 1 PRECEDING) AS d{d}" for d in (3, 5))} FROM t),
p AS (SELECT game_id, {", ".join(f"max(CASE WHEN side = '{s}' THEN d{d} END) AS {s}_games_{d}d_all" for d in (3, 5) for s in SIDES)} FROM d GROUP BY game_id)
SELECT *, home_games_3d_all - away_games_3d_all AS density_diff_3d, home_games_5d_all - away_games_5d_all AS density_diff_5d FROM p""")
def w8(spark, sf):
    return schedule.density(adapt.games(spark, sf)).select("game_id", *(f"{s}_games_{d}d_all" for d in (3, 5) for s in SIDES), "density_diff_3d", "density_diff_5d")


@query("w9_head_to_head", f"""{G}, t AS (SELECT *, {T} AS t FROM games) SELECT game_id, {s6("CASE WHEN count(*) OVER w >= 2 THEN avg(result_over) OVER w ELSE 0.5 END", "h2h_over_rate")}, {s6("CASE WHEN count(*) OVER w >= 2 THEN avg(total) OVER w ELSE total_line END", "h2h_avg_total")}
FROM t WINDOW w AS (PARTITION BY sport, least(home_team, away_team), greatest(home_team, away_team) ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def w9(spark, sf):
    return rounded(matchup.head_to_head(adapt.games(spark, sf)).select("game_id", "h2h_over_rate", "h2h_avg_total"))


@query("w10_allowed_ratio", f"""{G}, l AS (SELECT sport, (sum(home_score) + sum(away_score)) / (count(home_score) + count(away_score)) AS m FROM games GROUP BY sport)
SELECT game_id, {s6("avg(away_score) OVER w / coalesce(nullif(m, 0), 1)", "opp_def_score_ratio")} FROM games JOIN l USING (sport) {_side("home", "ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING")}""")
def w10(spark, sf):
    return rounded(matchup.allowed_ratio(adapt.games(spark, sf), ["score"]).select("game_id", "opp_def_score_ratio"))


@query("w11_season_progress", f"""{G}, b AS (SELECT sport, season, min({T}) AS lo, max({T}) AS hi FROM games GROUP BY sport, season) SELECT game_id, {s6(f"({T} - lo) / CAST(greatest(hi - lo, 1) AS DOUBLE)", "season_progress")} FROM games JOIN b USING (sport, season)""")
def w11(spark, sf):
    return rounded(schedule.season_progress(adapt.games(spark, sf)).select("game_id", "season_progress"))


@query("w12_team_over_rate", f"{G}SELECT game_id, {s6('avg(result_over) OVER w', 'team_over_rate')} FROM games {_side('home', 'ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING')}")
def w12(spark, sf):
    return rounded(rolling.team_over_rate(adapt.games(spark, sf)).select("game_id", "team_over_rate"))


def venues(spark, sf):
    n = F.col("n_nationkey")
    return adapt.table(spark, sf, "nation").select(n.cast("long").alias("team"), (n * 7 % 90).cast("double").alias("lat"), (n * 13 % 180).cast("double").alias("lon"))


_H = "pow(sin((radians(lat) - radians(plat)) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(plon)) / 2), 2)"


@query("w13_travel", f"""{G}, {_both("")}, v AS (SELECT CAST(n_nationkey AS BIGINT) AS host, CAST(n_nationkey * 7 % 90 AS DOUBLE) AS lat, CAST(n_nationkey * 13 % 180 AS DOUBLE) AS lon FROM nation),
j AS (SELECT app.*, lat, lon FROM app JOIN games USING (game_id) LEFT JOIN v ON games.home_team = v.host),
l AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM j WINDOW w AS (PARTITION BY sport, team ORDER BY game_date, game_id)),
k AS (SELECT game_id, side, coalesce(2 * 6371 * asin(sqrt({_H})), 0) AS km FROM l)
SELECT game_id, round(max(CASE WHEN side = 'home' THEN km END), 3) + 0.0 AS home_travel_km, round(max(CASE WHEN side = 'away' THEN km END), 3) + 0.0 AS away_travel_km FROM k GROUP BY game_id""")
def w13(spark, sf):
    out = schedule.travel(adapt.games(spark, sf), venues(spark, sf))
    return out.select("game_id", *((F.round(f"{s}_travel_km", 3) + F.lit(0.0)).alias(f"{s}_travel_km") for s in SIDES))


@query("w14_proxy_line", f"""{G}, {_both("")}, f AS (SELECT game_id, side, coalesce(avg(scored) OVER w, 50) AS o, coalesce(avg(allowed) OVER w, 48) AS d FROM app WINDOW w AS (PARTITION BY sport, team ORDER BY game_date, game_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
b AS (SELECT game_id, max(CASE WHEN side = 'home' THEN o END) AS ho, max(CASE WHEN side = 'home' THEN d END) AS hd, max(CASE WHEN side = 'away' THEN o END) AS ao, max(CASE WHEN side = 'away' THEN d END) AS ad FROM f GROUP BY game_id),
p AS (SELECT game_id, total, greatest(28.0::DOUBLE, least(280.0::DOUBLE, round_even(((ho + ad) / 2 + (ao + hd) / 2) * 2, 0) / 2)) AS proxy_line FROM games JOIN b USING (game_id))
SELECT game_id, proxy_line, CASE WHEN total > proxy_line THEN 1 ELSE 0 END AS proxy_over, total = proxy_line AS proxy_push FROM p""")
def w14(spark, sf):
    return lines.proxy_line(adapt.games(spark, sf), 28.0, 280.0, 50.0, 48.0).select("game_id", "proxy_line", "proxy_over", "proxy_push")


_POS = "row_number() OVER (PARTITION BY sport ORDER BY game_date, game_id) - 1 AS i, count(*) OVER (PARTITION BY sport) AS n"


@query("w16_time_split", f"{G}, p AS (SELECT game_id, {_POS} FROM games), q AS (SELECT *, CAST(floor(n * 0.85) AS BIGINT) AS h FROM p) SELECT game_id, CASE WHEN i < floor(h * 0.85) THEN 'train' WHEN i < h THEN 'validation' ELSE 'holdout' END AS part FROM q")
def w16(spark, sf):
    return rolling.time_split(adapt.games(spark, sf), ["sport"]).select("game_id", "part")


@query("w17_fold_edges", f"""{G}, d AS (SELECT DISTINCT sport, game_date FROM games), p AS (SELECT *, row_number() OVER (PARTITION BY sport ORDER BY game_date) - 1 AS i, count(*) OVER (PARTITION BY sport) AS n FROM d),
e AS (SELECT sport, k, game_date FROM p, range(0, 6) r(k) WHERE i = floor(k * ((n - 1) / 5.0::DOUBLE)))
SELECT a.sport, CAST(a.k AS INT) AS fold, a.game_date AS start, b.game_date AS "end" FROM e a JOIN e b ON a.sport = b.sport AND a.k + 1 = b.k""")
def w17(spark, sf):
    from .backtest import fold_edges

    return fold_edges(adapt.games(spark, sf), 5)


@query("w18_recent_split", f"{G}, p AS (SELECT game_id, {_POS} FROM games) SELECT game_id, i >= greatest(100, n - 200) AS recent FROM p")
def w18(spark, sf):
    return rolling.recent_split(adapt.games(spark, sf), ["sport"], 200).select("game_id", "recent")


# ------------------------------------------------------------------ composites over rolling pseudo statistics
def _stats(*names: str) -> str:
    return f"WITH {adapt.stats_sql(*names)}\n"


def _rolled(names: list[str], windows: tuple[int, ...], aggs: tuple[str, ...] = ("mean",)) -> str:
    """A common table expression `r` with rolling columns of the statistics."""
    fn = {"mean": "avg({c}) OVER {w}", "std": "coalesce(stddev_samp({c}) OVER {w}, 0)"}
    cols = [fn[a].format(c=f"{s}_{n}", w=f"{s[0]}{k}") + f" AS {s}_{n}_roll{k}_{a}" for s in SIDES for n in names for k in windows for a in aggs]
    win = ", ".join(f"{s[0]}{k} AS (PARTITION BY sport, {s}_team ORDER BY game_date, game_id ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)" for s in SIDES for k in windows)
    return f", r AS (SELECT *, {', '.join(cols)} FROM stats WINDOW {win})\n"


def _roll(spark, sf, names: list[str], windows: tuple[int, ...]):
    return rolling.rolling(adapt.with_stats(adapt.games(spark, sf), *names), names, windows, ())


def _new(before, after, digits=6):
    return rounded(after.select("game_id", *(c for c in after.columns if c not in before.columns)), digits)


@query("c1_shooting_flags", _stats("trueShooting") + _rolled(["trueShooting"], (3, 20)) + "SELECT game_id, " + ", ".join(f"CASE WHEN {a} - {b} > 0.05::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {s}_{n}_shooting" for s in SIDES for n, a, b in (("hot", f"{s}_trueShooting_roll3_mean", f"{s}_trueShooting_roll20_mean"), ("cold", f"{s}_trueShooting_roll20_mean", f"{s}_trueShooting_roll3_mean"))) + " FROM r")
def c1(spark, sf):
    df = _roll(spark, sf, ["trueShooting"], (3, 20))
    return _new(df, composites.shooting_flags(df))


def _pair_sql(name, stat, windows, kind):
    return [s6(f"home_{stat}_roll{w}_mean {'+' if kind == 'sum' else '-'} away_{stat}_roll{w}_mean", f"{name}_roll{w}") for w in windows]


_C2 = ["pace", "pointsPerPossession", "trueShooting", "offensiveRating", "defensiveRating"]


@query("c2_paired", _stats(*_C2) + _rolled(_C2, (5, 10)) + "SELECT game_id, " + ", ".join(x for p in composites.PAIRED for x in _pair_sql(*p)) + ", " + ", ".join(s6(f"(home_offensiveRating_roll{w}_mean + away_defensiveRating_roll{w}_mean) / 2 + (away_offensiveRating_roll{w}_mean + home_defensiveRating_roll{w}_mean) / 2", f"expected_total_roll{w}") for w in (5, 10)) + " FROM r")
def c2(spark, sf):
    df = _roll(spark, sf, _C2, (5, 10))
    return _new(df, composites.paired(df, "nba"))


@query("c2_paired_nfl", _stats("yardsPerPlay", "secondsPerPlay") + _rolled(["yardsPerPlay", "secondsPerPlay"], (3, 5)) + "SELECT game_id, " + ", ".join(x for p in composites.BY_SPORT["nfl"] for x in _pair_sql(*p)) + " FROM r WHERE sport = 'nfl'")
def c2_nfl(spark, sf):
    df = _roll(spark, sf, ["yardsPerPlay", "secondsPerPlay"], (3, 5)).where("sport = 'nfl'")
    return _new(df, composites.paired(df, "nfl"))


@query("c2_paired_mlb", _stats("kBbRatio") + _rolled(["kBbRatio"], (5, 10)) + "SELECT game_id, " + ", ".join(x for p in composites.BY_SPORT["mlb"] for x in _pair_sql(*p)) + " FROM r WHERE sport = 'mlb'")
def c2_mlb(spark, sf):
    df = _roll(spark, sf, ["kBbRatio"], (5, 10)).where("sport = 'mlb'")
    return _new(df, composites.paired(df, "mlb"))


_C3 = ["points", "fieldGoalAttempts", "fieldGoalPct", "threePointAttempts", "threePointPct", "freeThrowAttempts", "freeThrowPct"]


def _luck(s: str) -> str:
    p, fa, fp, ta, tp, ra, rp = (f"{s}_{n}_roll5_mean" for n in _C3)
    return s6(f"{p} - (2 * {fa} * {fp} + {ta} * {tp} + {ra} * {rp})", f"{s}_luck_factor")


@query("c3_luck", _stats(*_C3) + _rolled(_C3, (5,)) + f"SELECT game_id, {_luck('home')}, {_luck('away')} FROM r WHERE sport = 'nba'")
def c3(spark, sf):
    df = _roll(spark, sf, _C3, (5,)).where("sport = 'nba'")
    return _new(df, composites.luck(df, "nba"))


_C4 = ["fieldGoalsMade", "threesMade", "fieldGoalAttempts"]


def _efg(s: str, w: int) -> str:
    return f"(({s}_fieldGoalsMade_roll{w}_mean + 0.5::DOUBLE * {s}_threesMade_roll{w}_mean) / nullif({s}_fieldGoalAttempts_roll{w}_mean, 0))"


@query("c4_effective_shooting", _stats(*_C4) + _rolled(_C4, (5, 10)) + "SELECT game_id, " + ", ".join(x for w in (5, 10) for x in (s9(_efg("home", w), f"home_efgPct_roll{w}"), s9(_efg("away", w), f"away_efgPct_roll{w}"), s9(f"{_efg('home', w)} + {_efg('away', w)}", f"efg_sum_roll{w}"), s9(f"{_efg('home', w)} - {_efg('away', w)}", f"efg_diff_roll{w}"))) + " FROM r")
def c4(spark, sf):
    df = _roll(spark, sf, _C4, (5, 10))
    # 9 digits: means of few games are often exact ties at the 7th, which engines round apart
    return _new(df, composites.effective_shooting(df), 9)


def parks(spark, sf):
    n = F.col("n_nationkey")
    return adapt.table(spark, sf, "nation").where(n % 10 != 9).select(n.cast("long").alias("team"), (F.lit(0.9) + (n % 6) * F.lit(0.05)).alias("factor"))


@query("c5_park_factors", _stats("runsScored") + _rolled(["runsScored"], (5, 10)) + ", k AS (SELECT CAST(n_nationkey AS BIGINT) AS home_team, 0.9::DOUBLE + (n_nationkey % 6) * 0.05::DOUBLE AS f FROM nation WHERE n_nationkey % 10 <> 9) SELECT game_id, " + s6("coalesce(f, 1)", "home_park_factor") + ", " + ", ".join(x for w in (5, 10) for x in (s6(f"(home_runsScored_roll{w}_mean + away_runsScored_roll{w}_mean) * coalesce(f, 1)", f"park_adj_total_roll{w}"), s6(f"home_runsScored_roll{w}_mean * coalesce(f, 1)", f"park_adj_home_runs_roll{w}"))) + " FROM r LEFT JOIN k USING (home_team)")
def c5(spark, sf):
    df = _roll(spark, sf, ["runsScored"], (5, 10))
    return _new(df, composites.park_factors(df, parks(spark, sf)))


_C6 = ["points", "threePointPct", "threePointAttempts"]


def _cv(s: str, w: int) -> str:
    return s6(f"{s}_points_roll{w}_std / coalesce(nullif({s}_points_roll{w}_mean, 0), 1)", f"{s}_score_cv_roll{w}")


def _three(s: str, w: int) -> str:
    return f"({s}_threePointPct_roll{w}_std * {s}_threePointAttempts_roll{w}_mean)"


@query("c6_volatility", _stats(*_C6) + _rolled(_C6, (5, 10), ("mean", "std")) + "SELECT game_id, " + ", ".join(x for w in (5, 10) for x in (
    s6(f"home_points_roll{w}_std + away_points_roll{w}_std", f"volatility_sum_roll{w}"), s6(f"home_points_roll{w}_std - away_points_roll{w}_std", f"volatility_diff_roll{w}"), _cv("home", w), _cv("away", w),
    s6(_three("home", w), f"home_3pt_variance_contrib_roll{w}"), s6(_three("away", w), f"away_3pt_variance_contrib_roll{w}"), s6(f"{_three('home', w)} + {_three('away', w)}", f'"3pt_variance_sum_roll{w}"'))) + " FROM r WHERE sport = 'nba'")
def c6(spark, sf):
    df = _roll(spark, sf, _C6, (5, 10)).where("sport = 'nba'")
    return _new(df, composites.volatility(df, "nba"))


def _hr(s: str, w: int) -> str:
    return f"({s}_homeRuns_roll{w}_mean / coalesce(nullif({s}_flyBallRate_roll{w}_mean, 0), 0.35::DOUBLE))"


@query("c7_homers_per_fly", _stats("homeRuns", "flyBallRate") + _rolled(["homeRuns", "flyBallRate"], (5, 10)) + "SELECT game_id, " + ", ".join(x for w in (5, 10) for x in (s6(_hr("home", w), f"home_hr_per_flyball_roll{w}"), s6(_hr("away", w), f"away_hr_per_flyball_roll{w}"), s6(f"{_hr('home', w)} + {_hr('away', w)}", f"hr_per_flyball_sum_roll{w}"), s6(f"{_hr('home', w)} - {_hr('away', w)}", f"hr_per_flyball_diff_roll{w}"))) + " FROM r WHERE sport = 'mlb'")
def c7(spark, sf):
    df = _roll(spark, sf, ["homeRuns", "flyBallRate"], (5, 10)).where("sport = 'mlb'")
    return _new(df, composites.homers_per_fly(df))


@query("c8_ratios", _stats("pace") + _rolled(["pace"], (3, 5, 10)) + "SELECT game_id, " + ", ".join(x for w in (3, 5, 10) for x in (s6(f"home_pace_roll{w}_mean - away_pace_roll{w}_mean", f"roll{w}_diff_pace"), s6(f"home_pace_roll{w}_mean / nullif(home_pace_roll{w}_mean + away_pace_roll{w}_mean, 0)", f"roll{w}_ratio_pace"))) + " FROM r")
def c8(spark, sf):
    df = _roll(spark, sf, ["pace"], (3, 5, 10))
    return _new(df, composites.ratios(df, ["pace"]))


@query("c9_rest_advantage", f"{G}, r AS (SELECT game_id, {_rest_sql('home')}, {_rest_sql('away')} FROM games {_SIDES_W}) SELECT game_id, home_rest_days - away_rest_days AS home_rest_advantage, 1 AS home_advantage FROM r")
def c9(spark, sf):
    return schedule.rest_days(adapt.games(spark, sf)).select("game_id", "home_rest_advantage", "home_advantage")


_C10 = ["points", "pace", "trueShooting"]


#: Statistics of each sport that the pseudo box scores have.
SPORT_STATS = {"nba": ["points", "pace", "trueShooting", "fieldGoalAttempts"], "nfl": ["pointsScored", "yardsPerPlay"], "mlb": ["runsScored", "homeRuns", "kBbRatio", "flyBallRate"]}


def sport_games(spark, sf, sport):
    """A sport's games with its statistics, without counts of plays: they are the game's own, and no statistic of the matrix."""
    games = adapt.games(spark, sf).where(F.col("sport") == sport)
    return adapt.with_stats(games, *SPORT_STATS[sport]).drop("home_plays", "away_plays")


def sport_matrix(spark, sf, sport):
    """The whole matrix of a sport."""
    return features.build_features(store.stored(sport_games(spark, sf, sport)), sport, SPORT_STATS[sport], parks(spark, sf))


@query("c10_feature_matrix")
def c10_matrix(spark, sf):
    """The whole matrix of every sport, exponential means included; each family has a twin of its own above."""
    parts = each(spark, lambda sport: sport_matrix(spark, sf, sport), SPORT_STATS)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


@query("c10_build_features", _stats(*_C10) + _rolled(_C10, (3, 5, 10, 20)) + f""", n AS (SELECT * FROM r WHERE sport = 'nba'), t AS (SELECT *, {T} AS t FROM n)
SELECT game_id, {s6("home_points_roll5_mean", "home_points_roll5_mean")}, {s6("home_pace_roll5_mean + away_pace_roll5_mean", "projected_possessions_roll5")}, {s6("home_pace_roll10_mean - away_pace_roll10_mean", "roll10_diff_pace")},
{s6("avg(result_over) OVER (ORDER BY game_date, game_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)", "league_over_rate")},
{s6("CASE WHEN count(*) OVER w >= 2 THEN avg(result_over) OVER w ELSE 0.5 END", "h2h_over_rate")}, count(*) OVER (PARTITION BY home_team ORDER BY t RANGE BETWEEN {7 * 86400} PRECEDING AND 1 PRECEDING) AS home_games_7d, total_line
FROM t WINDOW w AS (PARTITION BY least(home_team, away_team), greatest(home_team, away_team) ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def c10(spark, sf):
    df = features.build_features(store.stored(adapt.with_stats(adapt.games(spark, sf), *_C10)), "nba", _C10, alphas=())
    return rounded(df.select("game_id", "home_points_roll5_mean", "projected_possessions_roll5", "roll10_diff_pace", "league_over_rate", "h2h_over_rate", "home_games_7d", "total_line"))
