"""Features that combine the rolling columns of both sides, listed as tables of expressions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import SIDES

#: (name, statistic, windows, sum or diff)
PAIRED = [
    ("projected_possessions", "pace", (5, 10), "sum"), ("ppp_sum", "pointsPerPossession", (5, 10), "sum"), ("ppp_diff", "pointsPerPossession", (5, 10), "diff"),
    ("ts_sum", "trueShooting", (5, 10), "sum"), ("ts_diff", "trueShooting", (5, 10), "diff"), ("off_rating_sum", "offensiveRating", (5, 10), "sum"), ("def_rating_sum", "defensiveRating", (5, 10), "sum"),
]
BY_SPORT = {
    "nfl": [("ypp_sum", "yardsPerPlay", (3, 5), "sum"), ("tempo_sum", "secondsPerPlay", (3, 5), "sum")],
    "mlb": [("kbb_sum", "kBbRatio", (5, 10), "sum")],
}
SCORE_STAT = {"nba": "points", "nfl": "pointsScored", "mlb": "runsScored"}


def add(df: DataFrame, columns: Iterator[tuple[str, Column]]) -> DataFrame:
    """df with the columns, in one projection."""
    return df.select("*", *(c.alias(n) for n, c in columns))


def _have(df: DataFrame, *names: str) -> bool:
    return all(n in df.columns for n in names)


def _roll(side: str, stat: str, w: int, agg: str = "mean") -> str:
    return f"{side}_{stat}_roll{w}_{agg}"


def shooting_flags(df: DataFrame) -> DataFrame:
    def columns():
        for s in SIDES:
            a, b = _roll(s, "trueShooting", 3), _roll(s, "trueShooting", 20)
            flag = lambda x, y: F.coalesce((F.col(x) - F.col(y) > 0.05).cast("double"), F.lit(0.0))
            yield f"{s}_hot_shooting", flag(a, b) if _have(df, a, b) else F.lit(0.0)
            yield f"{s}_cold_shooting", flag(b, a) if _have(df, a, b) else F.lit(0.0)

    return add(df, columns())


def paired(df: DataFrame, sport: str) -> DataFrame:
    def columns():
        for name, stat, windows, kind in PAIRED + BY_SPORT.get(sport, []):
            for w in windows:
                h, a = _roll("home", stat, w), _roll("away", stat, w)
                if _have(df, h, a):
                    yield f"{name}_roll{w}", F.col(h) + F.col(a) if kind == "sum" else F.col(h) - F.col(a)
        for w in (5, 10):
            ho, ao, hd, ad = (_roll(s, f"{k}Rating", w) for k in ("offensive", "defensive") for s in SIDES)
            if _have(df, ho, ao, hd, ad):
                yield f"expected_total_roll{w}", (F.col(ho) + F.col(ad)) / 2 + (F.col(ao) + F.col(hd)) / 2

    return add(df, columns())


def luck(df: DataFrame, sport: str) -> DataFrame:
    """Points beyond what the shots promise; 0 for other sports or without the columns."""
    names = ("points", "fieldGoalAttempts", "fieldGoalPct", "threePointAttempts", "threePointPct", "freeThrowAttempts", "freeThrowPct")

    def columns():
        for s in SIDES:
            cols = [_roll(s, n, 5) for n in names]
            p, fa, fp, ta, tp, ra, rp = map(F.col, cols)
            yield f"{s}_luck_factor", p - (2 * fa * fp + ta * tp + ra * rp) if sport == "nba" and _have(df, *cols) else F.lit(0.0)

    return add(df, columns())


def situational(df: DataFrame) -> DataFrame:
    """Interactions of weather, venue, market and injuries; each where its input is there."""
    c = F.col

    def columns():
        if _have(df, "altitude_feet"):
            yield "altitude_boost", c("altitude_feet") / 5280.0
        if _have(df, "is_dome"):
            yield "dome_flag", c("is_dome")
        if _have(df, "wind_speed_mph"):
            yield "wind_under_signal", (c("wind_speed_mph") > 15).cast("double")
            yield "wind_severity", c("wind_speed_mph") / 30.0
        if _have(df, "temperature_f"):
            yield "cold_game", (c("temperature_f") < 40).cast("double")
            yield "hot_game", (c("temperature_f") > 85).cast("double")
        if _have(df, "sharp_over_pct", "public_over_pct"):
            yield "sharp_vs_public", c("sharp_over_pct") - c("public_over_pct")
        if _have(df, "line_movement"):
            yield "line_move_magnitude", F.abs("line_movement")
            yield "line_move_direction", F.signum("line_movement")
        if _have(df, "home_key_players_out", "away_key_players_out"):
            yield "injury_pts_impact", (c("home_key_players_out") - c("away_key_players_out")) * -3.0

    return add(df, columns())


def effective_shooting(df: DataFrame) -> DataFrame:
    def columns():
        for w in (5, 10):
            each = {}
            for s in SIDES:
                made, threes, tries = (_roll(s, n, w) for n in ("fieldGoalsMade", "threesMade", "fieldGoalAttempts"))
                if _have(df, made, threes, tries):
                    each[s] = (F.col(made) + 0.5 * F.col(threes)) / F.nullif(F.col(tries), F.lit(0.0))
                    yield f"{s}_efgPct_roll{w}", each[s]
            if len(each) == 2:
                yield f"efg_sum_roll{w}", each["home"] + each["away"]
                yield f"efg_diff_roll{w}", each["home"] - each["away"]

    return add(df, columns())


def park_factors(df: DataFrame, parks: DataFrame) -> DataFrame:
    """home_park_factor (1 where unknown) and park-adjusted runs; parks: (team, factor), one row per team."""
    p = F.broadcast(parks.select(F.col("team").alias("home_team"), F.coalesce("factor", F.lit(1.0)).alias("_f")))
    df = df.join(p, "home_team", "left").withColumn("home_park_factor", F.coalesce("_f", F.lit(1.0))).drop("_f")

    def columns():
        for w in (5, 10):
            h, a = _roll("home", "runsScored", w), _roll("away", "runsScored", w)
            if _have(df, h, a):
                yield f"park_adj_total_roll{w}", (F.col(h) + F.col(a)) * F.col("home_park_factor")
                yield f"park_adj_home_runs_roll{w}", F.col(h) * F.col("home_park_factor")

    return add(df, columns())


def volatility(df: DataFrame, sport: str) -> DataFrame:
    def columns():
        stat = SCORE_STAT.get(sport)
        for w in (5, 10):
            hs, hm, as_, am = (_roll(s, stat, w, a) for s in SIDES for a in ("std", "mean"))
            if stat and _have(df, hs, hm, as_, am):
                yield f"volatility_sum_roll{w}", F.col(hs) + F.col(as_)
                yield f"volatility_diff_roll{w}", F.col(hs) - F.col(as_)
                for s, sd, mean in (("home", hs, hm), ("away", as_, am)):
                    yield f"{s}_score_cv_roll{w}", F.col(sd) / F.coalesce(F.nullif(F.col(mean), F.lit(0.0)), F.lit(1.0))
            cols = [_roll(s, n, w, a) for s in SIDES for n, a in (("threePointPct", "std"), ("threePointAttempts", "mean"))]
            if sport == "nba" and _have(df, *cols):
                h, a = F.col(cols[0]) * F.col(cols[1]), F.col(cols[2]) * F.col(cols[3])
                yield f"home_3pt_variance_contrib_roll{w}", h
                yield f"away_3pt_variance_contrib_roll{w}", a
                yield f"3pt_variance_sum_roll{w}", h + a

    return add(df, columns())


def homers_per_fly(df: DataFrame) -> DataFrame:
    def columns():
        for w in (5, 10):
            each = {}
            for s in SIDES:
                hr, fb = _roll(s, "homeRuns", w), _roll(s, "flyBallRate", w)
                if _have(df, hr, fb):
                    each[s] = F.col(hr) / F.coalesce(F.nullif(F.col(fb), F.lit(0.0)), F.lit(0.35))
                    yield f"{s}_hr_per_flyball_roll{w}", each[s]
            if len(each) == 2:
                yield f"hr_per_flyball_sum_roll{w}", each["home"] + each["away"]
                yield f"hr_per_flyball_diff_roll{w}", each["home"] - each["away"]

    return add(df, columns())


def ratios(df: DataFrame, stats: list[str], windows=(3, 5, 10)) -> DataFrame:
    """Difference and share of the sides' rolling means."""

    def columns():
        for w in windows:
            for stat in stats:
                h, a = _roll("home", stat, w), _roll("away", stat, w)
                if _have(df, h, a):
                    yield f"roll{w}_diff_{stat}", F.col(h) - F.col(a)
                    yield f"roll{w}_ratio_{stat}", F.col(h) / F.nullif(F.col(h) + F.col(a), F.lit(0.0))

    return add(df, columns())
