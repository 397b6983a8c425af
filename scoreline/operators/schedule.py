"""Rest, density, travel and season progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.keys import SIDES, appearances, beside, epoch, side_window, team_window
from ..functions.scalars import haversine_km

DAY = 86_400


def rest_days(games: DataFrame) -> DataFrame:
    """Whole days since the side's last game (7 before the first), back-to-back flags and the advantage."""
    games = games.withColumn("_t", epoch())
    for side in SIDES:
        gap = F.floor((F.col("_t") - F.lag("_t").over(side_window(side))) / DAY)
        games = games.withColumn("_gap", gap).select("*", F.coalesce("_gap", F.lit(7)).cast("double").alias(f"{side}_rest_days"), F.coalesce((F.col("_gap") <= 1).cast("int"), F.lit(0)).alias(f"{side}_back_to_back")).drop("_gap")
    return games.drop("_t").withColumn("home_rest_advantage", F.col("home_rest_days") - F.col("away_rest_days")).withColumn("home_advantage", F.lit(1))


def _earlier(w: WindowSpec, t: Column, seconds: int) -> Column:
    """Rows of w, ordered by t, from `seconds` before a row up to a second before it; at a null t, the rows without one.

    Two running counts: a sliding frame is counted anew whenever a time differs, which is quadratic.
    """
    upto = lambda s: F.count("*").over(w.rangeBetween(Window.unboundedPreceding, s))
    return upto(-1) - F.when(t.isNull(), 0).otherwise(upto(-seconds - 1))


def games_within(games: DataFrame, days=(7, 14)) -> DataFrame:
    """Games of the side in the last days; the one at hand and others at the same time don't count."""
    for side in SIDES:
        w = Window.partitionBy("sport", f"{side}_team").orderBy(epoch())
        games = games.select("*", *(_earlier(w, epoch(), d * DAY).alias(f"{side}_games_{d}d") for d in days))
    return games


def density(games: DataFrame, days=(3, 5)) -> DataFrame:
    """Games of a team on either side with fewer than d + 1 elapsed days before, and the difference."""
    rows = appearances(games).withColumn("t", epoch())
    w = Window.partitionBy("sport", "team").orderBy("t")
    rows = rows.select("*", *(_earlier(w, F.col("t"), (d + 1) * DAY - 1).alias(f"games_{d}d_all") for d in days))
    out = beside(games, rows, [f"games_{d}d_all" for d in days])
    return out.select("*", *((F.col(f"home_games_{d}d_all") - F.col(f"away_games_{d}d_all")).alias(f"density_diff_{d}d") for d in days))


def travel(games: DataFrame, venues: DataFrame) -> DataFrame:
    """Kilometres from the place of each team's game before (either side) to this one; 0 for the first.

    venues: (team, lat, lon), one row per team.
    """
    rows = appearances(games, "home_team").withColumnRenamed("home_team", "host").join(venues.withColumnRenamed("team", "host"), "host", "left")
    w = team_window()
    km = haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return beside(games, rows.withColumn("travel_km", F.coalesce(km, F.lit(0.0))), ["travel_km"])


def season_progress(games: DataFrame) -> DataFrame:
    """Elapsed share of the season; its bounds are an aggregate, so no season is gathered."""
    t = epoch()
    bounds = games.groupBy("sport", "season").agg(F.min(t).alias("_low"), F.max(t).alias("_high"))
    share = (t - F.col("_low")) / F.greatest(F.col("_high") - F.col("_low"), F.lit(1)).cast("double")
    return games.join(bounds, ["sport", "season"]).withColumn("season_progress", share).drop("_low", "_high")
