"""What two teams did against each other, and what a team allows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import epoch, pair_window, side_window


def league_average(games: DataFrame, stats: list[str]) -> DataFrame:
    """(sport, avg_<stat>) over both sides."""
    both = lambda s: (F.coalesce(F.sum(f"home_{s}"), F.lit(0.0)) + F.coalesce(F.sum(f"away_{s}"), F.lit(0.0))) / F.nullif(F.count(f"home_{s}") + F.count(f"away_{s}"), F.lit(0))
    return games.groupBy("sport").agg(*(both(s).alias(f"avg_{s}") for s in stats))


def head_to_head(games: DataFrame, least: int = 2) -> DataFrame:
    """Over-rate and mean total of the pair's strictly earlier games; 0.5 and the line with fewer than `least`."""
    w = pair_window().orderBy(epoch()).rangeBetween(Window.unboundedPreceding, -1)
    enough = F.count("*").over(w) >= least
    return games.select(
        "*", F.when(enough, F.avg("result_over").over(w)).otherwise(0.5).alias("h2h_over_rate"),
        F.when(enough, F.avg("total").over(w)).otherwise(F.col("total_line")).alias("h2h_avg_total"))


def allowed_mean(games: DataFrame, stats: list[str], n: int = 10) -> DataFrame:
    """games with opp_def_<stat>_mean: what visitors did in the home team's last n home games."""
    w = side_window("home").rowsBetween(-n, -1)
    return games.select("*", *(F.avg(f"away_{s}").over(w).alias(f"opp_def_{s}_mean") for s in stats))


def by_league(rows: DataFrame, games: DataFrame, stats: list[str]) -> DataFrame:
    """rows with opp_def_<stat>_ratio, their means by the sport's average, in place of opp_def_<stat>_mean.

    The average covers the whole history, as the definition asks; it is one row per sport.
    """
    ratio = lambda s: (F.col(f"opp_def_{s}_mean") / F.coalesce(F.nullif(F.col(f"avg_{s}"), F.lit(0.0)), F.lit(1.0))).alias(f"opp_def_{s}_ratio")
    means = [f"opp_def_{s}_mean" for s in stats]
    return rows.join(F.broadcast(league_average(games, stats)), "sport").select(*(c for c in rows.columns if c not in means), *(ratio(s) for s in stats))


def allowed_ratio(games: DataFrame, stats: list[str], n: int = 10) -> DataFrame:
    """games with opp_def_<stat>_ratio: allowed_mean by the sport's average."""
    return by_league(allowed_mean(games, stats, n), games, stats)


def division_flag(games: DataFrame, divisions: DataFrame) -> DataFrame:
    """is_division_game; divisions: (team, division), one row per team. Unknown teams share none."""
    d = F.broadcast(divisions)
    home = d.select(F.col("team").alias("home_team"), F.col("division").alias("_h"))
    away = d.select(F.col("team").alias("away_team"), F.col("division").alias("_a"))
    out = games.join(home, "home_team", "left").join(away, "away_team", "left")
    return out.select(*games.columns, F.coalesce((F.col("_h") == F.col("_a")).cast("int"), F.lit(0)).alias("is_division_game"))
