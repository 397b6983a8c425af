"""Injury counts, impacts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import injury_kind, player_id, status_impact

ACTIVE = ("out", "doubtful", "questionable")


def injury_counts(comments: DataFrame, key_only: bool = True) -> DataFrame:
    """(game_id, team, players_out) from player comments (game_id, team, comment)."""
    kind = injury_kind(F.col("comment"))
    return comments.where(kind == "key" if key_only else kind != "none").groupBy("game_id", "team").agg(F.count("*").alias("players_out"))


def counts_on_games(games: DataFrame, counts: DataFrame) -> DataFrame:
    """games with home/away_key_players_out, 0 without a report."""
    for s in ("home", "away"):
        c = counts.select("game_id", F.col("team").alias(f"{s}_team"), F.col("players_out").alias(f"{s}_key_players_out"))
        games = games.join(c, ["game_id", f"{s}_team"], "left")
    return games.fillna(0, ["home_key_players_out", "away_key_players_out"])


def team_impact(reports: DataFrame) -> DataFrame:
    """(sport, team, impact, key_out, total_out): impacts summed up to 1, players out counted."""
    out = F.lower("status").isin("out", "doubtful")
    return reports.groupBy("sport", "team").agg(F.least(F.sum(status_impact(F.col("status"))), F.lit(1.0)).alias("impact"), F.count_if(out).alias("key_out"), F.count_if(F.lower("status").isin(*ACTIVE)).alias("total_out"))


def active_injuries(reports: DataFrame) -> DataFrame:
    return reports.where(F.lower("status").isin(*ACTIVE))


def upsert(current: DataFrame, update: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The latest row of each key of both tables by `version`; an update wins a tie."""
    both = current.withColumn("_new", F.lit(0)).unionByName(update.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "_new")]
    # max_by keeps one row a key with partial aggregation, where a window would gather a key
    latest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "_new", *rest)).alias("r"))
    return latest.select(*keys, "r.*")


def from_box_scores(reports: DataFrame) -> DataFrame:
    """One row per injured player of each team's first non-empty list.

    reports: (sport, team, seq, players array<struct<name, key>>).
    """
    first = Window.partitionBy("sport", "team").orderBy("seq")
    lists = reports.where(F.size("players") > 0).withColumn("r", F.row_number().over(first)).where("r = 1")
    rows = lists.select("sport", "team", F.inline("players"))
    return rows.select(
        player_id(F.col("sport"), F.col("team").cast("string"), F.col("name")).alias("player_id"), "sport", "team", F.substring("name", 1, 100).alias("player_name"),
        F.when(F.col("key"), "out").otherwise("questionable").alias("status"), F.when(F.col("key"), 1.0).otherwise(0.4).alias("impact"))
