"""Settlement of predictions and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import confidence, direction


def settle(open_: DataFrame, results: DataFrame) -> DataFrame:
    """Open predictions with their results (game_id, actual, close): over, correct, closing-line value, push."""
    over, bet_over = F.col("actual") > F.col("close"), F.col("prob_over") >= 0.5
    clv = F.round(F.when(bet_over, F.col("close") - F.col("bet_line")).otherwise(F.col("bet_line") - F.col("close")), 2)
    joined = open_.join(results.where("close is not null"), "game_id")
    return joined.select(*open_.columns, "actual", "close", over.alias("over"), (over == bet_over).alias("is_correct"), clv.alias("clv"), (F.col("actual") == F.col("close")).alias("is_push"))


def bet_line(predictions: DataFrame, games: DataFrame) -> DataFrame:
    """predictions with the posted line of their game, or the closing line where that is missing or 0."""
    g = games.select("game_id", F.nullif(F.col("total_line"), F.lit(0.0)).alias("_posted"))
    return predictions.join(g, "game_id", "left").withColumn("bet_line", F.coalesce("_posted", "closing_line")).drop("_posted")


def auto_settle(open_: DataFrame, finals: DataFrame) -> DataFrame:
    """Settlement against the posted line of final games; closing-line value is 0."""
    over = F.col("total") > F.col("total_line")
    joined = open_.select("prediction_id", "game_id", "prob_over").join(finals.where("total_line is not null").select("game_id", "total", "total_line"), "game_id")
    return joined.select("prediction_id", "game_id", over.alias("over"), (over == (F.col("prob_over") >= 0.5)).alias("is_correct"), F.lit(0.0).alias("clv"))


def message() -> Column:
    return F.format_string("%s %s @ %s: %s %.1f (%.1f%%)", F.upper("sport"), F.col("away_team").cast("string"), F.col("home_team").cast("string"), F.upper(direction(F.col("prob_over"))), F.col("total_line"), confidence(F.col("prob_over")) * 100)


def alerts(predictions: DataFrame, threshold: float = 0.65) -> DataFrame:
    """Alert rows of predictions at least this confident, not yet fired."""
    p = F.col("prob_over")
    return predictions.where(confidence(p) >= threshold).select(
        "prediction_id", F.upper("sport").alias("sport"), "home_team", "away_team", direction(p).alias("direction"), F.round(p, 4).alias("prob_over"),
        F.round(confidence(p), 4).alias("confidence"), "total_line", message().alias("message"), F.lit(False).alias("fired"))


def unfired(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("fired"))
