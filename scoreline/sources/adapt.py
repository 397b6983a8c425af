"""Games, predictions and quotes over the driver's star schema, and the same as SQL text.

The SQL twins use these texts as common table expressions; the Spark side builds the same rows with
DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GAMES_SQL = """li AS (SELECT l_orderkey AS game_id,
  CAST(SUM(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity ELSE 0 END) AS BIGINT) AS home_score,
  CAST(SUM(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE 0 END) AS BIGINT) AS away_score,
  CAST(COUNT(CASE WHEN l_linenumber % 2 = 1 THEN 1 END) AS BIGINT) AS home_plays,
  CAST(COUNT(CASE WHEN l_linenumber % 2 = 0 THEN 1 END) AS BIGINT) AS away_plays
  FROM lineitem GROUP BY l_orderkey),
games AS (SELECT o_orderkey AS game_id,
  CASE o_orderstatus WHEN 'O' THEN 'nba' WHEN 'F' THEN 'nfl' ELSE 'mlb' END AS sport,
  CAST(year(o_orderdate) AS INT) AS season, o_orderdate AS game_date,
  CAST(c_nationkey AS BIGINT) AS home_team, CAST((c_nationkey + 1 + o_orderkey % 24) % 25 AS BIGINT) AS away_team,
  home_score, away_score, home_score + away_score AS total, home_plays, away_plays,
  CAST(52.5 + (o_orderkey * 37 % 100) AS DOUBLE) AS total_line,
  CASE WHEN home_score + away_score > 52.5 + (o_orderkey * 37 % 100) THEN 1 ELSE 0 END AS result_over
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN li ON game_id = o_orderkey)"""

#: Pseudo box-score statistics of a side, integer arithmetic over its game: name -> (factor, score factor, modulus, divisor).
STATS = {
    "points": (0, 1, 1000, 1), "pace": (7, 3, 40, 1), "pointsPerPossession": (11, 5, 60, 50), "trueShooting": (13, 1, 100, 100),
    "offensiveRating": (17, 2, 50, 1), "defensiveRating": (19, 3, 50, 1), "fieldGoalsMade": (23, 1, 45, 1), "threesMade": (29, 1, 20, 1),
    "fieldGoalAttempts": (31, 2, 95, 1), "fieldGoalPct": (37, 1, 60, 100), "threePointAttempts": (41, 1, 40, 1), "threePointPct": (43, 1, 50, 100),
    "freeThrowAttempts": (47, 1, 30, 1), "freeThrowPct": (53, 1, 100, 100), "pointsScored": (0, 1, 1000, 1), "yardsPerPlay": (59, 1, 90, 10),
    "secondsPerPlay": (61, 1, 40, 1), "runsScored": (67, 1, 15, 1), "kBbRatio": (71, 1, 60, 10), "homeRuns": (73, 1, 5, 1), "flyBallRate": (79, 1, 5, 10),
}


def stat_sql(side: str, name: str) -> str:
    f, s, m, d = STATS[name]
    return f"CAST((game_id * {f} + {side}_score * {s}) % {m} AS DOUBLE) / CAST({d} AS DOUBLE) AS {side}_{name}"


def stats_sql(*names: str) -> str:
    """games with the pseudo statistics, as a common table expression `stats`."""
    return GAMES_SQL + ",\nstats AS (SELECT *, " + ", ".join(stat_sql(s, n) for n in names for s in ("home", "away")) + " FROM games)"


#: A log of predictions over the games, some settled, with a later closing line.
PREDICTIONS_SQL = GAMES_SQL + """,
predictions AS (SELECT game_id AS prediction_id, game_id, sport, game_date, home_team, away_team,
  concat('v', CAST(game_id % 3 AS VARCHAR)) AS model_version, CAST(game_id * 7919 % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS prob_over,
  total_line, total_line + CAST(game_id % 7 - 3 AS DOUBLE) * CAST(0.5 AS DOUBLE) AS closing_line, total, result_over,
  game_id % 5 <> 0 AS is_settled FROM games)"""

QUOTES_SQL = """quotes AS (SELECT l_orderkey AS game_id, l_suppkey % 5 AS book, CAST(l_quantity AS DOUBLE) + CAST(0.5 AS DOUBLE) AS point,
  CAST(l_linenumber AS BIGINT) AS seq, CAST(l_partkey % 7 - 3 AS DOUBLE) AS spread, CAST(l_suppkey % 200 - 100 AS DOUBLE) AS price, l_shipdate AS quoted_at FROM lineitem)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per game; customers are joined by key and orders meet their own lines."""
    q, odd = F.col("l_quantity"), F.col("l_linenumber") % 2 == 1
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("game_id")).agg(
        F.sum(F.when(odd, q).otherwise(0)).cast("long").alias("home_score"), F.sum(F.when(~odd, q).otherwise(0)).cast("long").alias("away_score"),
        F.count_if(odd).alias("home_plays"), F.count_if(~odd).alias("away_plays"))
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key, nation = F.col("o_orderkey"), F.col("c_nationkey")
    status = F.col("o_orderstatus")
    line = 52.5 + (key * 37 % 100).cast("double")
    total = F.col("home_score") + F.col("away_score")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).join(lines, orders.o_orderkey == lines.game_id).select(
        "game_id", F.when(status == "O", "nba").when(status == "F", "nfl").otherwise("mlb").alias("sport"), F.year("o_orderdate").alias("season"), F.col("o_orderdate").alias("game_date"),
        nation.cast("long").alias("home_team"), ((nation + 1 + key % 24) % 25).cast("long").alias("away_team"), "home_score", "away_score", total.alias("total"), "home_plays", "away_plays",
        line.alias("total_line"), F.when(total > line, 1).otherwise(0).alias("result_over"))


def with_stats(g: DataFrame, *names: str) -> DataFrame:
    return g.select("*", *(F.expr(stat_sql(s, n)) for n in names for s in ("home", "away")))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("game_id")
    return games(spark, sf_dir).select(
        i.alias("prediction_id"), "game_id", "sport", "game_date", "home_team", "away_team", F.concat(F.lit("v"), (i % 3).cast("string")).alias("model_version"),
        ((i * 7919 % 1000).cast("double") / 1000.0).alias("prob_over"), "total_line", (F.col("total_line") + (i % 7 - 3).cast("double") * 0.5).alias("closing_line"), "total", "result_over", (i % 5 != 0).alias("is_settled"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("game_id"), (F.col("l_suppkey") % 5).alias("book"), (F.col("l_quantity").cast("double") + 0.5).alias("point"), F.col("l_linenumber").cast("long").alias("seq"),
        (F.col("l_partkey") % 7 - 3).cast("double").alias("spread"), (F.col("l_suppkey") % 200 - 100).cast("double").alias("price"), F.col("l_shipdate").alias("quoted_at"))
