"""Scans and table maintenance: append, de-duplicate, cluster, cache features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def labelled(games: DataFrame) -> DataFrame:
    return games.where(F.col("result_over").isNotNull())


def between(games: DataFrame, sport: str, start: Column, end: Column) -> DataFrame:
    """Games of a sport in a closed range; both conditions reach a Parquet scan."""
    return games.where((F.col("sport") == sport) & F.col("game_date").between(start, end))


def recent(games: DataFrame, as_of: Column, days: int) -> DataFrame:
    return games.where(F.col("game_date") >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def new_rows(history: DataFrame, batch: DataFrame, key: str = "game_id") -> DataFrame:
    """Rows of batch whose key history lacks."""
    return batch.join(history.select(key), key, "left_anti")


def append(history: DataFrame, batch: DataFrame, key: str = "game_id") -> DataFrame:
    """history and the new rows of batch; columns that either lacks are null."""
    return history.unionByName(new_rows(history, batch, key), allowMissingColumns=True)


def append_summary(history: DataFrame, batch: DataFrame, key: str = "game_id") -> DataFrame:
    """(found, added, skipped)."""
    known = history.select(key).distinct().withColumn("_known", F.lit(True))
    return batch.join(known, key, "left").agg(F.count("*").alias("found"), F.count_if(F.col("_known").isNull()).alias("added"), F.count_if("_known").alias("skipped"))


def first_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key: the first by order, whole; partial aggregation keeps one row per task and key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*").select(*df.columns)


def write_features(features: DataFrame, path: str) -> None:
    """Partitioned by sport and season; only the partitions at hand are replaced. A large season is split over tasks."""
    spread = features.hint("rebalance", "sport", "season")
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sport", "season").parquet(path)


def write_clustered(games: DataFrame, path: str, partitions: int = 16) -> None:
    """Files that each cover a range of dates, sorted, so that row-group statistics prune."""
    games.repartitionByRange(partitions, "game_date", "game_id").sortWithinPartitions("game_date", "game_id").write.mode("overwrite").parquet(path)


def signature(games: DataFrame) -> DataFrame:
    """(sport, n, first, last, content): the content hash tells changed rows, which counts and dates don't."""
    return games.groupBy("sport").agg(F.count("*").alias("n"), F.min("game_date").alias("first"), F.max("game_date").alias("last"), F.bit_xor(F.xxhash64(*games.columns)).alias("content"))


def stale(cached: DataFrame, current: DataFrame) -> DataFrame:
    """Sports whose signature isn't among the cached ones."""
    return current.join(cached, ["sport", "n", "first", "last", "content"], "left_anti").select("sport")


def register(spark: SparkSession, name: str, path: str) -> None:
    """A table over files that stay where they are."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} USING parquet LOCATION '{path}'")


def violations(requests: DataFrame) -> DataFrame:
    """requests with `problems`: names of the rules they break; teams are trimmed and in upper case."""
    rules = {
        "sport": ~F.col("sport").isin("nba", "nfl", "mlb"),
        "home_team": F.length(F.trim("home_team")) == 0,
        "away_team": F.upper(F.trim("away_team")) == F.upper(F.trim("home_team")),
        "total_line": ~(F.col("total_line") > 0),
        "home_rest_days": ~F.col("home_rest_days").between(0, 14),
        "away_rest_days": ~F.col("away_rest_days").between(0, 14),
    }
    problems = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), name) for name, bad in rules.items())))
    return requests.withColumns({"home_team": F.upper(F.trim("home_team")), "away_team": F.upper(F.trim("away_team")), "problems": problems})


def feature_columns(df: DataFrame, dropped: set[str]) -> list[str]:
    """Numeric columns that a model may see."""
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [n for n, t in df.dtypes if t in numeric and n not in dropped]


def missing_features(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Feature names (name) that are expected and not present."""
    return expected.select("name").exceptAll(present.select("name"))
