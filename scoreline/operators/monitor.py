"""Rollups for dashboards: accuracy, prediction log, latency, models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions.scalars import confidence, direction
from ..functions.keys import same
from ..sources.store import stored
from .ranks import quantiles

#: Share of the rows to each side of a median that are counted by value, and accuracy of the sketch (ranks are off by 1 / NEAR at most).
BESIDE, NEAR = 0.02, 1_000


def live_accuracy(settled: DataFrame) -> DataFrame:
    """(model_version, sport, settled, correct, accuracy); accuracy is null where nothing is settled."""
    done = F.col("is_correct").isNotNull()
    return settled.groupBy("model_version", "sport").agg(F.count_if(done).alias("settled"), F.count_if(F.col("is_correct")).alias("correct"), F.avg(F.col("is_correct").cast("int")).alias("accuracy"))


def log_rollup(predictions: DataFrame, since=None) -> DataFrame:
    """(sport, direction, predictions) with subtotals (nulls); since: a lower bound on game_date as a column."""
    rows = predictions if since is None else predictions.where(F.col("game_date") >= since)
    return rows.withColumn("direction", direction(F.col("prob_over"))).rollup("sport", "direction").agg(F.count("*").alias("predictions"))


def percentiles(predictions: DataFrame) -> DataFrame:
    """(sport, confidence_p50, ..., prob_p25, ...): exact percentiles of both measures."""
    p, wanted = F.col("prob_over"), {"confidence": (0.5, 0.75, 0.9), "prob": (0.25, 0.5, 0.75)}
    both = F.array(*(F.struct(F.lit(m).alias("measure"), v.alias("value")) for m, v in (("confidence", confidence(p)), ("prob", p))))
    shares = sorted({q for qs in wanted.values() for q in qs})
    found = quantiles(predictions.select("sport", F.inline(both)), ["sport", "measure"], "value", shares)
    return found.groupBy("sport").agg(*(F.max(F.when(F.col("measure") == m, F.col("quantiles")[shares.index(q)])).alias(f"{m}_p{int(q * 100)}") for m, qs in wanted.items() for q in qs))


def bucket_quantile(df: DataFrame, keys: list[str], value: str, edges: list[float], q: float) -> DataFrame:
    """(keys, quantile) interpolated inside histogram buckets, as a metrics store does; above the last edge it is that edge."""
    at = sum((F.when(F.col(value) > e, 1).otherwise(0) for e in edges), F.lit(0))
    counts = df.groupBy(*keys, at.alias("b")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy("b")
    rank = F.lit(q) * F.sum("n").over(Window.partitionBy(*keys))
    counts = counts.withColumn("upto", F.sum("n").over(w)).withColumn("rank", rank)
    low, high = F.array(*map(F.lit, [0.0, *edges])), F.array(*map(F.lit, [*edges, edges[-1]]))
    inside = F.element_at(low, F.col("b") + 1) + (F.element_at(high, F.col("b") + 1) - F.element_at(low, F.col("b") + 1)) * (F.col("rank") - (F.col("upto") - F.col("n"))) / F.col("n")
    return counts.where("upto >= rank").groupBy(*keys).agg(F.min_by(inside, "b").alias("quantile"))


def request_rate(log: DataFrame, width: str = "5 minutes") -> DataFrame:
    """(start, requests, p95) of (ts, latency) by tumbling window."""
    return log.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("requests"), F.percentile("latency", F.lit(0.95)).alias("p95")).select(F.col("w.start").alias("start"), "requests", "p95")


#: Size of a latency sketch: the rank of a quantile is off by less than 0.6 % of the rows (with 99 % confidence), merged or not.
SKETCH_K = 800


def latency_sketches(log: DataFrame, width: str = "5 minutes") -> DataFrame:
    """(start, requests, sketch) of (ts, latency) by tumbling window: mergeable quantile sketches of bounded size, filled before the shuffle."""
    return log.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("requests"), F.kll_sketch_agg_double("latency", SKETCH_K).alias("sketch")).select(F.col("w.start").alias("start"), "requests", "sketch")


def roll_up(sketches: DataFrame, width: str = "1 hour", slide: str | None = None, shares=(0.5, 0.95)) -> DataFrame:
    """(start, requests, p50, p95): sketches merged to longer windows, tumbling or sliding, without the requests themselves."""
    w = F.window("start", width, slide) if slide else F.window("start", width)
    merged = sketches.groupBy(w.alias("w")).agg(F.sum("requests").alias("requests"), F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"))
    return merged.select(F.col("w.start").alias("start"), "requests", *(F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(f"p{int(q * 100)}") for q in shares))


def retrains_per_day(runs: DataFrame) -> DataFrame:
    return runs.groupBy(F.to_date("trained_at").alias("day"), "sport", "reason").agg(F.count("*").alias("retrains"))


def dashboard(settled: DataFrame, last: int = 1000, threshold: float = 0.65) -> DataFrame:
    """Accuracy, mean CLV and alerts over the newest predictions."""
    newest = settled.orderBy(F.desc("game_date"), F.desc("prediction_id")).limit(last)
    return newest.agg(F.count("*").alias("predictions"), (F.avg(F.col("is_correct").cast("int")) * 100).alias("accuracy_pct"), F.avg("clv").alias("mean_clv"), F.count_if(confidence(F.col("prob_over")) >= threshold).alias("alerts"))


def latest_model(runs: DataFrame) -> DataFrame:
    return runs.groupBy("sport").agg(F.max_by("version", F.struct("trained_at", "version")).alias("version"), F.max("trained_at").alias("trained_at"))


def latest_psi(reports: DataFrame) -> DataFrame:
    return reports.groupBy("sport", "feature").agg(F.max_by("psi", F.struct("check_ts", "psi")).alias("psi"))


def since_retrain(games: DataFrame, models: DataFrame, least: int = 30) -> DataFrame:
    """(sport, new_games, retrain): games after the model's training time."""
    m = models.select("sport", "trained_at")
    return m.join(games, "sport", "left").groupBy("sport").agg(F.count_if(F.col("game_date") > F.col("trained_at")).alias("new_games")).withColumn("retrain", F.col("new_games") >= least)


def training_status(games: DataFrame, runs: DataFrame) -> DataFrame:
    """(sport, games, last_game, version, runs, added): one row per sport."""
    g = games.groupBy("sport").agg(F.count("*").alias("games"), F.max("game_date").alias("last_game"))
    r = runs.groupBy("sport").agg(F.max_by("version", F.struct("trained_at", "version")).alias("version"), F.count("*").alias("runs"), F.max("trained_at").alias("trained_at"))
    added = games.join(r.select("sport", "trained_at"), "sport").groupBy("sport").agg(F.count_if(F.col("game_date") > F.col("trained_at")).alias("added"))
    return g.join(r.drop("trained_at"), "sport", "left").join(added, "sport", "left").fillna(0, ["runs", "added"])


def profile(games: DataFrame) -> DataFrame:
    return games.groupBy("sport").agg(F.count("*").alias("games"), F.avg("result_over").alias("over_rate"), F.avg("total").alias("mean_total"))


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def unpivoted(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """(keys, _feature, _value): a row for each row and feature, the feature as its place in the list.

    Columns go over whole, as Arrow arrays: an expression over hundreds of columns makes code that the JVM doesn't
    compile. Expressions are text, as a call for each part of hundreds of columns takes the driver longer than the rows.
    """
    wide = df.selectExpr(*map(quoted, keys), *(f"CAST({quoted(f)} AS DOUBLE) AS _{i}" for i, f in enumerate(features)))
    many, names = len(keys), [*keys, "_feature", "_value"]

    def turn(batches):
        for b in batches:
            for i in range(b.num_columns - many):
                yield pa.RecordBatch.from_arrays([*b.columns[:many], pa.array(np.full(b.num_rows, i, np.int32)), b.column(many + i)], names=names)

    return wide.mapInArrow(turn, StructType([*wide.schema.fields[:many], StructField("_feature", IntegerType()), StructField("_value", DoubleType())]))


def medians(df: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """(keys, *features): exact medians of all features, to 6 digits; null for a feature without values.

    Approximate quantiles to both sides of each median come first. Values beyond them are moved to them, which leaves the
    median where it is, so that only those between are counted one by one.
    """
    rows, own = unpivoted(df, keys, features), [*keys, "_feature"]
    # not-a-number has no place in a sketch: a feature with any is taken whole
    near = lambda v: f"CASE WHEN NOT isnan(max({v})) THEN percentile_approx({v}, array({0.5 - BESIDE}D, {0.5 + BESIDE}D), {NEAR}) END"
    ends = df.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.expr(f"array({', '.join(near(f'CAST({quoted(f)} AS DOUBLE)') for f in features)})").alias("_all"))
    ends = stored(ends.select(*(f"_{k}" for k in keys), F.posexplode("_all").alias("__feature", "_ends")))
    marked = rows.join(F.broadcast(ends), same(rows, ends, own))  # a row by key and feature
    kept = F.when(F.col("_ends").isNull() | F.col("_value").isNull(), F.col("_value")).otherwise(F.greatest(F.least("_value", F.col("_ends")[1]), F.col("_ends")[0]))
    found = quantiles(marked.select(*own, kept.alias("_value")), own, "_value", [0.5])
    return found.groupBy(*keys).agg(*(F.expr(f"round(max(CASE WHEN _feature = {i} THEN quantiles[0] END), 6) AS {quoted(f)}") for i, f in enumerate(features)))


def top_features(importances: DataFrame, k: int = 20) -> DataFrame:
    """The k largest of (feature, importance); ties by name."""
    return importances.orderBy(F.desc("importance"), "feature").limit(k)
