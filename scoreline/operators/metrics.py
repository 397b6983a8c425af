"""Scores of probabilities and of the bets they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import in_blocks, same
from ..functions.scalars import confidence, edge
from .ranks import cumulative

EPS = 2.220446049250313e-16
STAKE, WIN = 100.0, 100.0 / 110.0
#: Bin edges as a linear space of doubles gives them (0.3 is 0.30000000000000004).
EDGES = [i * 0.1 for i in range(10)] + [1.0]


def classification(scored: DataFrame, keys: list[str], sure: float = 0.6) -> DataFrame:
    """Accuracy, log loss, Brier score, mean edge, lift and accuracy of sure bets by key."""
    p, y = F.col("prob"), F.col("label")
    right = ((p >= 0.5).cast("int") == y).cast("double")
    c = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))
    high = confidence(p) >= sure
    return scored.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(right).alias("accuracy"), F.avg(-(y * F.log(c) + (1 - y) * F.log(1 - c))).alias("log_loss"), F.avg(F.pow(p - y, F.lit(2.0))).alias("brier"),
        F.avg(edge(p)).alias("mean_edge"), F.avg(F.when(high, right)).alias("sure_accuracy"), F.count_if(high).alias("sure_n"))


def lift(accuracy: Column) -> Column:
    return (accuracy - 0.5) / 0.5 * 100


def auc(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, auc) by rank sums over counts per distinct score; 0.5 with one class."""
    per = scored.groupBy(*keys, "prob").agg(F.sum("label").alias("pos"), F.count("*").alias("n")).withColumn("neg", F.col("n") - F.col("pos"))
    part = cumulative(per, keys, "prob", ["neg"]).withColumn("part", F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2.0))
    s = part.groupBy(*keys).agg(F.sum("part").alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    return s.select(*keys, F.when((F.col("p") == 0) | (F.col("q") == 0), 0.5).otherwise(F.col("u") / (F.col("p").cast("double") * F.col("q"))).alias("auc"))


def bets(scored: DataFrame) -> DataFrame:
    """scored with confidence, flat profit and Kelly stake and profit of each bet."""
    p = F.col("prob")
    won = (p >= 0.5).cast("int") == F.col("label")
    side = F.greatest(p, 1 - p)
    kelly = F.greatest(F.lit(0.0), F.least(F.lit(0.25), (side * (WIN + 1) - 1) / WIN)) * STAKE
    return scored.select("*", confidence(p).alias("confidence"), won.alias("won"), F.when(won, STAKE * WIN).otherwise(-STAKE).alias("flat_pnl"), kelly.alias("kelly_stake"), F.when(won, kelly * WIN).otherwise(-kelly).alias("kelly_pnl"))


def returns(b: DataFrame, keys: list[str], least: float = 0.0) -> DataFrame:
    """ROI of both stakes over bets x 100, Sharpe ratio of the flat profits."""
    f = b.where(F.col("confidence") >= least)
    sd = F.stddev_samp("flat_pnl")
    sharpe = F.when((F.count("*") < 2) | (sd < 1e-10), 0.0).otherwise(F.avg("flat_pnl") / sd * F.sqrt(F.lit(252.0)))
    return f.groupBy(*keys).agg(
        F.count("*").alias("bets"), F.sum("flat_pnl").alias("flat_total"), F.sum("kelly_pnl").alias("kelly_total"), (F.sum("flat_pnl") / (F.count("*") * STAKE)).alias("roi_flat"),
        (F.sum("kelly_pnl") / (F.count("*") * STAKE)).alias("roi_kelly"), sharpe.alias("sharpe"))


def equity(b: DataFrame, keys: list[str], pnl: str = "flat_pnl", date: str = "game_date", id_: str = "game_id") -> DataFrame:
    """b with cumulative profit, its running peak and the drawdown, without ordering a key in one task.

    Each block keeps its sum and its highest prefix; sums and peaks are carried along the blocks, then
    added to the running values inside. Rows of a null date, id or key keep their place (keys.with_position).
    """
    marked = in_blocks(b, keys, date, id_)
    own = [*keys, "_block"]
    inside = Window.partitionBy(*own).orderBy(date, id_).rowsBetween(Window.unboundedPreceding, 0)
    local = marked.withColumn("local", F.sum(pnl).over(inside)).withColumn("local_peak", F.max("local").over(inside))
    totals = local.groupBy(*own).agg(F.sum(pnl).alias("sum"), F.max("local").alias("top"))
    along = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("carry", F.coalesce(F.sum("sum").over(along), F.lit(0.0))).withColumn("peak_before", F.max(F.col("carry") + F.col("top")).over(along))
    totals = totals.select(*(F.col(c).alias(f"_{c}") for c in own), "carry", "peak_before")
    peak = F.greatest(F.col("peak_before"), F.col("carry") + F.col("local_peak"))
    out = local.join(totals, same(local, totals, own)).withColumn("cumulative", F.col("carry") + F.col("local")).withColumn("peak", peak)
    return out.select(*b.columns, "cumulative", "peak", ((F.col("peak") - F.col("cumulative")) / (F.abs("peak") + 1e-9)).alias("drawdown"))


def max_drawdown(b: DataFrame, keys: list[str]) -> DataFrame:
    return equity(b, keys).groupBy(*keys).agg(F.max("drawdown").alias("max_drawdown"))


def calibration(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bin, mean_prob, over_rate, n) for ten equal bins, the last closed; empty ones are null."""
    p = F.col("prob")
    at = F.least(F.lit(9), sum((F.when(p >= e, 1).otherwise(0) for e in EDGES[1:]), F.lit(0)))
    found = scored.groupBy(*keys, at.alias("bin")).agg(F.round(F.avg("prob"), 4).alias("mean_prob"), F.round(F.avg("label"), 4).alias("over_rate"), F.count("*").alias("n"))
    grid = scored.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return grid.join(found, [*keys, "bin"], "left").fillna(0, ["n"])
