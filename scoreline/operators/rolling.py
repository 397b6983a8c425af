"""Rolling form of a team on one side, strictly before each game."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import SIDES, last_rows, same, side_window, with_position

WINDOWS = (3, 5, 10, 20)
ALPHAS = (0.3, 0.5)


#: Rows of a block of the exponential means, at most.
EMA_ROWS = 512


def horizon(alpha: float) -> int:
    """Values after which an exponential weight is below double precision."""
    return 1 + math.ceil(53 * math.log(2) / -math.log(1 - alpha))


def exponential(games: DataFrame, side: str, stats: list[str], alphas=ALPHAS, size: int = EMA_ROWS) -> DataFrame:
    """games with <side>_<stat>_ema<10 alpha>: y = alpha x + (1 - alpha) y over the games before, seeded by the first value.

    Nulls are left out, and don't age what came before. The recurrence is linear, so a team's games
    are cut into blocks of `size`: inside one, running sums of alpha x / (1 - alpha)^n (n values so far)
    give each row's mean but for what the blocks before carry in. Each block leaves a weight (1 - alpha)^n
    and a value; they are folded over the last blocks that hold values, as many as still weigh anything.
    So a row costs a few additions and a block one short array.
    """
    if not stats or not alphas:
        return games
    size = min(size, *(int(500 * math.log(2) / -math.log(1 - a)) for a in alphas))  # powers stay far from overflow
    team, q = f"{side}_team", {a: 1 - a for a in alphas}
    rows = games.withColumn("_block", F.floor((F.row_number().over(side_window(side)) - 1) / size))
    own = ["sport", team, "_block"]
    before = Window.partitionBy(*own).orderBy("game_date", "game_id").rowsBetween(Window.unboundedPreceding, -1)
    x = {s: F.col(f"{side}_{s}").cast("double") for s in stats}
    rows = rows.select("*", *(F.count(x[s]).over(before).alias(f"_n_{s}") for s in stats))
    term = lambda s, a: F.coalesce(a * x[s] * F.pow(F.lit(q[a]), -(F.col(f"_n_{s}") + 1)), F.lit(0.0))
    name = lambda s, a: f"{s}_{int(a * 10)}"
    rows = rows.select("*", *(term(s, a).alias(f"_t_{name(s, a)}") for s in stats for a in alphas))
    rows = rows.select("*", *(F.coalesce(F.sum(f"_t_{name(s, a)}").over(before), F.lit(0.0)).alias(f"_z_{name(s, a)}") for s in stats for a in alphas))

    # a row for each block and stat: values n, what they leave by alpha, the first value
    order = lambda s: F.when(x[s].isNotNull(), F.struct("game_date", "game_id"))
    ends = rows.groupBy(*own).agg(*(c for s in stats for c in (
        F.count(x[s]).alias(f"n_{s}"), F.min_by(x[s], order(s)).alias(f"f_{s}"), *(F.sum(f"_t_{name(s, a)}").alias(f"l_{name(s, a)}") for a in alphas))))
    left = lambda s, a: (F.col(f"l_{name(s, a)}") * F.pow(F.lit(q[a]), F.col(f"n_{s}"))).alias(f"l_{int(a * 10)}")
    long = ends.select(*own, F.inline(F.array(*(F.struct(F.lit(i).alias("stat"), F.col(f"n_{s}").alias("n"), F.col(f"f_{s}").alias("f"), *(left(s, a) for a in alphas)) for i, s in enumerate(stats)))))
    each = Window.partitionBy("sport", team, "stat")
    # held: blocks before that hold values; those numbered held - h to held - 1 are the last h of them
    long = long.withColumn("held", F.count(F.when(F.col("n") > 0, 1)).over(each.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)))
    long = long.withColumn("first", F.first("f", ignorenulls=True).over(each.orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))

    def carried(a: float) -> Column:
        last = F.collect_list(F.when(F.col("n") > 0, F.struct("n", F.col(f"l_{int(a * 10)}").alias("l")))).over(each.orderBy("held").rangeBetween(-horizon(a), -1))
        return F.aggregate(last, F.col("first"), lambda y, b: b["l"] + F.pow(F.lit(q[a]), b["n"]) * y).alias(f"c_{int(a * 10)}")

    long = long.select(*own, "stat", "held", *(carried(a) for a in alphas))
    at = lambda i, c: F.max(F.when(F.col("stat") == i, F.col(c)))
    wide = long.groupBy(*(F.col(c).alias(f"_{c}") for c in own)).agg(*(c for i, s in enumerate(stats) for c in (at(i, "held").alias(f"_h_{s}"), *(at(i, f"c_{int(a * 10)}").alias(f"_c_{name(s, a)}") for a in alphas))))
    mean = lambda s, a: F.when((F.col(f"_n_{s}") > 0) | (F.col(f"_h_{s}") > 0), F.pow(F.lit(q[a]), F.col(f"_n_{s}")) * (F.col(f"_z_{name(s, a)}") + F.col(f"_c_{name(s, a)}")))
    return rows.join(wide, same(rows, wide, own)).select(*games.columns, *(mean(s, a).alias(f"{side}_{s}_ema{int(a * 10)}") for s in stats for a in alphas))


def rolling_columns(side: str, stats: list[str], windows=WINDOWS) -> list[Column]:
    """Mean, deviation (0 for one row), maximum and minimum of each stat."""
    w, out = side_window(side), []
    for stat in stats:
        c = F.col(f"{side}_{stat}")
        for n in windows:
            f = w.rowsBetween(-n, -1)
            name = f"{side}_{stat}_roll{n}"
            out += [F.avg(c).over(f).alias(f"{name}_mean"), F.coalesce(F.stddev_samp(c).over(f), F.lit(0.0)).alias(f"{name}_std"), F.max(c).over(f).alias(f"{name}_max"), F.min(c).over(f).alias(f"{name}_min")]
    return out


def rolling(games: DataFrame, stats: list[str], windows=WINDOWS, alphas=ALPHAS) -> DataFrame:
    """games with rolling columns of both sides, exponential means included; the former are one exchange and one sort a side."""
    for side in SIDES:
        have = [s for s in stats if f"{side}_{s}" in games.columns]
        games = exponential(games.select("*", *rolling_columns(side, have, windows)), side, have, alphas)
    return games


def rolling_side(games: DataFrame, side: str, stats: list[str], windows=WINDOWS, alphas=ALPHAS) -> DataFrame:
    """(sport, game_id, the rolling columns of one side): no other column goes through its exchange and sort."""
    have = [s for s in stats if f"{side}_{s}" in games.columns]
    slim = games.select("sport", "game_id", "game_date", f"{side}_team", *(f"{side}_{s}" for s in have))
    # exponential means first: what they carry is joined while rows are still narrow
    out = exponential(slim, side, have, alphas)
    return out.select("sport", "game_id", *rolling_columns(side, have, windows), *(c for c in out.columns if c not in slim.columns))


def rolling_long(games: DataFrame, stats: list[str], windows=WINDOWS) -> DataFrame:
    """(sport, game_id, side, stat, window, mean, std, max, min): for many stats, where wide rows would be slow.

    Stats are part of the key, so the work spreads over teams x stats.
    """
    halves = []
    for side in SIDES:
        have = [s for s in stats if f"{side}_{s}" in games.columns]
        pairs = F.array(*(F.struct(F.lit(s).alias("stat"), F.col(f"{side}_{s}").cast("double").alias("value")) for s in have))
        halves.append(games.select("sport", "game_id", "game_date", F.lit(side).alias("side"), F.col(f"{side}_team").alias("team"), F.inline(pairs)))
    w = Window.partitionBy("sport", "side", "team", "stat").orderBy("game_date", "game_id")
    frames = [(n, w.rowsBetween(-n, -1)) for n in windows]
    each = F.array(*(F.struct(F.lit(n).alias("window"), F.avg("value").over(f).alias("mean"), F.coalesce(F.stddev_samp("value").over(f), F.lit(0.0)).alias("std"), F.max("value").over(f).alias("max"), F.min("value").over(f).alias("min")) for n, f in frames))
    return halves[0].unionByName(halves[1]).select("sport", "game_id", "side", "stat", each.alias("each")).select("sport", "game_id", "side", "stat", F.inline("each"))


def league_over_rate(games: DataFrame, n: int = 10) -> DataFrame:
    """games with the mean label of the sport's n games before."""
    return last_rows(games, ["sport"], {"league_over_rate": F.avg("result_over")}, n)


def team_over_rate(games: DataFrame, n: int = 10) -> DataFrame:
    return games.withColumn("team_over_rate", F.avg("result_over").over(side_window("home").rowsBetween(-n, -1)))


def time_split(games: DataFrame, keys: list[str], holdout: float = 0.85, train: float = 0.85) -> DataFrame:
    """games with `part`: train, validation or holdout by position in time."""
    h = F.floor(F.col("rows") * holdout)
    v = F.floor(h * train)
    part = F.when(F.col("position") < v, "train").when(F.col("position") < h, "validation").otherwise("holdout")
    return with_position(games, keys).withColumn("part", part).drop("position", "rows")


def recent_split(games: DataFrame, keys: list[str], recent: int, least: int = 100) -> DataFrame:
    """games with `recent`: whether a row is among the last ones, leaving at least `least` before."""
    split = F.greatest(F.lit(least), F.col("rows") - recent)
    return with_position(games, keys).withColumn("recent", F.col("position") >= split).drop("position", "rows")
