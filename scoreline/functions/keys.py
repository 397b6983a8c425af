"""Order, sides and positions: what all point-in-time operators share.

Rows are ordered by (game_date, game_id) everywhere, so results never depend on how ties fall.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.store import stored

SIDES = ("home", "away")
OTHER = {"home": "away", "away": "home"}


def epoch(ts: str = "game_date") -> Column:
    """Whole seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def side_window(side: str) -> WindowSpec:
    """A team's games on one side, in order."""
    return Window.partitionBy("sport", f"{side}_team").orderBy("game_date", "game_id")


def team_window() -> WindowSpec:
    """A team's games on both sides, in order, over appearances()."""
    return Window.partitionBy("sport", "team").orderBy("game_date", "game_id")


def pair_window() -> WindowSpec:
    """Games of an unordered pair of teams."""
    return Window.partitionBy("sport", F.least("home_team", "away_team"), F.greatest("home_team", "away_team"))


def appearances(games: DataFrame, *more: str) -> DataFrame:
    """Each game twice: (sport, game_id, game_date, side, team, opponent, scored, allowed, *more). Games are computed once for both sides."""

    def half(side: str) -> Column:
        o = OTHER[side]
        return F.struct(F.lit(side).alias("side"), F.col(f"{side}_team").alias("team"), F.col(f"{o}_team").alias("opponent"), F.col(f"{side}_score").alias("scored"), F.col(f"{o}_score").alias("allowed"))

    return games.select("sport", "game_id", "game_date", F.inline(F.array(half("home"), half("away"))), *more)


def beside(games: DataFrame, team_rows: DataFrame, values: list[str], default=None) -> DataFrame:
    """games with home_<v> and away_<v> for each value of team_rows (sport, game_id, side, ...).

    One aggregation puts both sides on a row, so games join once.
    """
    at = lambda v, side: F.max(F.when(F.col("side") == side, F.col(v))).alias(f"{side}_{v}")
    both = team_rows.groupBy("sport", "game_id").agg(*(at(v, s) for v in values for s in SIDES))
    out = games.join(both, ["sport", "game_id"], "left")
    return out if default is None else out.fillna(default, [f"{s}_{v}" for v in values for s in SIDES])


def same(left: DataFrame, right: DataFrame, on: list[str]) -> Column:
    """left's columns equal right's of the same names behind `_`, nulls included."""
    return reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[f"_{c}"]) for c in on))


def cut(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with `_block`, numbers that follow the given order. Written.

    Spark's range partitioner cuts the order by a sample, so blocks are even whatever the columns'
    types and however many rows a day or a key has; rows that are equal in order share a block. Written,
    so that every use sees the same cuts.
    """
    return stored(df.repartitionByRange(*order).withColumn("_block", F.spark_partition_id()))


def in_blocks(df: DataFrame, keys: list[str], date: str = "game_date", id_: str = "game_id") -> DataFrame:
    """df cut by (keys, date, id), nulls first."""
    return cut(df, [F.col(c).asc_nulls_first() for c in (*keys, date, id_)])


def with_position(df: DataFrame, keys: list[str], date: str = "game_date", id_: str = "game_id") -> DataFrame:
    """df with `position` (from 0) and `rows` in its key's whole order, without ordering a key in one task.

    Blocks are counted, their counts summed along (a row per block), and rows numbered inside blocks. Null dates
    come first, then null ids; null keys make a key of their own. Ids may be numbers or text.
    """
    marked = in_blocks(df, keys, date, id_)
    own = [*keys, "_block"]
    counts = marked.groupBy(*own).agg(F.count("*").alias("n"))
    along = Window.partitionBy(*keys).orderBy("_block")
    before = F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*(F.col(c).alias(f"_{c}") for c in own), before.alias("before"), F.sum("n").over(Window.partitionBy(*keys)).alias("rows"))
    inside = Window.partitionBy(*own).orderBy(date, id_)
    return marked.join(counts, same(marked, counts, own)).select(*df.columns, (F.col("before") + F.row_number().over(inside) - 1).alias("position"), "rows")


def last_rows(df: DataFrame, keys: list[str], values: dict[str, Column], n: int, date: str = "game_date", id_: str = "game_id", bucket: int = 50_000) -> DataFrame:
    """df with aggregates over the n rows before each in its key's whole order.

    values: name -> aggregate. Positions cut the order into buckets; each bucket also gets the n
    rows before it, so a key is spread over tasks.
    """
    at = with_position(df, keys, date, id_)
    own, spill = F.floor(F.col("position") / bucket), F.floor((F.col("position") + n) / bucket)
    doubled = at.withColumn("bucket", F.explode(F.array_distinct(F.array(own, spill)))).withColumn("own", F.col("bucket") == own)
    w = Window.partitionBy(*keys, "bucket").orderBy("position").rowsBetween(-n, -1)
    return doubled.select("*", *(v.over(w).alias(k) for k, v in values.items())).where("own").drop("bucket", "own", "position", "rows")
