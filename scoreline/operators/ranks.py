"""Cumulative counts and exact quantiles of values, without ordering a key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import same
from ..sources.store import stored

#: Blocks that a key's distinct values are cut into.
BLOCKS = 128


def cumulative(counts: DataFrame, keys: list[str], value: str, sums: list[str], blocks: int = BLOCKS) -> DataFrame:
    """counts, which has a row for each (keys, value), with `<s>_upto` (itself included) and `<s>_all` of each column of sums.

    Approximate quantiles cut each key's values into blocks; they only balance the work. Counts and
    edges are written: counts are computed once for three uses, and every use sees the same edges. Blocks are summed along (at most `blocks` rows a key),
    values inside them. A null value comes first, NaN last.
    """
    counts = stored(counts)
    cuts = [k / blocks for k in range(1, blocks)]
    edges = stored(counts.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.percentile_approx(value, cuts, 20 * blocks).alias("_edges")))
    at = F.coalesce(F.size(F.filter("_edges", lambda e: e < F.col(value))), F.lit(0))
    marked = counts.join(edges, same(counts, edges, keys)).select(*counts.columns, at.alias("_block"))
    own = [*keys, "_block"]
    totals = marked.groupBy(*own).agg(*(F.sum(s).alias(s) for s in sums))
    along, every = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    carried = [F.coalesce(F.sum(s).over(along), F.lit(0)).alias(f"_before_{s}") for s in sums] + [F.sum(s).over(every).alias(f"{s}_all") for s in sums]
    totals = totals.select(*(F.col(c).alias(f"_{c}") for c in own), *carried)
    inside = Window.partitionBy(*own).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    local = marked.select("*", *(F.sum(s).over(inside).alias(f"_local_{s}") for s in sums))
    out = local.join(totals, same(local, totals, own))
    return out.select(*counts.columns, *((F.col(f"_before_{s}") + F.col(f"_local_{s}")).alias(f"{s}_upto") for s in sums), *(f"{s}_all" for s in sums))


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, quantiles): exact, interpolated between neighbours; null for keys without a value."""
    counts = rows.groupBy(*keys, value).agg(F.count(value).alias("_n"))
    ranked = cumulative(counts, keys, value, ["_n"])
    first, last = F.col("_n_upto") - F.col("_n"), F.col("_n_upto") - 1
    picked = []
    for i, q in enumerate(shares):
        place = F.lit(float(q)) * (F.col("_n_all") - 1)
        holds = lambda p: F.max(F.when((first <= p) & (p <= last), F.col(value)))
        picked += [F.max(place).alias(f"_p{i}"), holds(F.floor(place)).alias(f"_l{i}"), holds(F.ceil(place)).alias(f"_h{i}")]
    between = lambda i: F.when(F.col(f"_l{i}") == F.col(f"_h{i}"), F.col(f"_l{i}")).otherwise((F.ceil(f"_p{i}") - F.col(f"_p{i}")) * F.col(f"_l{i}") + (F.col(f"_p{i}") - F.floor(f"_p{i}")) * F.col(f"_h{i}"))
    return ranked.groupBy(*keys).agg(*picked).select(*keys, F.array(*(between(i) for i in range(len(shares)))).alias("quantiles"))
