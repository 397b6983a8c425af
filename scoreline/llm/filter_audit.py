"""Operator 12: what each of five filters removes in each of their 120 orders, from one pass over the texts.

A document's failures are a mask over the filters A to E. In an order of the filters, the one that
removes a document is the first that its mask holds, so all orders that begin with the same filters
treat it alike; in lexicographic order (the rank of a permutation by its Lehmer code) these lie next to
each other. So for a mask, the removals at each step cover few intervals of ranks. A mask's counts are
added at an interval's begin and taken off at its end, and a running sum along the 120 ranks gives
every order's removals at once. The intervals are 840 rows at most, whatever the input.

- Conditions A to D are functions of the text. E, a copy of a text with a smaller id, is decided by
  128 bits of SHA-256: rows are first added up by id, then by text and part, where each keeps the
  counts of its smallest id, so a group of copies is one row per part before it meets others.
- Counts of (part, mask) are all that goes on; parts are added up by Spark before and after.

Null texts are empty: no words, no failure of B to D. A part is a source; null is the empty string. Rows
with a null id don't fail E and make no other row fail it; repeated ids and rows keep a row each, equal ones
of the smallest id all pass E. Labels of a null id are left out; of several for an id, one that says so is enough.
Texts of any length are taken whole. An empty table gives no rows. Other columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, written

SEPARATORS = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What a document counts as.
COUNTS = ("n", "good", "toxic")


def conditions(text: Column) -> list[Column]:
    """A to D as booleans: few words, few distinct words, many capitals, odd signs."""
    words = F.filter(F.split(text, SEPARATORS), lambda w: w != "")
    size, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return [size < 50, distinct.cast("long") * 100 < size.cast("long") * 65, capitals.cast("long") * 100 > F.length(text).cast("long") * 5, text.rlike(r"[#$%&*|]")]


def intervals(k: int) -> list[tuple[int, int, int, int, int]]:
    """(mask, step, filter, first, end): ranks first to end - 1 of the k! orders whose step removes that mask, by that filter."""
    out = []
    for mask in range(1, 1 << k):
        passed = [f for f in range(k) if not mask >> f & 1]
        for step in range(len(passed) + 1):
            for before in permutations(passed, step):
                rank, left = 0, list(range(k))
                # Lehmer code of the prefix: each digit weighs the orders of what follows it
                for place, f in enumerate(before):
                    rank += left.index(f) * math.factorial(k - 1 - place)
                    left.remove(f)
                width = math.factorial(k - 1 - step)
                for f in range(k):
                    if mask >> f & 1:
                        first = rank + left.index(f) * width
                        out.append((mask, step + 1, f, first, first + width))
    return out


def _failures(docs: DataFrame, labels: DataFrame | None, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(part, mask, n, good, toxic) over all rows. Written, as all texts are read for it."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions(F.col("text")))), F.lit(0))
    # 128 bits stand for a text
    rows = rows.select("doc_id", "part", mask.alias("mask"), F.substring(F.unhex(F.sha2(F.col("text"), 256)), 1, 16).alias("copy"))
    good = toxic = F.lit(0)
    if labels is not None:
        of = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
        rows = rows.join(of, "doc_id", "left")
        good, toxic = F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0))
    rows = rows.select("doc_id", "part", "mask", "copy", F.lit(1).alias("n"), good.alias("good"), toxic.alias("toxic"))
    counts = [F.sum(c).cast("long").alias(c) for c in COUNTS]
    each = rows.groupBy("doc_id", "copy", "mask", "part").agg(*counts)
    # null ids are neither smaller nor larger than others
    known = F.col("doc_id").isNotNull()
    copies = each.groupBy("copy", "mask", "part").agg(
        F.min("doc_id").alias("low"), *(F.sum(F.when(known, F.col(c))).alias(c) for c in COUNTS), *(F.coalesce(F.sum(F.when(~known, F.col(c))), F.lit(0)).alias(f"{c}_free") for c in COUNTS),
        *(F.min_by(F.when(known, F.col(c)), "doc_id").alias(f"{c}_low") for c in COUNTS))
    # one row for each text and part is left; written, as it has two uses
    copies = written(copies)
    lowest = copies.groupBy("copy").agg(F.min("low").alias("lowest"))
    met = copies.join(lowest, "copy")
    first = F.col("low") == F.col("lowest")
    kept = [(F.col(f"{c}_free") + F.coalesce(F.when(first, F.col(f"{c}_low")), F.lit(0))).alias(c) for c in COUNTS]
    again = [(F.coalesce(c, F.lit(0)) - F.coalesce(F.when(first, F.col(f"{c}_low")), F.lit(0))).alias(c) for c in COUNTS]
    both = F.inline(F.array(F.struct(F.col("mask"), *kept), F.struct((F.col("mask") + 16).alias("mask"), *again)))
    out = written(met.select("part", both).where("n > 0").groupBy("part", "mask").agg(*counts))
    dropped(copies)
    return out


def step_counts(spark: SparkSession, masks: DataFrame, letters: Sequence[str]) -> DataFrame:
    """What each filter does in every order, from (part, mask, n, good, toxic) with one row for each part and mask.

    (part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).
    """
    k = len(letters)
    orders = math.factorial(k)
    # tables of fixed size: the intervals, the orders with their steps
    spans = F.broadcast(spark.createDataFrame(intervals(k), "mask int, step int, filter int, first int, end int"))
    names = ["".join(p) for p in permutations(letters)]
    grid = F.broadcast(spark.createDataFrame([(r, name, s + 1, letters.index(f), f) for r, name in enumerate(names) for s, f in enumerate(name)], "rank int, filter_order string, step int, number int, filter string"))

    hit = masks.join(spans, "mask")
    ends = hit.select("part", "step", F.inline(F.array(*(F.struct(F.col(at).alias("rank"), *((F.col(c) * s).alias(c) for c in COUNTS)) for at, s in (("first", 1), ("end", -1))))))
    change = ends.where(F.col("rank") < orders).groupBy("part", "step", "rank").agg(*(F.sum(c).alias(c) for c in COUNTS))
    fails = [F.sum(F.when(F.col("mask").bitwiseAND(1 << i) > 0, F.col("n")).otherwise(0)) for i in range(k)]
    alone = [F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(k)]
    parts = masks.groupBy("part").agg(F.sum("n").alias("all"), F.array(*fails).alias("fails"), F.array(*alone).alias("alone"))
    every = parts.join(grid)  # 600 rows for each part
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    done = every.join(change, ["part", "step", "rank"], "left").select("part", "all", "fails", "alone", "rank", "filter_order", "step", "number", "filter", *(F.coalesce(F.sum(c).over(along), F.lit(0)).alias(c) for c in COUNTS))
    down = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("part", "number")
    return done.select(
        "part", "filter_order", "step", "filter", (F.col("all") - F.sum("n").over(down)).alias("kept"), F.col("n").alias("removed"), (F.col("fails")[F.col("number")] - F.col("n")).alias("redundant"),
        F.col("alone")[F.col("number")].alias("unique_fails"), F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("n").over(whole).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """step_counts of filters A to E over docs; labels (doc_id, quality, toxic), or None."""
    return step_counts(docs.sparkSession, _failures(docs, labels, id_col, text_col, part_col), "ABCDE")
