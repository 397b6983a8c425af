"""Operator 10: mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a target in words: the sources share a budget by weight, a source's target stops
at `max_ratio` times its own size, and the excess is shared again by weight until none is above.
A source takes as many complete epochs of all its documents as fit its target; the rest comes from
a weighted sample without replacement: each document draws the key -ln(u) / quality weight, u from
a hash of its id, and documents are taken in ascending key order until their prefix sum reaches the
rest. The document on the boundary is cut there, so each source takes its target to the word.

The prefix sums don't need a source in one task: keys fall into `BUCKETS` ordered buckets, bucket
totals (with partial aggregation) are summed along, and only the boundary bucket's documents, a
small part of a source, are ordered row by row.

Null texts have size 0 and are taken as often as complete epochs say; a null source is a source of
its own, last in order; documents with equal ids share a key and are told apart by their text's
hash, equal rows by nothing (their order doesn't matter). Null, zero or negative quality weights
count as 1. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Ordered buckets of the sampling keys in each source.
BUCKETS = 4096
#: White space that parts words, for the regular expressions of Spark and DuckDB.
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(id_col: str, seed: str) -> Column:
    """A double in (0, 1) from the first 52 bits of md5 of seed and id."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, max_ratio: float = 2.0) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size): one row per source.

    Weights repeat along the sources in code-point order, null last. The capped shares have a
    closed form: in ascending order of max_ratio * size / weight the first k sources are capped,
    and the level is what is left by the weight left; k is the first where the next isn't above.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    at = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (at + 1).cast("int")))
    every = Window.partitionBy()
    ranked = ranked.withColumn("cap", max_ratio * F.col("source_size")).withColumn("full", F.least(share * F.sum("source_size").over(every), F.sum("cap").over(every)))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("full") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    found = ranked.withColumn("level", level)
    # once a source isn't capped, no later one is: its level holds for the rest
    open_level = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(every)
    return found.withColumn("open", open_level.getField("level")).select(
        "source", "source_size", "weight", F.when(F.col("open").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("open") * F.col("weight"))).alias("target"))


def take(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, max_ratio: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_key, size, source, source_size, target, epochs, part, taken) for every row of docs.

    taken = epochs * size + part words; text_key is the text's hash. `quality` gives (doc_id,
    quality_weight) with unique ids; other documents weigh 1.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), size_of(text_col).alias("size"), F.col(source_col).cast("string").alias("source"))
    if quality is not None:
        rows = rows.join(quality.select("doc_id", "quality_weight"), "doc_id", "left")
    else:
        rows = rows.withColumn("quality_weight", F.lit(1.0))
    weight = F.when(F.col("quality_weight") > 0, F.col("quality_weight")).otherwise(1.0)
    # -ln(u) / w is exponential; 1 - exp(-key) spreads it over the buckets in the same order
    rows = written(rows.withColumn("key", -F.log(uniform("doc_id", seed)) / weight).drop("quality_weight"))
    bucket = F.floor((1 - F.exp(-F.col("key"))) * BUCKETS)
    per_source = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_ratio)
    per_source = per_source.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    per_source = per_source.withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size"))).drop("weight")
    totals = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("before", F.coalesce(F.sum("words").over(along), F.lit(0)))
    edge = totals.join(per_source, totals.source.eqNullSafe(per_source.source)).where("before <= rest and rest < before + words").select(totals.source.alias("edge_source"), F.col("bucket").alias("edge_bucket"), F.col("before").alias("edge_before"))
    # (source, ...) has a row per source: small, but sources may be many, so Spark sizes the join itself
    known = per_source.join(edge, per_source.source.eqNullSafe(edge.edge_source), "left").drop("edge_source")
    known = written(known.withColumnRenamed("source", "known_source"))
    held = rows.withColumn("bucket", bucket).join(known, rows.source.eqNullSafe(known.known_source)).drop("known_source")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = held.where("bucket = edge_bucket").withColumn("before", F.col("edge_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    at_edge = at_edge.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before"))))
    clear = held.where("edge_bucket is null or bucket <> edge_bucket").withColumn("part", F.when((F.col("rest") > 0) & (F.col("edge_bucket").isNull() | (F.col("bucket") < F.col("edge_bucket"))), F.col("size")).otherwise(0))
    names = ["doc_id", "text_key", "size", "source", "source_size", "target", F.col("epochs").cast("long"), F.col("part").cast("long")]
    return clear.select(*names).unionByName(at_edge.select(*names)).withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))


def label_weights(labels: DataFrame, good: float = 2.0, bad: float = 0.5) -> DataFrame:
    """(doc_id, quality_weight) from labels (doc_id, quality 0/1): a document's mean quality between bad and good."""
    mean = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("mean"))
    return mean.select("doc_id", (F.lit(bad) + (good - bad) * F.col("mean")).alias("quality_weight"))


def mixed(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix itself with docs' columns: a row for each complete epoch, and one cut to its first `part` words.

    `plan` is what take() returns for these docs.
    """
    own = docs.columns
    source = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)))
    id_, text = (F.col(f"c{own.index(c)}") for c in (id_col, text_col))
    # equal rows on a boundary: each takes what the one that takes most takes
    again = plan.where("epochs > 0 or part > 0").groupBy("doc_id", "text_key").agg(F.max("epochs").alias("epochs"), F.max("part").alias("part"), F.max("size").alias("size"))
    joined = source.join(again, id_.cast("long").eqNullSafe(again.doc_id) & F.xxhash64(text).eqNullSafe(again.text_key))
    # what each row repeats is part of the row, so no partition grows beyond max_ratio times
    counts = F.concat(F.array_repeat(F.col("size"), F.col("epochs").cast("int")), F.when(F.col("part") > 0, F.array(F.col("part"))).otherwise(F.array().cast("array<long>")))
    rows = joined.withColumn("take", F.explode(counts))
    new = F.when(F.col("take") >= F.col("size"), text).otherwise(cut_words(text, F.col("take")))
    return rows.select(*(new if c == text_col else F.col(f"c{i}") for i, c in enumerate(own))).toDF(*own)


def cut_words(text: Column, n: Column) -> Column:
    """The text's first n words joined by one space."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.lit(1), n.cast("int")), " ")
