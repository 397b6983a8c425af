"""Operator 7: URL filters by empirical-Bayes host reputation.

Labelled page outcomes (1: bad) are counted by host, registered domain and suffix. Each level's
rates follow a beta distribution around the level above; its strength comes from the spread of the
rates (moments of the beta-binomial), so a host with few labels leans on its domain, that on its
suffix, and that on all pages. Hosts are ordered by the lower bound of their posterior bad rate: those
of the largest bounds are blocked that have at most `share` of all pages (bounds that agree to
1 / `GRID` stand or fall together), or those above a `limit`, if one is given. Rules given by hand come
first: of those that fit, the longest decides.

Everything is DataFrame expressions: partial aggregation by host, then joins of tables with a row
per host; Spark splits a hot host's pages in the last join. The order is taken over at most 2 * GRID + 1
counts.

A null url or one without `://` has empty host and path and is judged by the prior of all pages.
Null outcomes don't count; repeated outcomes of a page each do. Repeated and null page ids keep a
row each. Without any outcome all hosts have one bound, so nothing is blocked by it unless share is 1.
An empty table gives no rows. Extra columns, whatever their names, are dropped; very long urls are
taken whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Steps of a bound between 0 and 1.
GRID = 10_000
# Frequent public suffixes of two labels, the default where no full list is given.
TWO_LABELS = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "gov.au", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def registered(host: Column, two_labels: tuple[str, ...] = TWO_LABELS) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; an address of digits stands for itself.

    A suffix has one label, or two where those are in two_labels.
    """
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"\.?(:\d*)?$", "")
    labels = F.split(bare, r"\.")
    last, two, three = (F.array_join(F.slice(labels, F.greatest(-n, -F.size(labels)), n), ".") for n in map(F.lit, (1, 2, 3)))
    address = bare.rlike(r"^[\d.]+$|^\[")
    suffix = F.when(address, bare).when(two.isin(*two_labels), two).otherwise(last)
    return F.when(address, bare).when(two.isin(*two_labels), three).otherwise(two), suffix


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (null: none)."""
    fits = [(r, ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)) for r in sorted(rules, key=lambda r: (-len(r.host + r.path), r.host + r.path))]
    pick = lambda value: F.coalesce(*(F.when(fit, F.lit(value(r))) for r, fit in fits), F.lit(None).cast("string"))
    return pick(lambda r: r.host + r.path), pick(lambda r: r.verdict)


def _shrink(level: DataFrame, parent: DataFrame, on: str, key: str, low: float, high: float) -> DataFrame:
    """level (key, on, n, bad) with its posterior mean and strength under the parent's mean."""
    prior = level.join(parent.select(F.col(parent.columns[0]).alias(on), F.col("mean").alias("prior")), on)
    spread = F.col("prior") * (1 - F.col("prior"))
    rate = F.col("bad") / F.col("n")
    # the variance of counts over groups: 1 + (n - 1) * rho times the binomial's
    moments = prior.where("n > 0").agg(
        F.sum(F.col("n") * (rate - F.col("prior")) ** 2).alias("seen"), F.sum(spread).alias("binomial"), F.sum((F.col("n") - 1) * spread).alias("more"))
    rho = F.coalesce(F.greatest(F.lit(1 / (1 + high)), F.least(F.lit(1 / (1 + low)), F.try_divide(F.col("seen") - F.col("binomial"), F.col("more")))), F.lit(1 / (1 + high)))
    strength = moments.select((1 / rho - 1).alias("strength"))
    # one row of moments
    out = prior.crossJoin(F.broadcast(strength))
    return out.select(key, on, "n", "bad", "prior", "strength", ((F.col("bad") + F.col("strength") * F.col("prior")) / (F.col("n") + F.col("strength"))).alias("mean"))


def reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.645, low: float = 1.0, high: float = 1000.0, two_labels: tuple[str, ...] = TWO_LABELS) -> DataFrame:
    """(host, domain, pages, n, bad, mean, lower): the posterior bad rate of each host of pages.

    pages: (page_id, host); outcomes: (page_id, bad 0/1). lower is mean - z standard deviations.
    """
    counted = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    seen = pages.select("page_id", "host").join(counted, "page_id", "left")
    domain, suffix = registered(F.col("host"), two_labels)
    hosts = written(seen.groupBy("host").agg(F.count("*").alias("pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).select("host", domain.alias("domain"), suffix.alias("suffix"), "pages", "n", "bad"))
    total = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*total)
    suffixes = domains.groupBy("suffix").agg(*total)
    top = suffixes.agg(*total).select(F.lit("").alias("all"), ((F.coalesce("bad", F.lit(0)) + 1) / (F.coalesce("n", F.lit(0)) + 2)).alias("mean"))
    by_suffix = _shrink(suffixes.withColumn("all", F.lit("")), top, "all", "suffix", low, high)
    by_domain = _shrink(domains, by_suffix, "suffix", "domain", low, high)
    by_host = _shrink(hosts.select("host", "domain", "n", "bad"), by_domain, "domain", "host", low, high)
    a, b = F.col("bad") + F.col("strength") * F.col("prior"), F.col("n") - F.col("bad") + F.col("strength") * (1 - F.col("prior"))
    sd = F.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
    by_host = by_host.select("host", "n", "bad", "mean", (F.col("mean") - z * sd).alias("lower"))
    return by_host.join(hosts.select("host", "domain", "pages"), "host").select("host", "domain", "pages", "n", "bad", "mean", "lower")


def bound_for(known: DataFrame, share: float) -> DataFrame:
    """One row (least): the smallest step of the bound such that hosts from it up have at most `share` of all pages; null: none."""
    steps = known.groupBy(F.floor(F.col("lower") * GRID).alias("step")).agg(F.sum("pages").alias("pages"))
    # at most 2 * GRID + 1 rows
    running = steps.select("step", F.sum("pages").over(Window.orderBy(F.desc("step"))).alias("above"), F.sum("pages").over(Window.partitionBy()).alias("all"))
    return running.where(F.col("above") <= share * F.col("all")).agg(F.min("step").alias("least"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], share: float = 0.1, limit: float | None = None, z: float = 1.645, two_labels: tuple[str, ...] = TWO_LABELS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, method, bad_rate, bad_lower) for each page.

    outcomes: (page_id, bad). method is block where bad_lower is above limit, or without one among
    the largest that have at most share of all pages, else allow; verdict is the rule's, else the method's.
    """
    host, path = split_url(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    known = written(reputation(rows, outcomes, z, two_labels=two_labels).select("host", "pages", F.col("mean").alias("bad_rate"), "lower"))
    blocked = F.col("lower") > limit if limit is not None else F.floor(F.col("lower") * GRID) >= F.col("least")
    known = known.crossJoin(F.broadcast(bound_for(known, share))) if limit is None else known  # one row
    known = known.select("host", "bad_rate", F.col("lower").alias("bad_lower"), F.when(blocked, "block").otherwise("allow").alias("method"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return rows.join(known, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "method").alias("verdict"), "method", "bad_rate", "bad_lower")
