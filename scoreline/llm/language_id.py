"""Operator 9: language identification by Bayesian evidence fusion.

Four kinds of evidence make a posterior over languages for each document:
- text: mean log-likelihood of the text's byte trigrams (hashed to `CELLS` cells) under each
  language's multinomial, times at most `text_weight` trigrams, since neighbours aren't independent;
- the declared markup language and the address suffix: how often each occurs with each language;
- the host: a prior smoothed along host, registered domain (where there is a url) and all documents.
The last three are counted over all documents by grouped aggregation of the text's own best
language. The text model is fitted on at most `sample` labelled documents for each language, those
with the smallest hash of id (the bound is a parameter; everything else covers all documents).

A document is rejected where its text has no letters, where the posterior of its best language is
below `least`, or where its text is of none of the languages: the mean log-likelihood of its
trigrams under the best of them is below that of a background in which all cells are equally likely.
`markup` makes the text and the declared language of raw pages. Null and empty texts have no letters. Null declarations, suffixes and hosts are no
evidence. Repeated and null ids keep a row each. Without any labelled document there is no model
and every document is rejected with a null language. Ties go to the first language in order.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import raw_texts, slices, tidy, written

CELLS = 1 << 15
_SQUEEZE = np.arange(256, dtype=np.uint32)
_SQUEEZE[65:91] += 32
# digits, punctuation and white space are one class: they say little about a language
_SQUEEZE[[b for b in range(128) if not chr(b).isalpha()]] = 32

#: Mean log-likelihood of a trigram where all cells are equally likely.
BACKGROUND = -float(np.log(CELLS))
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)", re.I | re.S)
_TAG = re.compile(r"</?[A-Za-z!?][^<>]*>")
_DECLARED = re.compile(r"<html\b[^<>]*?\s(?:xml:)?lang\s*=\s*[\"']?\s*([A-Za-z]+)", re.I)


def visible(page: str | None) -> tuple[str | None, str | None]:
    """A page's text without tags, scripts, styles and comments, and the language its html tag declares."""
    if page is None:
        return None, None
    shown = _HIDDEN.sub(" ", page)
    declared = _DECLARED.search(shown)
    return html.unescape(_TAG.sub(" ", shown)), declared and declared[1]


def markup(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, declared) for each page."""

    @tidy
    def run(batches):
        for batch in slices(batches, "html"):
            found = [visible(h) for h in batch.column("html").to_pylist()]
            text, declared = (pa.array([f[k] for f in found], pa.string()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), text, declared], names=["page_id", "url", "text", "declared"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, declared string")


def cells_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of all byte trigrams of the texts, the text number of each, and the letters of each text."""
    buf, starts, ends = raw_texts(column)
    if not len(starts) or not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    low, high = int(starts[0]), int(ends.max())
    b = _SQUEEZE[buf[low : max(high, low)]]
    owner = np.repeat(np.arange(len(starts)), ends - starts) if int((ends - starts).sum()) == len(b) else None
    if owner is None:  # nulls may leave gaps
        b = np.concatenate([_SQUEEZE[buf[s:e]] for s, e in zip(starts, ends, strict=True)])
        owner = np.repeat(np.arange(len(starts)), ends - starts)
    letters = np.bincount(owner[b != 32], minlength=len(starts))
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), letters
    code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    cell = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)
    inside = (owner[:-2] == owner[2:]) & (code != 0x202020)
    return cell[inside].astype(np.int64), owner[:-2][inside], letters


def fit(labelled: DataFrame, sample: int = 2_000, alpha: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log-probabilities (language, cell), from (doc_id, text, label).

    About 1.2 x `sample` texts a language, by a share of hashes (all, where it has fewer; repeated rows share
    one hash); one driver table of languages x CELLS floats, so labels must be few.
    """
    rows = labelled.where("label is not null and text is not null").select("label", "text", F.xxhash64("doc_id", "text").alias("key"))
    # the smallest keys of each label, by partial aggregation: no label is sorted in one task
    edge = rows.groupBy("label").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), F.lit(1.2 * sample) / F.col("n"))
    picked = rows.join(F.broadcast(edge), "label").where(F.pmod("key", F.lit(1 << 20)) < share * (1 << 20)).select("label", "text")

    @tidy
    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            cell, owner, _ = cells_of(batch.column("text"))
            names, codes = np.unique(np.array(batch.column("label").to_pylist(), object).astype(str), return_inverse=True)
            table = np.bincount(codes[owner] * CELLS + cell, minlength=len(names) * CELLS).reshape(len(names), CELLS)
            for n, row in zip(names.tolist(), table, strict=True):
                totals[n] = totals.get(n, 0) + row
        for n, row in totals.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_pydict({"label": pa.array([n] * len(at), pa.string()), "cell": pa.array(at, pa.int64()), "n": pa.array(row[at], pa.int64())})

    counts = picked.mapInArrow(count, "label string, cell long, n long").groupBy("label", "cell").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["label"].unique())
    table = np.full((len(languages), CELLS), alpha)
    if languages:
        np.add.at(table, (np.searchsorted(languages, counts["label"].to_numpy(str)), counts["cell"].to_numpy()), counts["n"].to_numpy())
    return languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def text_scores(rows: DataFrame, shared: Broadcast, text_weight: float = 60.0) -> DataFrame:
    """rows (doc_id, key, declared, suffix, domain, host, text) without the text, with letters, log-likelihoods and the best's mean for a trigram (null: no trigrams)."""
    @tidy
    def run(batches):
        logp = shared.value
        for batch in slices(batches, "text", 1 << 19):
            cell, owner, letters = cells_of(batch.column("text"))
            n = np.bincount(owner, minlength=batch.num_rows)
            score = np.stack([np.bincount(owner, weights=row[cell], minlength=batch.num_rows) for row in logp]) if len(logp) else np.zeros((0, batch.num_rows))
            mean = pa.array(score.astype(float).max(axis=0, initial=-np.inf) / np.maximum(n, 1), pa.float64(), mask=n == 0)
            score = score * np.minimum(1.0, text_weight / np.maximum(n, 1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(logp)), pa.array(np.ascontiguousarray(score.T).ravel(), pa.float64()))
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(letters, pa.int64()), mean, lists], names=[*kept, "letters", "mean", "scores"])

    return rows.mapInArrow(run, "doc_id long, key long, declared string, suffix string, domain string, host string, letters long, mean double, scores array<double>")


def _best(values: Column) -> Column:
    return F.array_position(values, F.array_max(values)).cast("int")


def _shares(counts: DataFrame, by: str, size: int, smooth: float) -> DataFrame:
    """(by, evidence): for each value the log of P(value | language), smoothed; one row per value."""
    every = counts.groupBy("best").agg(F.sum("n").alias("all"))
    values = counts.where(F.col(by).isNotNull()).select(by).distinct()
    number = values.agg(F.count("*").alias("values"))
    grid = values.join(F.broadcast(F.broadcast(number)), how="cross").withColumn("best", F.explode(F.sequence(F.lit(1), F.lit(size))))
    seen = counts.where(F.col(by).isNotNull()).groupBy(by, "best").agg(F.sum("n").alias("n"))
    full = grid.join(seen, [by, "best"], "left").join(F.broadcast(every), "best", "left").fillna(0, ["n", "all"])
    log = F.log((F.col("n") + smooth) / (F.col("all") + smooth * F.col("values")))
    return full.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("best", log.alias("e")))), lambda x: x["e"]).alias("evidence_" + by))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang", url_col: str | None = None, host_col: str | None = "source",
             text_weight: float = 60.0, smooth: float = 1.0, strength: float = 20.0, least: float = 0.5, background: float = BACKGROUND) -> DataFrame:
    """(doc_id, key, declared, language, confidence, text_language, letters, keep) for each document.

    key is the text's hash; host_col is used where there is no url. language and text_language are
    null where there is no evidence at all.
    """
    languages, size = model[0], len(model[0])
    null = F.lit(None).cast("string")
    host = F.col(host_col).cast("string") if host_col else null
    domain, suffix = null, null
    if url_col:
        from .url_reputation import registered, split_url

        found = split_url(F.col(url_col).cast("string"))[0]
        host = F.nullif(found, F.lit(""))
        domain, suffix = registered(host)
    declared = F.nullif(F.lower(F.regexp_extract(F.col(declared_col).cast("string"), "^[A-Za-z]+", 0)), F.lit("")) if declared_col else null
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("key"), declared.alias("declared"), suffix.alias("suffix"), domain.alias("domain"), host.alias("host"), F.col(text_col).cast("string").alias("text"))
    if not size:
        return rows.select("doc_id", "key", "declared", null.alias("language"), F.lit(0.0).alias("confidence"), null.alias("text_language"), F.lit(0).cast("long").alias("letters"), F.lit(False).alias("keep"))
    shared = docs.sparkSession.sparkContext.broadcast(model[1])  # languages x CELLS floats
    scored = written(text_scores(rows, shared, text_weight).withColumn("best", F.when(F.col("letters") > 0, _best(F.col("scores")))))
    shared.destroy()
    counts = scored.where("best is not null").groupBy("declared", "suffix", "domain", "host", "best").agg(F.count("*").alias("n"))
    counts = written(counts)

    # priors by language: all documents, then domain, then host, each shrunk to the one before
    wide = lambda key: [F.sum(F.when(F.col("best") == i + 1, F.col("n")).otherwise(0)).alias(f"{key}{i}") for i in range(size)]
    top = counts.agg(*wide("t")).select(F.array(*((F.coalesce(F.col(f"t{i}"), F.lit(0)) + smooth) for i in range(size))).alias("c")).select(F.transform("c", lambda x: x / F.aggregate("c", F.lit(0.0), lambda a, y: a + y)).alias("all_prior"))
    total = lambda key: sum((F.col(f"{key}{i}") for i in range(size)), F.lit(0.0))
    shrunk = lambda key, prior: F.array(*(((F.col(f"{key}{i}") + strength * F.col(prior)[i]) / (total(key) + strength)) for i in range(size)))
    domains = counts.where("domain is not null").groupBy("domain").agg(*wide("d")).crossJoin(F.broadcast(top)).select("domain", shrunk("d", "all_prior").alias("domain_prior"))
    # a host without a domain is shrunk to all documents, so nothing is counted twice
    hosts = counts.where("host is not null").groupBy("host", "domain").agg(*wide("h")).join(domains, "domain", "left").crossJoin(F.broadcast(top))
    hosts = hosts.withColumn("above", F.coalesce("domain_prior", "all_prior")).select("host", shrunk("h", "above").alias("host_prior"))
    hosts, by_declared, by_suffix = written(hosts), written(_shares(counts, "declared", size, smooth)), written(_shares(counts, "suffix", size, smooth))

    flat = F.array_repeat(F.lit(0.0), size)
    out = scored.join(hosts, "host", "left").join(by_declared, "declared", "left").join(by_suffix, "suffix", "left").crossJoin(F.broadcast(top))
    prior = F.coalesce("host_prior", "all_prior")
    parts = [F.when(F.col("letters") > 0, F.col("scores")).otherwise(flat), F.transform(prior, lambda x: F.log(x)), F.coalesce("evidence_declared", flat), F.coalesce("evidence_suffix", flat)]
    log = F.array(*(sum((p[i] for p in parts[1:]), parts[0][i]) for i in range(size)))
    out = out.withColumn("log", log).withColumn("top", F.array_max("log"))
    out = out.withColumn("confidence", 1 / F.aggregate("log", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))).withColumn("at", _best(F.col("log")))
    names = F.array(*map(F.lit, languages))
    return out.select("doc_id", "key", "declared", F.element_at(names, F.col("at")).alias("language"), "confidence", F.element_at(names, F.col("best")).alias("text_language"), "letters", ((F.col("letters") > 0) & (F.col("confidence") >= least) & F.coalesce(F.col("mean") >= background, F.lit(True))).alias("keep"))
