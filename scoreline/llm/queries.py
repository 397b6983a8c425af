"""The registered queries of the corpus operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filter_audit, flat_ids, language_id, lexical, mips, mixing, ngram_join, packing, sentence_pieces, substring_dedup, transport_stream, url_reputation, warc
from .common import table
from .oracles import ORACLE_SQL

VOCABULARY = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
RULES = [
    url_reputation.Rule("com", "/en/", "block"),
    url_reputation.Rule("example.com", "/en/7", "allow"),
    url_reputation.Rule("net", "/de/", "allow"),
    url_reputation.Rule("example.net", "/de/8", "block"),
    url_reputation.Rule("org", "/es/", "block"),
]


def op1_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.digests(transport_stream.store_payloads(table(spark, sf_dir, "documents")))


def op2_mips(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return mips.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), end_id=2, with_ids=False)
    return pieces.drop("ids")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, _ = warc.write_archives(warc.decide(table(spark, sf_dir, "pages")))
    return warc.resolve(warc.read_records(spark, folder))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removed(table(spark, sf_dir, "documents"))


def op7_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("long")
    return url_reputation.judge(table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")), RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_flat_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, _ = flat_ids.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), end_id=1)
    return flat_ids.read_ids(spark, folder, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document (text and source) and each page (text, html tag, suffix and host)."""
    docs, pages = table(spark, sf_dir, "documents"), language_id.markup(table(spark, sf_dir, "pages"))
    model = language_id.fit(docs.select("doc_id", "text", F.col("lang").alias("label")))
    # lang is the label that the model is fitted on, so it is no declaration
    of_docs = language_id.identify(docs, model, declared_col=None).withColumn("page_id", F.lit(None).cast("long"))
    of_pages = language_id.identify(pages, model, id_col="page_id", declared_col="declared", url_col="url", host_col=None).withColumnRenamed("doc_id", "page_id").withColumn("doc_id", F.lit(None).cast("long"))
    return of_docs.unionByName(of_pages).select("doc_id", "page_id", "declared", "language", "confidence", "text_language", "letters", "keep")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = mixing.label_weights(table(spark, sf_dir, "labels"))
    taken = mixing.take(table(spark, sf_dir, "documents"), quality=quality).drop("text_key")
    return taken.withColumn("target", F.round("target", 6) + F.lit(0.0))


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_ALL = (
    op1_transport_stream, op2_mips, op3_ngram_join, op4_packing, op5_warc, op6_substring_dedup, op7_url_reputation, op8_flat_ids, op9_language_id, op10_mixing, op11_sentence_pieces,
    op12_filter_audit, op13_lexical_search)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

__all__ = ["ORACLE_SQL", "QUERIES"]
