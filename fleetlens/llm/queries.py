"""The registered queries of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import collocations, crf, hard_negatives, licenses, mixing, nnls_packing, packing, quality_rules, secret_scan, simhash, suffix_dedup, topk, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(query):
    QUERIES[query.__name__] = query
    return query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op1_warc(spark, sf_dir):
    """Write the pages as segmented WARC archives, read them back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


@register
def op2_quality_rules(spark, sf_dir):
    """Counts of each document and the verdict of thresholds by language and source."""
    found = quality_rules.verdicts(table(spark, sf_dir, "documents"))
    return found.withColumn("failed", F.array_join("failed", ","))


@register
def op3_simhash(spark, sf_dir):
    """Fingerprint and class of near-duplicates of each document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


@register
def op4_mixing(spark, sf_dir):
    """Words of each document that the mix of all sources takes."""
    return mixing.taken(table(spark, sf_dir, "documents"))


@register
def op5_licenses(spark, sf_dir):
    """Licences that each document states, by rules over its sentences."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@register
def op6_topk(spark, sf_dir):
    """The five best candidates of every fiftieth vector."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@register
def op7_secrets(spark, sf_dir):
    """Secrets of each document by patterns and entropy."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@register
def op8_packing(spark, sf_dir):
    """All documents as pieces in sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


@register
def op10_quality_crf(spark, sf_dir):
    """Score of each document by a line classifier learned from two thirds of the ids."""
    docs = table(spark, sf_dir, "documents")
    model = crf.train(docs, table(spark, sf_dir, "labels").where(~crf.held_out()))
    found = crf.scores(docs, model)
    return found.select("doc_id", crf.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register
def op9_suffix_dedup(spark, sf_dir):
    """Bytes of each document that repeat from a document with a smaller id."""
    return suffix_dedup.removed(table(spark, sf_dir, "documents")).drop("spans")


@register
def op11_hard_negatives(spark, sf_dir):
    """Ten negatives for each positive of every hundredth vector."""
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 100 = 0"), label)


@register
def op12_nnls_packing(spark, sf_dir):
    """All documents as pieces in sequences of 1024 tokens, nearly without padding."""
    packed = nnls_packing.pack(table(spark, sf_dir, "documents"))
    crc = F.crc32("ids").alias("ids_crc32")
    return packed.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")


@register
def op13_collocations(spark, sf_dir):
    """The first 2000 phrase collocations of each language."""
    return collocations.mine(table(spark, sf_dir, "documents"))
