"""From documents to packed sequences: quality, near-duplicates, secret_scan, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written to
the shared folder and read back as the next one's ``docs``. All but the last return the
columns of ``documents``, whatever else they are called.

Edge cases: a document with a null or empty text is one empty line to the classifier, which scores it; if it
stays, all such documents are one group of near-duplicates, and the mix takes no words of them. Rows that repeat an
id are documents each; equal ones are near-duplicates, so one of them stays. A null id takes part like any other.
If nothing is labelled, every score is 0.5 and nothing is rejected. An empty table gives no rows. Very long texts go
through whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetlens.llm import crf, mixing, packing, secret_scan, simhash
from fleetlens.llm.common import staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the line classifier rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~crf.held_out())
    return crf.accepted(docs, crf.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates."""
    return simhash.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in the texts."""
    return secret_scan.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as documents."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix with their tokens and their place in sequences."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("secret scan", mask_secrets),
    ("mixing", mix),
    ("best-fit packing", pack),
]

# The classifier, the fingerprints, the entropy windows, the draws and the tokenizer
# are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
