"""The corpus pipeline: quality classifier, quality rules, near-duplicate removal, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm.pii_bootstrap import redact
from brindle.llm.queries import vocabulary
from brindle.llm.robust_outliers import keep_regular
from brindle.llm.shared import cut_alone, drop_cut
from brindle.llm.shingle_dedup import keep_distinct
from brindle.llm.site_bayes import keep_good
from brindle.llm.vector_packing import pack_documents


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the site-level classifier rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their language and source go."""
    return keep_regular(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays: fingerprints by Golay keys, and all other links of five-word shingles at similarity 0.8."""
    return keep_distinct(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced in the texts; n_chars follows."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return pack_documents(docs, *vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("personal data", personal_data),
    ("packing", packing),
]
#: The stages train a classifier, concentrate covariances and tokenize, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written as Parquet and read again for the next one, whose input is deleted once its output is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        docs = cut_alone(spark, lambda: stage(spark, docs, sf_dir))
        if before is not None:
            drop_cut(before)
        before = docs
    return docs
