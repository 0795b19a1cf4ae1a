"""Queries opN_<name> that apply each operator to its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .dom_extract import extract_pages
from .golay_dedup import near_duplicates
from .kdtree_search import top_inner_products, whole_vectors
from .pii_bootstrap import personal_data
from .piece_counts import piece_counts
from .rank_queue_bpe import bpe_round_trip
from .robust_outliers import robust_outliers
from .site_bayes import site_quality
from .vector_packing import pack_documents
from .window_lm import pseudo_likelihood


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> tuple[str, str]:
    """Path of a public vocabulary file and the pattern that splits text before its merges."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_outliers(_table(spark, sf_dir, "documents"))


def op2_golay_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken")[0])


def op4_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_table(spark, sf_dir, "documents"))


def op5_kdtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(_table(spark, sf_dir, "embeddings"))
    return top_inner_products(vectors, vectors.filter("vec_id % 100 = 0"))


def op6_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), *vocabulary("byte_bpe_50k.json"))


def op7_window_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(_table(spark, sf_dir, "documents"))


def op8_dom_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op9_site_bayes_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(_table(spark, sf_dir, "documents"), *vocabulary("byte_bpe_multi_50k.tiktoken"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_robust_outliers, op2_golay_near_duplicates, op3_piece_counts, op4_bootstrapped_pii, op5_kdtree_top_k, op6_vector_packing,
        op7_window_pseudo_likelihood, op8_dom_main_text, op9_site_bayes_quality, op10_bpe_round_trip,
    )
    return {f.__name__: f for f in found}


ORACLE = {
    "op5_kdtree_top_k": """WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
      s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
      r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
      SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
