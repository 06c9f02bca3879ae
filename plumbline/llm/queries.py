"""The queries of this subpackage: each operator with its production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_text, near_dup, packing, quality, secrets, sharding, token_counts, token_output, top_k
from .common import table


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_findings(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.coded_tokens(table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


#: The queries of the search: these rows, each against all rows.
QUERY_SET = "vec_id % 100 = 0"


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k.top_k(vectors, vectors.where(QUERY_SET))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


_OPERATORS = (
    op1_secret_scans,
    op2_token_counts,
    op3_quality_classifier,
    op4_benchmark_decontamination,
    op5_html_extraction,
    op6_token_output,
    op7_simhash_near_dedup,
    op8_packing,
    op9_exact_top_k,
    op10_sharding,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _OPERATORS}
ORACLE_SQL: dict[str, str] = {"op1_secret_scans": secrets.FINDINGS_SQL, "op4_benchmark_decontamination": decontaminate.HITS_SQL, "op9_exact_top_k": top_k.TOP_K_SQL}
