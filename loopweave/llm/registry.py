"""The queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embedding_dedup, fill_middle, license_scan, line_crf, mixing, near_dedup, packing, quality_rules, token_counts, toxicity, url_filter, whitening
from .common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each operator over its whole table, with production parameters."""
    return {
        "op1_toxicity": lambda spark, d: toxicity.op1_toxicity(table(spark, d, "documents"), table(spark, d, "labels")),
        "op2_quality_classifier": lambda spark, d: line_crf.op2_quality_classifier(table(spark, d, "documents"), table(spark, d, "labels")),
        "op3_packing": lambda spark, d: packing.op3_packing(table(spark, d, "documents")),
        "op4_near_dedup": lambda spark, d: near_dedup.op4_near_dedup(table(spark, d, "documents")),
        "op5_quality_rules": lambda spark, d: quality_rules.op5_quality_rules(table(spark, d, "documents")),
        "op6_url_filters": lambda spark, d: url_filter.op6_url_filters(table(spark, d, "pages")),
        "op7_embedding_dedup": lambda spark, d: embedding_dedup.op7_embedding_dedup(table(spark, d, "embeddings")),
        "op8_mixing": lambda spark, d: mixing.op8_mixing(table(spark, d, "documents")),
        "op9_token_counts": lambda spark, d: token_counts.op9_token_counts(table(spark, d, "documents")),
        "op10_license_scans": lambda spark, d: license_scan.op10_license_scans(table(spark, d, "documents")),
        "op11_fill_in_middle": lambda spark, d: fill_middle.op11_fill_in_middle(table(spark, d, "documents")),
        "op12_whitening": lambda spark, d: whitening.op12_whitening(table(spark, d, "embeddings")),
        "op13_bpe": lambda spark, d: bpe.op13_bpe(table(spark, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_quality_rules": quality_rules.oracle(),
        "op6_url_filters": url_filter.oracle(),
        "op8_mixing": mixing.oracle(),
        "op10_license_scans": license_scan.oracle(),
        "op11_fill_in_middle": fill_middle.oracle(),
    }
