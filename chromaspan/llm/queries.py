"""Queries of this subpackage by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroid_clustering, decontamination, language_id, lexical_search, license_scan, line_dedup, near_dups, neighbour_graph, pii, quality_rules, sentencepiece_codec, sharding, token_files
from .common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": lambda spark, d: decontamination.op1_decontamination(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op2_pii": lambda spark, d: pii.op2_pii(table(spark, d, "documents")),
        "op3_license_scan": lambda spark, d: license_scan.op3_license_scan(table(spark, d, "documents")),
        "op4_near_dups": lambda spark, d: near_dups.op4_near_dups(table(spark, d, "documents")),
        "op5_sentencepiece": lambda spark, d: sentencepiece_codec.op5_sentencepiece(table(spark, d, "documents")),
        "op6_token_files": lambda spark, d: token_files.op6_token_files(table(spark, d, "documents")),
        "op7_quality_rules": lambda spark, d: quality_rules.op7_quality_rules(table(spark, d, "documents")),
        "op8_language_id": lambda spark, d: language_id.op8_language_id(table(spark, d, "documents")),
        "op9_sharding": lambda spark, d: sharding.op9_sharding(table(spark, d, "documents")),
        "op10_line_dedup": lambda spark, d: line_dedup.op10_line_dedup(table(spark, d, "documents")),
        "op11_neighbour_graph": lambda spark, d: neighbour_graph.op11_neighbour_graph(table(spark, d, "embeddings")),
        "op12_lexical_search": lambda spark, d: lexical_search.op12_lexical_search(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op13_centroid_clustering": lambda spark, d: centroid_clustering.op13_centroid_clustering(table(spark, d, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontamination.OP1_SQL, "op4_near_dups": near_dups.OP4_SQL, "op7_quality_rules": quality_rules.OP7_SQL, "op10_line_dedup": line_dedup.OP10_SQL,
        "op12_lexical_search": lexical_search.OP12_SQL, "op13_centroid_clustering": centroid_clustering.OP13_SQL,
    }
