"""The registered queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cube_mixing, embedding_dedup, jaccard_join, line_dedup, packing, quality_crf, secret_scan, token_attribution, warc, weak_rules


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_crf": quality_crf.query,
        "op2_token_attribution": token_attribution.query,
        "op3_weak_rules": weak_rules.query,
        "op4_warc_derivatives": warc.query,
        "op5_line_dedup": line_dedup.query,
        "op6_jaccard_join": jaccard_join.query,
        "op7_cube_mixing": cube_mixing.query,
        "op8_embedding_dedup": embedding_dedup.query,
        "op9_packing": packing.query,
        "op10_secret_scan": secret_scan.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_warc_derivatives": warc.sql(),
        "op5_line_dedup": line_dedup.sql(),
        "op6_jaccard_join": jaccard_join.sql(),
        "op8_embedding_dedup": embedding_dedup.sql(),
    }
