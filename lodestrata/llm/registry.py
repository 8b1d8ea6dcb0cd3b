"""Queries of this package, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, media, ngram_join, packing, secret_scan, substring_dedup, token_counts, topk, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_media_columns": media.op3_media_columns,
        "op4_substring_dedup": substring_dedup.op4_substring_dedup,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op6_bpe_round_trip": bpe.op6_bpe_round_trip,
        "op7_secret_scan": secret_scan.op7_secret_scan,
        "op8_exact_topk": topk.op8_exact_topk,
        "op9_ngram_jaccard": ngram_join.op9_ngram_jaccard,
        "op10_warc": warc.op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_secret_scan": secret_scan.oracle_sql(), "op8_exact_topk": topk.SQL, "op9_ngram_jaccard": ngram_join.SQL, "op10_warc": warc.SQL}
