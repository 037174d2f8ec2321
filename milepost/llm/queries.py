"""The registered queries of the subpackage and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from milepost.llm import (
    op1_reshard,
    op2_toxicity,
    op3_sentencepiece,
    op4_setsketch,
    op5_pii,
    op6_spaced_seeds,
    op7_language,
    op8_quality,
    op9_suffix_dedup,
    op10_sentence_spans,
    op11_lexical_scan,
    op12_norm_buckets,
    op13_prefix_trie,
)

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, Query]:
    return {
        "op1_reshard": op1_reshard.op1_reshard,
        "op2_toxicity": op2_toxicity.op2_toxicity,
        "op3_sentencepiece": op3_sentencepiece.op3_sentencepiece,
        "op4_setsketch": op4_setsketch.op4_setsketch,
        "op5_pii": op5_pii.op5_pii,
        "op6_spaced_seeds": op6_spaced_seeds.op6_spaced_seeds,
        "op7_language": op7_language.op7_language,
        "op8_quality": op8_quality.op8_quality,
        "op9_suffix_dedup": op9_suffix_dedup.op9_suffix_dedup,
        "op10_sentence_spans": op10_sentence_spans.op10_sentence_spans,
        "op11_lexical_scan": op11_lexical_scan.op11_lexical_scan,
        "op12_norm_buckets": op12_norm_buckets.op12_norm_buckets,
        "op13_prefix_trie": op13_prefix_trie.op13_prefix_trie,
    }


def all_sql() -> dict[str, str]:
    return {
        "op6_spaced_seeds": op6_spaced_seeds.SQL,
        "op8_quality": op8_quality.SQL,
        "op10_sentence_spans": op10_sentence_spans.SQL,
        "op11_lexical_scan": op11_lexical_scan.SQL,
        "op12_norm_buckets": op12_norm_buckets.SQL,
        "op13_prefix_trie": op13_prefix_trie.SQL,
    }
