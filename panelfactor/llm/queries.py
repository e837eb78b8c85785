"""Queries of the operators of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from . import bpe, centroid_clusters, html_extract, line_dedup, ngram_join, prefix_trie, quality_classifier, quality_rules, source_mix, suffix_dedup, token_counts, topk_search, toxicity


def queries() -> dict[str, Callable[..., DataFrame]]:
    return {
        "op1_topk_search": topk_search.op1_topk_search,
        "op2_ngram_join": ngram_join.op2_ngram_join,
        "op3_token_counts": token_counts.op3_token_counts,
        "op4_quality_classifier": quality_classifier.op4_quality_classifier,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_html_extract": html_extract.op6_html_extract,
        "op7_bpe": bpe.op7_bpe,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_source_mix": source_mix.op10_source_mix,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_suffix_dedup": suffix_dedup.op12_suffix_dedup,
        "op13_centroid_clusters": centroid_clusters.op13_centroid_clusters,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk_search": topk_search.OP1_SQL,
        "op2_ngram_join": ngram_join.OP2_SQL,
        "op8_quality_rules": quality_rules.OP8_SQL,
        "op9_line_dedup": line_dedup.OP9_SQL,
        "op10_source_mix": source_mix.OP10_SQL,
        "op11_prefix_trie": prefix_trie.OP11_SQL,
        "op12_suffix_dedup": suffix_dedup.OP12_SQL,
        "op13_centroid_clusters": centroid_clusters.OP13_SQL,
    }
