"""Registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reviewsift.llm import (
    align,
    byte_bpe,
    decontaminate,
    exact_dedup,
    ngram_join,
    prefix_trie,
    pseudonyms,
    repeats,
    secrets_scan,
    sharding,
    token_count,
    toxicity,
    url_filters,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": decontaminate.query,
    "op2_toxicity": toxicity.query,
    "op3_exact_dedup": exact_dedup.query,
    "op4_pseudonyms": pseudonyms.query,
    "op5_repeats": repeats.query,
    "op6_token_count": token_count.query,
    "op7_ngram_join": ngram_join.query,
    "op8_byte_bpe": byte_bpe.query,
    "op9_secrets": secrets_scan.query,
    "op10_sharding": sharding.query,
    "op11_prefix_trie": prefix_trie.query,
    "op12_align": align.query,
    "op13_url_filters": url_filters.query,
}

ORACLE: dict[str, str] = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op7_ngram_join": ngram_join.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op13_url_filters": url_filters.ORACLE,
}
