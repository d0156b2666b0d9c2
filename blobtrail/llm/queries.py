"""Registered queries of this subpackage: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from blobtrail.llm import alignment, chat, hmm, lines, mixing, near_dup, neighbours, pieces, prefix_trie, quality, secrets, substrings, token_counts

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_chat_format": (chat.query, chat.ORACLE_SQL),
    "op2_near_duplicates": (near_dup.query, near_dup.ORACLE_SQL),
    "op3_mix_sources": (mixing.query, mixing.ORACLE_SQL),
    "op4_nearest_neighbours": (neighbours.query, neighbours.ORACLE_SQL),
    "op5_substring_dedup": (substrings.query, substrings.ORACLE_SQL),
    "op6_token_counts": (token_counts.query, None),
    "op7_quality_rules": (quality.query, quality.ORACLE_SQL),
    "op8_lm_score": (hmm.query, None),
    "op9_secret_scan": (secrets.query, None),
    "op10_sentencepiece": (pieces.query, None),
    "op11_line_dedup": (lines.query, lines.ORACLE_SQL),
    "op12_prefix_trie": (prefix_trie.query, prefix_trie.ORACLE_SQL),
    "op13_alignment": (alignment.query, None),
}
