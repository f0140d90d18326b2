"""Queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import best_fit_packing, centroid_clustering, chat_formatting, document_fingerprints, embedding_near_dedup, lm_scoring, period_runs, sentencepiece_codec, sharding, simhash_near_dedup, substring_dedup, suffix_array_dedup, toxicity

MODULES = [document_fingerprints, sentencepiece_codec, suffix_array_dedup, embedding_near_dedup, best_fit_packing, simhash_near_dedup, sharding, toxicity, lm_scoring, substring_dedup, period_runs, chat_formatting, centroid_clustering]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.SQL.items()}
