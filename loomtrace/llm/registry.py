"""Queries and SQL of the corpus operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, hard_negatives, media, mixing, packing, periodic_runs, quality, simhash_dedup, substring_dedup, suffix_dedup, token_counts, topk_search, toxicity

MODULES = (topk_search, toxicity, media, quality, chat_format, token_counts, packing, mixing, suffix_dedup, simhash_dedup, periodic_runs, hard_negatives, substring_dedup)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL: dict[str, str] = {k: q for m in MODULES for k, q in m.SQL.items()}
