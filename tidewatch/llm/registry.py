"""Queries of this subpackage and their SQL equivalents, by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

AREAS = ["url_templates", "language", "jaccard", "trie_lm", "line_rules", "token_files", "quality", "packing", "hnsw", "mixing", "importance", "embedding_dedup", "fill_middle"]


def load() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    queries, oracles = {}, {}
    for area in AREAS:
        module = importlib.import_module(f"tidewatch.llm.{area}")
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
