"""Query 4: quality rules over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import quality_rules

QUERY = "op4_quality_rules"
ORACLE = None  # expectation-maximisation is iterative; tests hold the statistics and the fit against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: base statistics, base verdict and the posterior's verdict."""
    return quality_rules.apply(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality", "votes"
    )
