"""Query 10: surrogates for the personal data of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import surrogates

QUERY = "op10_pii_surrogates"
ORACLE = None  # drawing again until no collision is left is iterative; tests hold the result against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the text with surrogates, how many entities and of which kinds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace(docs).select("doc_id", "text", "n_entities", "entity_kinds")
