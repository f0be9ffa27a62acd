"""Query 2: quality of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import quality_model

QUERY = "op2_quality_classifier"
ORACLE = None  # a fitted model; tests hold it to held-out accuracy


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """See ``quality_model``: fit on the labels outside the held-out fold, score every document."""
    docs = table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))
