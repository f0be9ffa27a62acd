"""Query 7: near-duplicate components of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import partenum

QUERY = "op7_ngram_jaccard"
ORACLE = None  # all pairs in SQL are too slow on whole tables; tests hold the query against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """See ``partenum.cluster``: one row per document."""
    return partenum.cluster(table(spark, sf_dir, "documents"))
