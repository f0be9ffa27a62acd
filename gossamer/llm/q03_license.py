"""Query 3: licence mentions of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import license_scan

QUERY = "op3_license_scan"
ORACLE = None  # the labels and the score of the method need the diagonals; tests hold the query against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """See ``license_scan.scan``: one row per document."""
    return license_scan.scan(table(spark, sf_dir, "documents"))
