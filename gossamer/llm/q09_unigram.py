"""Query 9: all documents as token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import unigram

QUERY = "op9_unigram_encode"
ORACLE = None  # tests hold ids against an exhaustive search and against the public library's unigram search


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its ids, how many, how many of them bytes, and whether decoding gives the text back."""
    return unigram.encode(table(spark, sf_dir, "documents"))
