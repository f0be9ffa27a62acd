"""Query 6: nearest neighbours of every hundredth embedding among all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import ann

QUERY = "op6_learned_partitions"
#: Small parts, so that small tables have several too.
ROWS_PER_PART = 128
ORACLE = None  # an approximate search; tests hold its recall against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """See ``ann.search``; queries are the rows whose id is divisible by 100."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % ann.EVERY == 0, rows_per_part=ROWS_PER_PART)
