"""From raw documents to token ids: quality, near duplicates, personal data, mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gossamer.llm import stages
from gossamer.llm.common import fresh_path

STAGES = [
    ("quality", stages.quality),
    ("near duplicates", stages.near_duplicates),
    ("personal data", stages.private),
    ("mixing", stages.mixture),
    ("tokens", stages.tokens),
]

#: The first stage is a fitted model and the second a similarity join, so SQL cannot express the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"stage-{number}-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
