"""Query 5: toxicity of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import toxicity

QUERY = "op5_toxicity_gru"
ORACLE = None  # a trained network; tests hold it to held-out accuracy and its gradients to differences


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """See ``toxicity``: train on the labels outside the held-out fold, score every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
