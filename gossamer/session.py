"""Sessions and paths."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

#: Up to so many bytes a core, an input is dealt to all cores, in pieces of at least ``PIECE`` bytes.
SPREAD, PIECE = 32 << 20, 512 << 10


def build_session(app: str = "gossamer", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; ``conf`` entries override (dots written as ``__``)."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app).config(map=settings)
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the parquet tables under ``root`` (any path that Spark's readers open)."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small input dealt to all cores, for work that takes much time a byte.

    A file is read by row groups, so one of few groups would keep most cores idle. Inputs of
    more than ``SPREAD`` bytes a core have groups enough and are left as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    pieces = min(cores, math.ceil(size / PIECE))
    return df.repartition(pieces) if pieces > 1 and size <= SPREAD * cores else df
