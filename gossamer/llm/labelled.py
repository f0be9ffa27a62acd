"""Bounded training samples of labelled documents."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, max_rows: int, seed: str, balance: bool = False) -> DataFrame:
    """(doc_id, text, y) of labelled rows for which ``usable`` (over doc_id) holds.

    About ``max_rows`` labelled ids are drawn by a hash of the id (with ``balance`` half
    of them of either class, as far as there are as many); that bound is what makes the
    broadcast safe. Ids labelled more than once have the label of the majority, 1 on a tie.
    """
    ids = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).filter(usable).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in ids.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    shares = {y: min(1.0, max_rows / 2 / n if balance else max_rows / total) for y, n in sizes.items()}
    scale = 1 << 30
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(scale))
    kept = F.lit(False)
    for y, part in shares.items():
        kept = kept | ((F.col("y") == y) & (draw < F.lit(math.ceil(part * scale))))
    drawn = ids.filter(kept).select(F.col("doc_id").alias("label_id"), "y")
    return docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("label_id")).drop("label_id")
