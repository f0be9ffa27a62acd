"""Unequal inclusion probabilities of the mixing operator."""

from pyspark.sql import functions as F

from gossamer.llm import mixing
from gossamer.llm.common import cut


def test_likelier_documents_are_taken_more_often(spark):
    """Even ids have chance 0.8, odd ones 0.2; both halves of the words are wanted together."""
    sizes = cut(spark.range(2_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(10).cast("long").alias("size")), "sizes")
    chance = F.when(F.col("doc_id") % 2 == 0, 0.8).otherwise(0.2)
    rows = mixing.mix(sizes, chance=chance, weights=(1.0,), share=0.5).collect()
    extra = [sum(r.copies for r in rows if r.doc_id % 2 == k) for k in (0, 1)]
    assert abs(sum(extra) - 1_000) <= 1 and abs(extra[0] - 800) < 60 and abs(extra[1] - 200) < 60


def test_longer_documents_are_taken_more_often(spark):
    """Without ``chance``, inclusion is in proportion to ``appeal``: 300 for 100 words, 700 for 500."""
    size = F.when(F.col("id") % 6 == 0, 500).otherwise(100).cast("long")
    sizes = cut(spark.range(6_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), size.alias("size")), "sizes")
    rows = mixing.mix(sizes, weights=(1.0,), share=0.3).collect()
    long, short = [[r.copies for r in rows if r["size"] == n] for n in (500, 100)]
    assert abs(sum(r.taken for r in rows) - 0.3 * sum(r["size"] for r in rows)) <= 500
    ratio = (sum(long) / len(long)) / (sum(short) / len(short))
    assert 2.0 < ratio < 2.7
