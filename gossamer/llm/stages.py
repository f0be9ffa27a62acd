"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns rows of the columns of ``documents``, the last one tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import table
from . import mixing, partenum, quality_model, surrogates, unigram
from .common import cut, unused


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows that the quality classifier, fitted on the labels, does not reject."""
    return quality_model.keep(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component: that with the smallest id, once. Rows without id are in no component and stay."""
    found = partenum.cluster(docs.select("doc_id", "text"))
    kept = cut(found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")), "first-documents")
    first = docs.join(kept.select("doc_id"), "doc_id", "left_semi")
    if not kept.filter("n > 1").isEmpty():  # an id that several rows have stays once
        order = W.partitionBy("doc_id").orderBy(*[c for c in docs.columns if c != "doc_id"])
        (turn,) = unused(docs, "gossamer_turn")
        first = first.withColumn(turn, F.row_number().over(order)).filter(F.col(turn) == 1).drop(turn)
    return first.select(docs.columns).unionByName(docs.filter("doc_id is null"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put surrogates for personal data; n_chars becomes the new text's length."""
    return surrogates.replace(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: not at all, once or twice."""
    text_hash, at, mix_id, mix_other, mix_at, copies, copy = unused(docs, "mix_hash", "mix_nth", "mix_id", "mix_other", "mix_at", "mix_copies", "mix_copy")
    nth = lambda name: F.row_number().over(W.partitionBy("doc_id", name).orderBy("source"))
    sizes = docs.select("doc_id", "source", mixing.size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("hash"))
    small = cut(sizes.withColumn("nth", nth("hash")), "mix-sizes")
    taken = mixing.mix(small).filter("copies > 0").select(F.col("doc_id").alias(mix_id), F.col("hash").alias(mix_other), F.col("nth").alias(mix_at), F.col("copies").alias(copies))
    hashed = docs.withColumn(text_hash, F.xxhash64("text"))
    repeats = not small.filter("nth > 1").isEmpty()
    numbered = hashed.withColumn(at, nth(text_hash) if repeats else F.lit(1))
    same = numbered["doc_id"].eqNullSafe(taken[mix_id]) & (numbered[text_hash] == taken[mix_other]) & (numbered[at] == taken[mix_at])
    return numbered.join(taken, same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row's text."""
    return unigram.encode(docs)
