"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Each source gets a target by sharing the total over the weights, no source above
a multiple of its own size. Every document first gets its certain whole copies;
for the rest, documents are ranked by the odds of a keyed random number over the
odds of their inclusion probability, and the lowest ranks up to the wanted size
get one more copy. Longer documents have higher probabilities, up to a bound. The rank's cut is found by summing sizes over rank buckets,
so no source is sorted in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, LIMIT = 1.5, 2.0
#: Rows that a rank bucket holds on average, at most; the bucket of the cut is sorted in one task.
BUCKET_ROWS = 512
SEED = "mix-1"
#: A document's inclusion probability is in proportion to this many words and its own size, of which at most so many count.
BASE_SIZE, TOP_SIZE = 200, 800


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(source, source_size, weight, target, n_docs, weighed) of rows (source, size); weighed: the sum of ``appeal`` times size.

    Weights go by the sources' order (code points, null last), repeating. With
    sources in order of limit over weight, the first one that the level fits under
    fixes it: that is where resharing the excess again and again ends.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"), F.sum(appeal(F.col("size")) * F.col("size")).alias("weighed"))
    ranked = per.withColumn("at", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)  # one row per source
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    order = W.orderBy("full", F.col("at")).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    return (
        ranked.withColumn("weight", weight)
        .withColumns({"cap": F.lit(limit) * F.col("source_size"), "total": F.lit(share) * F.sum("source_size").over(everything), "weights": F.sum("weight").over(everything)})
        .withColumn("full", F.col("cap") / F.col("weight"))
        .withColumns({"cap_before": F.coalesce(F.sum("cap").over(order), F.lit(0.0)), "weight_before": F.coalesce(F.sum("weight").over(order), F.lit(0.0))})
        .withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before")))
        .withColumn("fits", F.col("level") <= F.col("full"))
        .withColumn("final", F.min_by("level", F.when(F.col("fits"), F.struct("full", "at"))).over(everything))
        .withColumn("target", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("weight"))))
        .select("source", F.col("source_size").cast("long").alias("source_size"), "weight", "target", "n_docs", "weighed")
    )


def appeal(size: Column) -> Column:
    """What a document's inclusion probability is in proportion to; a whole number, so that sums are exact."""
    return F.lit(BASE_SIZE) + F.least(size, F.lit(TOP_SIZE))


def uniform(seed: str = SEED) -> Column:
    """A number strictly between 0 and 1, keyed by doc_id; the same in every run and engine."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def pareto_rank(u: Column, chance: Column) -> Column:
    """Random odds over inclusion odds."""
    return (u / (1 - u)) / (chance / (1 - chance))


def mix(sizes: DataFrame, seed: str = SEED, limit: float = LIMIT, chance: Column | None = None, bucket_rows: int = BUCKET_ROWS, **how) -> DataFrame:
    """Rows (doc_id, source, size, ...) with source_size, target, copies and taken.

    ``sizes`` is read several times; pass a stored table. ``chance`` is the wanted
    inclusion probability of a document's extra copy (by default in proportion to its
    ``appeal``, so that the words to expect are those still wanted, and below 1; it may
    use source_size, target, wanted, weighed, size). Rows
    that are alike in doc_id and size are taken in any order, which the result
    doesn't show. Sizes of 0 take nothing. Extra columns are kept.
    """
    targets = cut(source_targets(sizes, limit=limit, **how), "mix-targets")
    n_docs = targets.agg(F.sum("n_docs")).first()[0] or 0
    buckets = 1 << min(24, max(0, math.ceil(math.log2(max(1, n_docs / bucket_rows)))))
    per = targets.select(F.col("source").alias("t_source"), "source_size", "target", "weighed")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # Sources are few beside documents, but their number is not bounded: a plain join, whose hot side adaptive execution splits.
    placed = sizes.join(per, sizes["source"].eqNullSafe(per["t_source"]), "left").drop("t_source")
    placed = placed.withColumn("whole", F.least(F.floor(ratio + 1e-12), F.lit(int(limit))))
    wanted = F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))
    placed = placed.withColumn("wanted", wanted)
    probability = chance if chance is not None else F.when(F.col("weighed") > 0, F.col("wanted") * appeal(F.col("size")) / F.col("weighed")).otherwise(F.lit(0.0))
    p = F.least(F.greatest(probability, F.lit(1e-9)), F.lit(1 - 1e-9))
    rank = pareto_rank(uniform(seed), p)
    # rank / (1 + rank) is monotone and spreads ranks over 0 to 1; with it go the buckets.
    placed = placed.withColumn("rank", rank).withColumn("bucket", F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * buckets), F.lit(buckets - 1)).cast("long"))
    filled = placed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    cuts = filled.withColumn("words_before", F.coalesce(F.sum("words").over(before), F.lit(0)).cast("double")).withColumnsRenamed({"source": "b_source", "bucket": "b_bucket"})
    marked = placed.join(cuts, placed["source"].eqNullSafe(cuts["b_source"]) & (placed["bucket"] == cuts["b_bucket"]), "left").drop("b_source", "b_bucket")
    inside = (F.col("words_before") < F.col("wanted")) & (F.col("words_before") + F.col("words") > F.col("wanted"))
    at_cut = marked.filter(inside)
    in_order = W.partitionBy("source", "bucket").orderBy("rank", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    # Taken if the middle of its words lies below the cut: the nearest that whole documents come.
    middle = F.col("words_before") + F.coalesce(F.sum("size").over(in_order), F.lit(0)) + F.col("size") / 2
    cut_rows = at_cut.withColumn("extra", F.when(middle <= F.col("wanted"), 1).otherwise(0))
    rest = marked.filter(~F.coalesce(inside, F.lit(False))).withColumn("extra", F.when(F.col("words_before") + F.col("words") <= F.col("wanted"), 1).otherwise(0))
    copies = F.least(F.col("whole") + F.col("extra"), F.lit(int(limit))).cast("long")
    return (
        rest.unionByName(cut_rows)
        .withColumn("copies", copies)
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("whole", "wanted", "weighed", "rank", "bucket", "words", "words_before", "extra")
    )


def sizes_of(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) of documents, stored in the shared folder: texts are read once."""
    return cut(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), "mix-sizes")
