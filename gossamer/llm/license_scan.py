"""License scanning by diagonal voting, in DataFrame operations only.

Every rolling word pair of every text is joined to the places where that pair
stands in a fixed set of templates. A match at text word p and template word t
votes for the diagonal p - t. Votes are summed per diagonal, and to each diagonal
its neighbours within GAP (words put in or left out) are merged, so a span is never
more than 2 GAP words longer than its template. A span is verified by the share of
the template's words that its votes cover; of neighbouring spans the best stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, lower_az

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 2  # words in a rolling gram; the shortest phrase has two

#: Base phrases: all their words must stand consecutively.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Passages that name a licence; a span needs COVER of the words.
TEMPLATES = (
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "bsd"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("made available under the terms of the eclipse public license", "epl"),
    ("gnu affero general public license", "agpl"),
    ("cc0 1 0 universal public domain dedication", "cc0-1.0"),
    ("all rights reserved no part of this publication may be reproduced", "proprietary"),
)
COVER = 0.8
GAP = 4  # diagonals this near are merged; less than the words of the shortest template
SENTINEL = "\x00row"  # no text gram equals it


def template_rows(spark: SparkSession, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """(gram, tid, tpos, tlen, label, base): one row per gram of each template. Its size is that of the fixed lists, so it can be broadcast."""
    rows = []
    for tid, (text, label, base) in enumerate([(t, n, True) for t, n in phrases] + [(t, n, False) for t, n in templates]):
        words = text.split()
        rows += [(*words[i : i + K], tid, i, len(words), label, base) for i in range(len(words) - K + 1)]
    rows.append((SENTINEL, "", -1, 0, 0, "", False))
    made = spark.createDataFrame(rows, "one string, two string, tid int, tpos int, tlen int, label string, base boolean")
    return made.withColumn("gram", F.xxhash64("one", "two")).drop("one", "two")


def word_array(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null or wordless: empty."""
    return F.filter(F.split(lower_az(F.coalesce(text, F.lit(""))), NOT_WORDS), lambda w: w != "")


def gram_hashes(words: Column) -> Column:
    """Hashes of all rolling K-word grams; [] with fewer words."""
    return F.when(F.size(words) < K, F.array().cast("array<bigint>")).otherwise(
        F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.xxhash64(a, b))
    )


def scan(docs: DataFrame, spans_only: bool = False, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """Licence mentions of rows (doc_id, text).

    ``spans_only`` returns the verified spans (doc_id, content, label, base, start, words, cover);
    else one row per row of ``docs`` with what ``op3`` reports. Rows that repeat doc_id and text are counted once
    in the votes and returned as often as they came; null ids and texts are kept, null texts have no words.
    """
    spark = docs.sparkSession
    read = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()).alias("content"), word_array(F.col("text")).alias("words"))
    # Place -1 holds the sentinel, which carries the number of words.
    grams = read.select("doc_id", "content", F.size("words").cast("long").alias("n_words"), F.posexplode(F.concat(F.array(F.xxhash64(F.lit(SENTINEL), F.lit(""))), gram_hashes(F.col("words")))).alias("pos", "gram"))
    hits = grams.withColumn("pos", F.col("pos") - 1).join(F.broadcast(template_rows(spark, templates, phrases)), "gram")
    keys = ["doc_id", "content"]
    # A vote for each template word; repeated rows vote once.
    diagonals = hits.groupBy(*keys, "tid", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.first("n_words").alias("n_words"),
        F.first("label").alias("label"),
        F.first("base").alias("base"),
        F.first("tlen").alias("tlen"),
        F.collect_set("tpos").alias("tposes"),
        F.count("*").alias("n_rows"),
    )
    diagonals = cut(diagonals, "license-diagonals")  # a row per text and vote; three readers follow
    pairs = F.size("tposes")
    phrase = diagonals.filter(F.col("base") & (pairs == F.col("tlen") - K + 1)).select(*keys, "label", "base", F.col("diagonal").alias("start"), F.col("tlen").alias("n"), F.lit(1.0).alias("cover"))
    # Each diagonal of one template and text takes in its neighbours.
    of_template = W.partitionBy(*keys, "tid").orderBy("diagonal")
    near = of_template.rangeBetween(-GAP, GAP)
    merged = diagonals.filter(~F.col("base") & (F.col("tid") >= 0)).select(
        *keys,
        "tid",
        "label",
        "tlen",
        "diagonal",
        F.array_distinct(F.flatten(F.collect_list("tposes").over(near))).alias("pairs"),
        F.min(F.col("diagonal") + F.array_min("tposes")).over(near).alias("start"),
        F.max(F.col("diagonal") + F.array_max("tposes")).over(near).alias("end"),
    )
    # Words covered: those in a matched pair.
    covered = F.size(F.array_distinct(F.flatten(F.transform("pairs", lambda t: F.array(t, t + 1)))))
    verified = merged.withColumn("cover", covered / F.col("tlen")).filter(F.col("cover") >= COVER)
    opened = verified.withColumn("opens", (F.col("diagonal") - F.lag("diagonal").over(of_template) > GAP).cast("int"))
    grouped = opened.withColumn("span", F.sum(F.coalesce("opens", F.lit(0))).over(of_template.rowsBetween(W.unboundedPreceding, 0))).groupBy(*keys, "tid", "span")
    best = F.max_by(F.struct("label", "start", (F.col("end") + K - F.col("start")).alias("n"), "cover"), F.struct("cover", -(F.col("end") - F.col("start")), -F.col("diagonal")))
    spans = grouped.agg(best.alias("b")).select(*keys, "b.label", F.lit(False).alias("base"), "b.start", "b.n", "b.cover")
    found = phrase.unionByName(spans)
    if spans_only:
        return found.select("doc_id", "content", "label", "base", F.col("start").cast("long"), F.col("n").cast("long").alias("words"), "cover")
    rows = diagonals.filter("tid = -1").select(*keys, "n_words", "n_rows", F.lit(None).cast("string").alias("label"), F.lit(None).cast("boolean").alias("base"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("double").alias("cover"))
    told = found.select(*keys, F.lit(None).cast("long").alias("n_words"), F.lit(None).cast("long").alias("n_rows"), "label", "base", "start", F.col("cover").cast("double"))
    joined = F.array_join
    return (
        rows.unionByName(told)
        .groupBy(*keys)
        .agg(
            F.max("n_words").alias("n_words"),
            F.max("n_rows").alias("n_rows"),
            F.count_if(F.col("base")).alias("n_base"),
            F.min(F.when(F.col("base"), F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(F.col("base"), F.col("start"))).cast("long").alias("last_word"),
            joined(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
            joined(F.array_sort(F.collect_set("label")), ",").alias("labels"),
            F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
        )
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))))
        .drop("content", "n_rows", "copy")
    )
