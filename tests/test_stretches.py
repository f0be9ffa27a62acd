"""Spans, lines and parts that meet by stretches, held against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from gossamer.operators import layout, review, spans

SPAN = "doc_id long, ord int, category string, text string, start int, end int, confidence double, source string"


def some_spans(seed, n=120, width=9000):
    rng, rows = random.Random(seed), []
    for i in range(n):
        start = rng.choice([rng.randrange(width), 1024 * rng.randrange(9)])
        end = start + rng.choice([0, 1, 5, 1023, 1024, 1025, 3000])
        rows.append((rng.choice([1, 1, 1, 2, None]), i, rng.choice(["custom_identifier", "secret"]), rng.choice(["Anna", "anna b", "x"]), start, end, 0.9, "pattern"))
    return [*rows, (1, n, "custom_identifier", "Anna", None, None, 0.9, "pattern")]


def covered(mine, other):
    if None in (mine[4], other[4]) or mine[0] != other[0] or other[5] - other[4] <= mine[5] - mine[4]:
        return False
    shared = min(mine[5], other[5]) - max(mine[4], other[4])
    near = shared / max(1, mine[5] - mine[4]) >= 0.75 and (other[2] != "custom_identifier" or mine[3].replace(" ", "").lower() in other[3].replace(" ", "").lower())
    return other[4] <= mine[4] and other[5] >= mine[5] or near


@pytest.mark.parametrize("seed", [1, 2])
def test_contained_literals_as_by_all_pairs(spark, seed):
    rows = some_spans(seed)
    kept = {r.ord for r in spans.suppress_contained(spark.createDataFrame(rows, SPAN)).collect()}
    assert kept == {m[1] for m in rows if m[2] != "custom_identifier" or not any(covered(m, o) for o in rows)}
    assert len(kept) < len(rows)


@pytest.mark.parametrize("seed", [3, 4])
def test_boxes_as_by_all_pairs(spark, seed):
    rng = random.Random(seed)
    texts = {d: "\n".join("a" * rng.choice([0, 1, 80, 1023, 1024, 2500]) for _ in range(8)) for d in (1, 2)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = some_spans(seed)
    got = sorted((r.ord, r.line_no, r.part_start, r.part_end) for r in layout.span_boxes(spark.createDataFrame(rows, SPAN), layout.text_lines(docs)).collect())
    want = []
    for row in rows:
        at = 0
        for number, line in enumerate(texts.get(row[0], "").split("\n")):
            if row[4] is not None and max(row[4], at) < min(row[5], at + len(line)):
                want.append((row[1], number, max(row[4], at), min(row[5], at + len(line))))
            at += len(line) + 1
    assert got == sorted(want) and got


def test_recovered_places_are_those_of_the_text(spark):
    box = "struct<x:double,y:double,w:double,h:double>"
    sought = spark.createDataFrame([(1, 0, "anna"), (1, 0, "a\\Eb"), (1, 0, "")], "doc_id long, page_index int, text string").withColumns({"start": F.lit(0), "end": F.lit(0)})
    text = "İİ Anna a\\Eb" + " anna" * 2000
    pages = spark.createDataFrame([(1, 0, text)], "doc_id long, page_index int, text string")
    lines = spark.createDataFrame([(1, 0, 0, 0, len(text), (0.0, 0.0, 1.0, 1.0))], f"doc_id long, page_index int, line_no int, line_start int, line_end int, box {box}")
    found = [(r.text, text[r.part_start : r.part_end]) for r in layout.recover_boxes(sought, pages, lines).collect()]
    assert len(found) == 2002 and all(a.lower() == b.lower() for a, b in found)


@pytest.mark.parametrize("at", ["long", "timestamp"])
def test_progress_as_by_one_window(spark, at):
    rng = random.Random(5)
    places = rng.sample(range(10**6), 400)
    rows = [(rng.choice(["m", "m", "n", None]), None if i == 7 else p, rng.choice([None, 1, 20])) for i, p in enumerate(places)] + [("one", 5, 3), ("none", None, None)]
    parts = spark.createDataFrame(rows, "model string, at long, bytes long")
    if at == "timestamp":
        parts = parts.withColumn("at", F.timestamp_seconds("at"))
    got = sorted((str(r.model), r.k, r.done, r.share) for r in review.download_progress(parts.withColumn("k", F.col("at").cast("long")), cells=16).collect() if r.k is not None)
    want = []
    for model in {r[0] for r in rows}:
        own, done = sorted((r for r in rows if r[0] == model), key=lambda r: (r[1] is not None, r[1])), None
        total = sum(r[2] or 0 for r in own)
        for _, p, n in own:
            done = done if n is None else (done or 0) + n
            if p is not None:
                want.append((str(model), p, done, None if done is None else done / max(total, 1)))
    assert got == sorted(want, key=lambda r: r[:2])


def test_stretches_of_no_rows(spark):
    none = spark.createDataFrame([], SPAN)
    assert spans.suppress_contained(none).count() == layout.span_boxes(none, layout.text_lines(none.select("doc_id", "text"))).count() == 0
    assert review.download_progress(spark.createDataFrame([], "model string, at long, bytes long")).count() == 0
