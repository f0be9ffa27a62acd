"""Long texts in time that grows with their length, Unicode blanks and letters whose case changes their length."""

import time

import pytest
from pyspark.sql import functions as F

from gossamer.functions import text as T
from gossamer.operators import anonymize, extract, layout, review, spans


def one(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id long, text string")


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running_sums(spark, n):
    row = spark.range(1).select(T.running_sums(F.array(*[F.lit(i) for i in range(n)]).cast("array<int>")).alias("s")).first()
    assert row.s == [sum(range(i)) for i in range(n)]


def test_many_matches_and_lines_in_one_text(spark):
    n = 200_000
    began = time.time()
    found = extract.pattern_spans(one(spark, "1.2.3.4 " * n), [r for r in extract.P.everything() if r[1].startswith("ip")])
    rows = found.groupBy("pattern").agg(F.count("*").alias("n"), F.max("start").alias("s"), F.sum(F.col("start") % 8).alias("odd")).collect()
    assert rows and all((r.n, r.s, r.odd) == (n, 8 * (n - 1), 0) for r in rows)
    lines = layout.text_lines(one(spark, "\n".join(["abc"] * n)))
    r = lines.agg(F.count("*").alias("n"), F.max("line_start").alias("s"), F.sum(F.col("line_start") - 4 * F.col("line_no")).alias("odd")).first()
    assert (r.n, r.s, r.odd) == (n, 4 * (n - 1), 0)
    ocr = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit(0).alias("page_index"), F.col("id").cast("int").alias("line_no"), F.lit("ab").alias("text"))
    starts = layout.join_lines(ocr).first().starts
    assert starts == list(range(0, 3 * n, 3))
    assert time.time() - began < 120


def test_many_spans_of_one_page(spark):
    n = 20_000
    rows = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("ord"), (F.col("id") * 2).cast("int").alias("start"), (F.col("id") * 2 + 3).cast("int").alias("end"), F.lit(0.9).alias("confidence"))
    kept = sorted(r.start for r in spans.non_overlapping(rows).collect())
    assert kept == list(range(0, 2 * n, 4))


def test_spaced_runs_need_no_stack(spark):
    texts = ["a " * 5000, "a b c d", "a b c dd", "a b c d e ff g h i j", "ab c d e f"]
    rows = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.regexp_count("t", F.lit(T.SPACED_RUN))).collect()]
    assert rows == [1, 1, 0, 2, 1]
    assert one(spark, "a " * 5000).select(T.needs_ocr(F.col("text"))).first()[0]


def test_blanks_that_do_not_break(spark):
    text = "IBAN DE89 3704 0044 0532 0130 00 Tel. +49 30 1234567"
    found = {r.pattern for r in extract.pattern_spans(one(spark, text)).collect()}
    assert "iban" in found or any("iban" in p for p in found)
    assert one(spark, "a  b").select(T.collapse(F.col("text"))).first()[0] == "a b"


def test_places_where_case_changes_length(spark):
    docs = one(spark, "İİİ Anna ist da")
    customs = spark.createDataFrame([("l", "anna", "c")], "label string, value string, category string")
    assert [(r.text, r.start, r.end) for r in extract.literal_spans(docs, customs).collect()] == [("Anna", 4, 8)]
    assert "Anna" in review.keyword_in_context(docs, "anna").first().snippet


def test_literals_alike_are_one_and_find_every_spelling(spark):
    values = ["Friedenstr. 25", "Friedenstraße 25", " friedenstrasse 25 ", "Ａnna"]
    customs = spark.createDataFrame([("l", v, c) for v in values for c in ("ort", "Ört")], "label string, value string, category string")
    kept = sorted(r.value for r in extract.distinct_literals(customs).collect())
    assert len(kept) == 2
    docs = spark.createDataFrame([(1, "in der FRIEDENSTRASSE   25"), (2, "Frieden-Strasse25"), (3, "anna"), (4, "nichts")], "doc_id long, text string")
    got = {(r.doc_id, r.text) for r in extract.literal_spans(docs, customs).collect()}
    assert got == {(1, "FRIEDENSTRASSE   25"), (2, "Frieden-Strasse25"), (3, "anna")}


def test_many_literals_go_by_their_first_letters(spark, monkeypatch):
    customs = spark.createDataFrame([("l", v, "c") for v in ("Friedenstr. 25", "ab", "§§", "Anna", "zzz")], "label string, value string, category string")
    docs = spark.createDataFrame([(1, "Friedenstrasse 25, Anna ab"), (2, "§§ Friedenstr. 25"), (3, None), (4, "")], "doc_id long, text string")
    few = sorted((r.doc_id, r.start, r.text) for r in extract.literal_spans(docs, customs).collect())
    monkeypatch.setattr(extract, "FEW_LITERALS", 2)
    many = extract.literal_spans(docs, customs)
    assert "NestedLoop" not in many._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.start, r.text) for r in many.collect()) == few and len(few) == 5


def test_placeholders_without_number_and_tokens_as_they_stand(spark):
    row = spark.createDataFrame([("see X and [ x ], [PERSON_1] person-1 ", {"[X]": "Anna", "[PERSON_1]": "Bo"})], "t string, m map<string,string>")
    r = row.select(anonymize.restore(F.col("t"), F.col("m")).alias("r")).first().r
    assert r.restored_text.count("Anna") == 2 and "Bo" in r.restored_text
    tokens = row.select(anonymize.suspicious_tokens(F.col("t"), F.col("m")).alias("s")).first().s
    assert tokens == sorted(tokens) and any(t != t.strip() for t in tokens) and all("erson" in t.lower() for t in tokens)
