"""Single rules and golden examples on invented texts."""

import pytest
from pyspark.sql import functions as F

from gossamer.functions import patterns, predicates, text
from gossamer.operators import anonymize, extract, layout, spans
from gossamer.plans import samples


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(samples.TEXTS, "doc_id string, text string")


def test_all_patterns_compile_and_find_nothing_in_nothing(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "plain words only")], "doc_id long, text string")
    assert extract.pattern_spans(docs).count() == 0
    assert len(patterns.PATTERNS) == 43 and len({p[0] for p in patterns.PATTERNS}) == 43


def test_offsets_point_at_the_text(spark, texts, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").cast("string").alias("doc_id"), "text").unionByName(texts)
    found = extract.pattern_spans(docs).withColumnRenamed("text", "m").join(docs, "doc_id")
    assert found.count() > 100 and found.filter(F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")) != F.col("m")).isEmpty()


def test_prefilters_lose_nothing(spark, texts, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").cast("string").alias("doc_id"), "text").unionByName(texts)
    direct = sum(docs.select(F.sum(F.size(F.regexp_extract_all("text", F.lit(p[2]), F.lit(0))))).first()[0] for p in patterns.PATTERNS)
    assert extract.pattern_spans(docs).count() == direct


@pytest.mark.parametrize(
    "category, snippet, page, reason",
    [
        ("private_address", "04109 Lindenau", samples.NOTICE, "header"),
        ("private_person", "Lindenau", samples.NOTICE, "header"),
        ("private_address", "39104 Buchental", samples.INVOICE, None),
        ("private_address", "Am Anger 14", samples.INVOICE, None),
        ("private_address", "04109 Lindenau", samples.INVOICE, "sender"),
        ("secret", "04109", samples.NOTICE, None),
        ("private_address", "11111 Ort", "Datum 01.02.2003\n11111 Ort\n", "date"),
        ("private_address", "11111 Ort", "11111 Ort\n\n0341/55-77\n", "phone"),
        ("private_address", "11111 Ort", "11111 Ort\n\n\n0341/55-77\n", None),
    ],
)
def test_header_reason(spark, category, snippet, page, reason):
    assert one(spark, layout.header_reason(F.lit(category), F.lit(snippet), F.lit(page))) == reason


@pytest.mark.parametrize("category, snippet, reason", [("account_number", "00123456", "few_digits"), ("account_number", "90013104300", "few_digits"), ("account_number", "77AB01278XY000875401399", None)])
def test_model_accounts(spark, category, snippet, reason):
    assert one(spark, spans.drop_reason(F.lit(category), F.lit(snippet), F.lit("model"))) == reason


def test_normalisation(spark):
    assert one(spark, text.normalize_ocr(F.lit("M a x Holm"))) == "MaxHolm"
    assert one(spark, text.normalize_ocr(F.lit("Wand o w e lt"))) == "Wandowelt"
    assert one(spark, text.normalize_ocr(F.lit("Ulmenstr. 25"))) == "Ulmenstr. 25"
    assert one(spark, text.normalize_native(F.lit("M a x / y"))) == "M a x\ny"
    assert one(spark, text.fold(F.lit("ÄÖÜ éß Ł"))) == "aou eß ł"
    assert one(spark, predicates.city_name(F.lit("D - 39104  Buchental Ost"))) == "Buchental Ost"


def test_offset_map_round_trip(spark):
    rows = [(t,) for _, t in samples.OCR] + [("",), ("a / b 1 2 3",)]
    df = spark.createDataFrame(rows, "t string").select("t", text.normalize_ocr(F.col("t")).alias("n"), text.offset_map(F.col("t"), ocr=True).alias("m"))
    for r in df.collect():
        assert len(r.n) == len(r.m)
        assert all(r.t[i] == c or (c == "\n" and r.t[i] == "/") for c, i in zip(r.n, r.m, strict=True))


def test_invoice(spark, texts):
    out = {r.doc_id: r for r in anonymize.anonymize_text(texts).collect()}
    assert out["invoice"].placeholders["[EMAIL_1]"] == "vera.holm@example.org" and out["invoice"].placeholders["[TELEFON_1]"] == "+49 391 555 0199"
    assert {"440017", "VX-2031-77", "5520098", "9900121", "BYLADEM1001"} <= set(out["invoice"].placeholders.values())
    assert "Vera Holm" in out["invoice"].anonymized_text  # without a model, names beside an address stay
    # Numbers count from the end; equal values share one.
    assert out["letter"].replacement_count == 4 and list(out["letter"].placeholders.values()).count("jan.falk@example.org") == 1
    back = spark.createDataFrame([(r.anonymized_text, r.placeholders) for r in out.values()], "t string, m map<string,string>").select(anonymize.restore(F.col("t"), F.col("m"))["restored_text"].alias("x")).collect()
    assert {" ".join(r.x.split()) for r in back} >= {" ".join(samples.LETTER.split())}


def test_model_and_literals_take_part(spark, texts):
    model = spark.createDataFrame([("letter", 0, "private_person", "Jan Falk", 5, 13, 0.9, "model")], "doc_id string, ord long, category string, text string, start int, end int, confidence double, source string")
    customs = spark.createDataFrame([("x", "ulmenallee 22", None), ("y", "BUCHENTAL", None), ("z", "Jan", None)], "label string, value string, category string")
    found = anonymize.detect(texts, customs, model).filter("doc_id = 'letter'").collect()
    kinds = {(r.category, r.text): r for r in found}
    assert kinds["private_person", "Jan Falk"].source == "model"
    # Literals within longer findings go, others stay.
    assert ("custom_identifier", "Jan") not in kinds and ("custom_identifier", "Buchental") not in kinds


@pytest.mark.parametrize(
    "literal, page, found",
    [
        ("friedenstr. 25", "an der Friedenstraße 25 links", ["Friedenstraße 25"]),
        ("Friedenstraße 25", "an der Friedenstr. 25", []),
        ("müller", "MÜLLER und Muller", ["MÜLLER"]),
        ("Muller", "Frau Müller", ["Müller"]),
        ("DE 12 34", "IBAN DE12-34 x", ["DE12-34"]),
        ("aa", "aaaa", ["aa", "aa"]),
    ],
)
def test_literal_cascade(spark, literal, page, found):
    docs = spark.createDataFrame([(1, page)], "doc_id long, text string")
    customs = spark.createDataFrame([("l", literal, "c")], "label string, value string, category string")
    assert sorted(r.text for r in extract.literal_spans(docs, customs).collect()) == sorted(found)


def test_selected_spans_are_disjoint(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    by_doc = {}
    for r in spans.non_overlapping(anonymize.detect(docs)).collect():
        by_doc.setdefault(r.doc_id, []).append((r.start, r.end))
    for rows in by_doc.values():
        rows.sort()
        assert all(a[1] <= b[0] for a, b in zip(rows, rows[1:]))
