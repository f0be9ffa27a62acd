"""Long texts, long header lines and clashing columns."""

import io
import time

import pytest
from pyspark.sql import functions as F

from gossamer.llm import common, stages, surrogates, unigram, warc


def test_blank_free_text_takes_linear_time():
    coder = unigram.Coder(unigram.Pieces.load())
    took = []
    for n in (50_000, 200_000):
        text = "学习语言模型" * (n // 6)
        began = time.process_time()
        ids = coder.encode(text)
        took.append(time.process_time() - began)
        assert coder.decode(ids) == text
    assert took[1] < 8 * took[0] + 0.5


def test_long_header_line_is_one_header():
    url = "https://a.example/" + "x" * (3 << 20)
    out = io.BytesIO()
    warc.write_record(out, [("WARC-Target-URI", url), ("Content-Length", "2")], "hi", False)
    ((_, headers, _, piece, *_),) = warc.parse(io.BufferedReader(io.BytesIO(out.getvalue())))
    assert headers["warc-target-uri"] == url and piece == b"hi"


def test_unknown_stores_are_errors():
    with pytest.raises(Exception):
        warc.open_store("dbfs:/x")


def test_address_with_very_many_parts(spark):
    texts = ["mail a@b" + ".cd" * 100_000 + " now", "call +1 (555) 010-0199 or write to jo@ex.org"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in surrogates.replace(docs).collect()}
    assert rows[0].n_entities == 1 and rows[1].n_entities == 2 and ".cd.cd" not in rows[0].text


def test_clashing_columns_stay(spark):
    names = ["pii_found", "pii_row", "PII_SIZE", "pii_map", "pii_kinds", "mix_hash", "mix_nth", "mix_copy", "copies", "gossamer_turn", "size"]
    rows = [(i, f"write to a{i}@ex.org " + "w " * 40, "web", *["x"] * len(names)) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    out = surrogates.replace(docs).collect()
    assert len(out) == 6 and all(r[n] == "x" for r in out for n in names)
    mixed = stages.mixture(spark, docs, "")
    assert mixed.columns == docs.columns and all(r[n] == "x" for r in mixed.collect() for n in names)
    kept = stages.near_duplicates(spark, docs.unionByName(docs).withColumn("lang", F.lit("en")), "")
    assert kept.count() <= 6 and set(names) <= set(kept.columns)
    assert common.unused(docs, "pii_found", "new") == ["pii_found_", "new"]
