import json

from pyspark.sql import functions as F

from gossamer.operators import custom, extract, layout, review
from gossamer.plans import samples
from gossamer.sources import pages
from gossamer.streaming import detect


def test_text_files_and_choice(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ftwo pages")
    out = pages.read_text_files(spark, str(tmp_path)).collect()
    assert [(r.page_index, r.text) for r in out] == [(0, "one"), (1, "two pages")]
    seen = spark.createDataFrame([(out[0].doc_id, 0, "ONE"), ("other", 3, "x")], "doc_id string, page_index int, text string")
    chosen = pages.page_texts(pages.read_text_files(spark, str(tmp_path)), seen).collect()
    assert sorted(r.text_source for r in chosen) == ["native", "native", "ocr"]


def test_rules_file_skips_what_does_not_compile(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"patterns": [{"id": "a", "category": "secret", "regex": "x+"}, {"id": "b", "category": "secret", "regex": "("}]}))
    assert [r.id for r in pages.read_rules(spark, str(path)).collect()] == ["a"]
    assert pages.read_rules(spark).count() == 43


def test_custom_file_round_trip(spark, tmp_path):
    rows = custom.normalized(spark.createDataFrame(samples.LITERALS, "ord long, label string, value string, category string"))
    pages.write_custom(rows, str(tmp_path / "c"))
    back = spark.read.json(str(tmp_path / "c")).select("label", "value").collect()
    assert sorted(map(tuple, back)) == sorted((r.label, r.value) for r in rows.collect())
    moved = custom.migrate(spark.createDataFrame(samples.LITERALS, "ord long, label string, value string, category string"))
    assert {r.value for r in moved.collect()} >= {"39104 Buchental", "Vera Holm", "Eichenweg 7 39104 Buchental"}


def test_lines_and_recovered_boxes(spark):
    schema = "doc_id string, page_index int, line_no int, text string, box struct<x:double,y:double,w:double,h:double>"
    lines = spark.createDataFrame([("d", 0, 1, "two Anna", (0.0, 0.5, 1.0, 0.1)), ("d", 0, 0, "one", (0.0, 0.9, 1.0, 0.1))], schema)
    page = layout.join_lines(lines)
    assert page.first().text == "one\ntwo Anna" and page.first().starts == [0, 4]
    starts = lines.join(page.select("doc_id", "page_index", "starts"), ["doc_id", "page_index"]).withColumn("line_start", F.get("starts", F.col("line_no"))).withColumn("line_end", F.col("line_start") + F.length("text")).drop("text", "starts")
    lost = spark.createDataFrame([("d", 0, "ANNA", 0, 0)], "doc_id string, page_index int, text string, start int, end int")
    got = layout.recover_boxes(lost, page, starts).collect()
    assert [(r.start, r.end, r.line_no, r.rect.y) for r in got] == [(8, 12, 1, 0.5)]


def test_review_log(spark):
    findings = spark.createDataFrame([(i, "d") for i in range(5)], "finding_id long, doc_id string")
    log = spark.createDataFrame([(0, 1, "reject"), (0, 2, "accept"), (1, 5, "remove"), (2, 9, "reject"), (None, 7, "accept_all"), (4, 1, "open")], "finding_id long, seq long, action string")
    out = review.review_status(findings, log)
    assert {r.finding_id: r.status for r in out.collect()} == {0: "rejected", 1: "rejected", 2: "accepted", 3: "accepted", 4: "accepted"}
    assert review.can_save(out).first().can_save


def test_stream_equals_batch(spark, tiny, tmp_path):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = detect.read_stream(spark, str(tmp_path / "in"))
    found = detect.stream_spans(stream).writeStream.format("memory").queryName("spans").trigger(availableNow=True).start()
    found.awaitTermination(120)
    assert spark.table("spans").count() == extract.pattern_spans(docs).count()
    done = detect.anonymize_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    done.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_sink_drops_metadata(spark, tmp_path):
    rows = spark.createDataFrame([(1, "raw", "made", "author")], "doc_id long, text string, anonymized_text string, author string")
    pages.write_redacted(rows, str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).columns == ["doc_id", "text"]
