import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gossamer.llm import stages, unigram
from gossamer.llm.common import fresh_path

from .brute import components, shingles, words_az


@pytest.fixture(scope="module")
def steps(spark, small):
    """What each stage returned."""
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    out.append(docs.collect())
    for _, stage in corpus_pipeline.STAGES:
        path = fresh_path(spark, "step")
        stage(spark, docs, small).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def test_stages_against_brute_force(steps, spark, small):
    raw, good, single, private, mixed, tokens = steps
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in raw}
    kept = {r.doc_id for r in good}
    assert all(r.text == texts[r.doc_id] for r in good)
    assert sum(i not in kept for i, q in labels.items() if q == 1) <= 0.01 * len(labels)
    assert sum(i not in kept for i, q in labels.items() if q == 0) >= 0.9 * sum(q == 0 for q in labels.values())
    sets = {r.doc_id: shingles(r.text) for r in good}
    assert sorted(r.doc_id for r in single) == sorted(set(components(sets).values()))
    assert [r.doc_id for r in sorted(private, key=lambda r: r.doc_id)] == sorted(r.doc_id for r in single)
    spans = r"\+1 \(\d{3}\) 555-\d{4}|\b\d{16}\b|\S+@mail\d+\.example\.com"
    assert all(r.n_chars == len(r.text) for r in private)
    assert not any(set(re.findall(spans, texts[r.doc_id])) & set(re.findall(spans, r.text)) for r in private)
    by_id = {r.doc_id: r.text for r in private}
    times = Counter(r.doc_id for r in mixed)
    assert all(n <= 2 for n in times.values()) and all(r.text == by_id[r.doc_id] for r in mixed)
    size = lambda rows: sum(len(words_az(r.text)) for r in rows)
    assert abs(size(mixed) / size(private) - 1.5) < 0.05
    coder = unigram.Coder(unigram.Pieces.load())
    assert Counter(r.doc_id for r in tokens) == times
    assert all(coder.decode(r.ids) == by_id[r.doc_id] for r in tokens if r.round_trip)


def test_run(spark, tiny):
    out = corpus_pipeline.run(spark, tiny)
    assert out.columns == ["doc_id", "n_tokens", "n_byte_tokens", "round_trip", "ids"] and out.count() > 50


def test_odd_rows(spark, tiny):
    rows = [(1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (1, "other words in here", None, None, None), (None, None, None, None, None), (None, None, None, None, None), (2, "", "en", "s", 0), (3, "mail a@b.org", "en", "t", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    single = stages.near_duplicates(spark, docs, tiny)
    assert sorted((r.doc_id or 0) for r in single.collect()) == [0, 0, 1, 2, 3]
    for stage in (stages.quality, stages.near_duplicates, stages.private, stages.mixture):
        out = stage(spark, docs, tiny)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), tiny).count() == 0
        out.count()
    mixed = stages.mixture(spark, docs, tiny).groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    assert all(r.n <= 6 for r in mixed)
