import numpy as np
import pytest
from pyspark.sql import functions as F

from gossamer.llm import q02_quality, quality_model


def test_held_out_accuracy(spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet").select("doc_id", F.col("quality").alias("y"))
    out = q02_quality.run(spark, small)
    assert out.count() == spark.read.parquet(f"{small}/documents.parquet").count()
    rows = out.join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 30 and np.mean([r.predicted == r.y for r in held]) > 0.93
    good, bad = [r.score for r in held if r.y], [r.score for r in held if not r.y]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97


def test_isotonic_matches_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(50):
        x, y = rng.integers(0, 6, 12).astype(float), rng.integers(0, 2, 12)
        kx, ky = quality_model.pav(x, y)
        assert (np.diff(kx) > 0).all() and (np.diff(ky) > 0).all()
        xs = np.unique(x)
        # min-max formula of isotonic regression
        mean = lambda a, b: y[(x >= a) & (x <= b)].mean()
        want = [max(min(mean(a, b) for b in xs if b >= v) for a in xs if a <= v) for v in xs]
        np.testing.assert_allclose(np.unique(want), ky)


def test_kernel_is_approximated():
    model = quality_model.Model(np.zeros(quality_model.N_STATS), np.ones(quality_model.N_STATS), None, (np.zeros(1), np.zeros(1)))
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 1, (2, 40, quality_model.N_STATS))
    z = (model.lift(a)[:, :-1] * model.lift(b)[:, :-1]).sum(1)
    want = np.exp(-((a - b) ** 2).sum(1) / 2 / quality_model.WIDTH**2)
    assert np.abs(z - want).max() < 0.3 and np.abs(z - want).mean() < 0.08


@pytest.mark.parametrize("n_labels", [0, 3])
def test_odd_rows(spark, n_labels):
    rows = [(1, "x y"), (1, "x y"), (None, "z"), (2, None), (3, ""), (4, "w " * 30_000), (5, "l" * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1, None), (3, 0, 0), (None, 1, 1)][:n_labels], "doc_id long, quality int, toxic int")
    model = quality_model.fit(docs, labels)
    out = quality_model.score(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.held_out is not None for r in out)
    assert quality_model.score(docs.limit(0), model).count() == 0
    assert quality_model.keep(docs, model).columns == docs.columns
