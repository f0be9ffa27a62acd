import numpy as np
import pytest
from pyspark.sql import functions as F

from gossamer.llm import q05_toxicity, toxicity
from gossamer.llm.toxicity import HIDDEN, WINDOW, Network, Scorer

BAD = ["idiot", "zorkface", "grumbling"]


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abcdeiorstlnm"), rng.integers(2, 8))) for _ in range(800)]
    rows = []
    for i in range(n):
        words = list(rng.choice(vocabulary, int(rng.integers(1, 150))))
        toxic = i % 4 == 0
        if toxic:
            words.insert(int(rng.integers(0, len(words) + 1)), str(rng.choice(BAD)) + str(rng.choice(["", "", "en", "x", "!"])))
        rows.append((" ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def net():
    return toxicity.train(corpus(1200, 0))


def test_held_out_accuracy(net):
    rows = corpus(400, 0)[:0] + corpus(1600, 0)[1200:]
    got = Scorer(net).scores([t for t, _ in rows])
    assert np.mean((got >= 0.3) == np.array([y for _, y in rows], bool)) > 0.95


def test_no_place_is_missed(net):
    clean = " ".join(w for t, y in corpus(300, 0) if not y for w in t.split())[:30_000]
    words = clean.split()
    for at in (0, 31, 32, 500, len(words)):
        assert Scorer(net).scores([" ".join(words[:at] + ["zorkface"] + words[at:])])[0] > Scorer(net).scores([clean])[0]


def test_windows_cover_and_overlap():
    for n in (0, 1, 31, 32, 33, 57, 200, 1001):
        at = toxicity.starts(n)
        assert at[0] == 0 and at[-1] + WINDOW >= n
        assert all(0 < b - a < WINDOW for a, b in zip(at, at[1:]))


def test_gradients_match_differences():
    rng = np.random.default_rng(2)
    net = Network.fresh()
    net.u, net.attend, net.query, net.out, net.bias = [u.astype(float) for u in net.u], net.attend.astype(float), net.query.astype(float), net.out.astype(float), net.bias.astype(float)
    x = [rng.normal(0, 1, (5, 3, 3 * HIDDEN)) for _ in range(2)]
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], float)
    y, weight = np.array([1.0, 0, 1]), np.ones(3) / 3
    # States are kept in single precision, so differences are taken over wide steps.
    _, d_u, d_attend, d_query, d_out, d_bias, d_x = toxicity.gradients(net, x, mask, y, weight)
    for array, grad in [*zip(net.u, d_u), (net.attend, d_attend), (net.query, d_query), (net.out, d_out), (net.bias, d_bias), *zip(x, d_x)]:
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in array.shape)
            kept, losses = array[at], []
            for move in (1e-2, -1e-2):
                array[at] = kept + move
                losses.append(toxicity.gradients(net, x, mask, y, weight)[0])
            array[at] = kept
            assert (losses[0] - losses[1]) / 2e-2 == pytest.approx(grad[at], abs=2e-4)


def test_padding_changes_nothing(net):
    rows = corpus(30, 5)
    alone = [Scorer(net).scores([t])[0] for t, _ in rows]
    np.testing.assert_allclose(Scorer(net).scores([t for t, _ in rows]), alone, atol=1e-4)


def test_query_and_odd_rows(spark, small):
    out = q05_toxicity.run(spark, small)
    labels = spark.read.parquet(f"{small}/labels.parquet").select("doc_id", F.col("toxic").alias("y"))
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    assert out.count() == spark.read.parquet(f"{small}/documents.parquet").count()
    pos, neg = [r.score for r in rows if r.y], [r.score for r in rows if not r.y]
    assert np.mean([[p > n for n in neg] for p in pos]) > 0.6  # few labels of many kinds of words
    docs = spark.createDataFrame([(1, "x"), (1, "x"), (None, "idiot"), (2, None), (3, ""), (4, "w " * 30_000), (5, "q" * 60_000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    for labelled in ([], [(1, 1, 0)], [(1, 1, 0), (3, 0, 1), (4, 1, None), (None, 1, 1)]):
        fitted = toxicity.fit(docs, spark.createDataFrame(labelled, "doc_id long, quality int, toxic int"))
        got = toxicity.score(docs, fitted).collect()
        assert len(got) == 7 and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert toxicity.score(docs.limit(0), fitted).count() == 0
