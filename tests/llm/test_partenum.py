import numpy as np
import pytest
from pyspark.sql import functions as F

from gossamer.llm import components, partenum

from .brute import components as brute_components
from .brute import shingles


def check(docs, got):
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    want = brute_components(sets)
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()}
    assert out == {i: (len(s), want[i]) for i, s in sets.items()}


def test_matches_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check(docs, partenum.cluster(docs))


@pytest.mark.parametrize("seed", [0, 1])
def test_edited_copies(spark, seed):
    """Groups of copies with edits about the threshold, over all sizes, with a passage that all share."""
    rng = np.random.default_rng(seed)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 4000, n)]
    passage, rows = word(30), []
    for _ in range(40):
        base = word(int(rng.choice([3, 5, 8, 12, 20, 40, 80, 300])))
        if rng.random() < 0.6:
            base = base + passage
        for _ in range(int(rng.integers(1, 9))):
            copy = list(base)
            for _ in range(int(rng.integers(0, max(2, len(base) // 30)))):
                copy[int(rng.integers(0, len(copy)))] = f"e{rng.integers(0, 9)}"
            cut = int(rng.integers(0, max(1, len(base) // 8)))
            rows.append((len(rows), " ".join(copy[cut:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(docs, partenum.cluster(docs))


def test_signatures_meet_for_all_similar_sets():
    rng = np.random.default_rng(3)
    for _ in range(400):
        size = int(rng.integers(4, 120))
        pool = rng.integers(0, 1 << 63, size * 2).astype(np.uint64)
        a = np.unique(pool[:size])
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.08], pool[size : size + int(rng.integers(0, size // 8 + 2))]]))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 80 * (len(a) + len(b) - common) and len(a) != common != len(b):
            x, y = partenum.signatures([a, b])
            assert len(np.intersect1d(x, y))


def test_subsets_of_two_cells_are_enumerated():
    """A set signs subsets of the cells: one shingle in one set only leaves a subset of its partition equal."""
    rng = np.random.default_rng(4)
    s = np.unique(rng.integers(0, 1 << 63, 255).astype(np.uint64))
    whole, less = partenum.signatures([s, s[1:]])
    assert len(whole) - len(np.intersect1d(whole, less)) <= 2 + len(s) // 4  # two subsets, and the first shingles of poor sets
    n1 = int(partenum.partitions(np.array([7]))[0])
    assert 2 * n1 > partenum.differ(255, 318)  # so at least one partition differs in one shingle at most


def test_families_below_the_threshold_give_few_pairs(spark, monkeypatch):
    """600 copies of a text, each too different from all others: no pair is compared but those with leaders."""
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 4000, 200)]
    rows = []
    for i in range(600):
        copy = list(base)
        for at in rng.choice(200, 9, replace=False):
            copy[at] = f"e{i}-{at}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    counts, stored = {}, partenum.cut

    def counting(df, name):
        out = stored(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(partenum, "cut", counting)
    check(docs, partenum.cluster(docs))
    pairs = sum(n for name, n in counts.items() if name.startswith("near-pairs"))
    assert 0 < pairs <= 4 * len(rows)


def test_odd_rows(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join(base[:-3])
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a b"), (5, "A  b"), (5, " ".join(base)), (None, "a b"), (7, near), (7, near), (8, "b a"), (9, "x " * 40_000), (10, "y" * 80_000), (11, "ä B"), (12, "Ä b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("cls", F.lit(1))
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in partenum.cluster(docs).collect()), key=str)
    assert out == sorted(
        [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 56, 4), (None, 1, None), (7, 53, 4), (7, 53, 4), (8, 1, 8), (9, 1, 9), (10, 1, 10), (11, 1, 11), (12, 1, 12)], key=str
    )
    assert partenum.cluster(docs.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 99), (101, 100), (300, 200), (200, 300), (7, 7)]
    roots = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert roots == {**{i: 0 for i in range(51)}, 99: 99, 100: 99, 101: 99, 200: 200, 300: 200}
