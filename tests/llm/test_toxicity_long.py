"""Long words, windows and long labelled texts of the toxicity network."""

import random

import pytest
from pyspark.sql import functions as F

from gossamer.llm import toxicity


@pytest.fixture(scope="module")
def net():
    rng = random.Random(3)
    plain = [f"word{i:02d}" for i in range(40)]
    rows = []
    for i in range(300):
        words = rng.choices(plain, k=30)
        if i % 2:
            words[rng.randrange(30)] = "scheusal"
        rows.append((" ".join(words), i % 2))
    return toxicity.train(rows)


def test_whole_long_words_count(net):
    glued = "_".join(["word01"] * 20)
    calm, toxic = toxicity.Scorer(net).tops([glued, glued + "_scheusal_word02"])
    assert toxic > calm + 0.1
    for word in ("ab" * 100, "漢字かな" * 30, "a漢" * 50, "x" * 49):
        pieces = toxicity.words_of(word)
        assert all(len(p.encode()) <= toxicity.WORD_BYTES for p in pieces)
        assert all(any(word[i : i + 6] in p for p in pieces) for i in range(len(word) - 5)) and pieces[-1] == word[-len(pieces[-1]) :]
    assert toxicity.words_of("Ab, cd" + " e" * 3) == ["ab", "cd", "e", "e", "e"]


def test_passages_stand_whole_in_a_window():
    for n in (33, 40, 57, 200, 1001):
        at = toxicity.starts(n)
        for first in range(n - 16):
            assert any(a <= first and first + 17 <= a + toxicity.WINDOW for a in at)


def test_long_labelled_texts_take_part(spark):
    """Half of the texts are long; words that stand only in long texts are learned, from everywhere in them."""
    rng = random.Random(5)
    docs = []
    for i in range(200):
        words = [f"plain{rng.randrange(30):02d}" for _ in range(2_000 if i % 2 else 50)]
        if i % 2:
            words = [w if j % 3 else f"longonly{j * 10 // 2_000}" for j, w in enumerate(words)]
        docs.append((i, " ".join(words)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    net = toxicity.fit(frame, spark.createDataFrame([(i, i // 2 % 2) for i in range(200)], "doc_id long, toxic int"))
    assert all(toxicity.find(net.words, toxicity.word_hashes([f"longonly{k}"]))[0] for k in range(10))
    cut = frame.select("text", toxicity.bounded(F.col("text")).alias("cut")).collect()
    assert all(r.cut == r.text if len(r.text) <= toxicity.MAX_CHARS else toxicity.MAX_CHARS <= len(r.cut) < toxicity.MAX_CHARS + toxicity.SPANS for r in cut)
