"""Spans of the diagonal voting against a text by text search."""

import random

import pytest

from gossamer.llm import license_scan
from gossamer.llm.license_scan import COVER, GAP, K, TEMPLATES


def brute(words):
    """{(label, start, words, cover)} of one text, by the definition in the operator's module."""
    out = set()
    for text, label in TEMPLATES:
        t = text.split()
        votes = {}
        for p in range(len(words) - K + 1):
            for q in range(len(t) - K + 1):
                if words[p : p + K] == t[q : q + K]:
                    votes.setdefault(p - q, set()).add(q)
        good = []
        for d in sorted(votes):
            near = {e: qs for e, qs in votes.items() if abs(e - d) <= GAP}
            cover = len({q + i for qs in near.values() for q in qs for i in (0, 1)}) / len(t)
            start, end = min(e + min(qs) for e, qs in near.items()), max(e + max(qs) for e, qs in near.items())
            if cover >= COVER:
                good.append((d, (cover, -(end - start), -d), (label, start, end + K - start, round(cover, 6))))
        for i, (d, _, _) in enumerate(good):
            if i == 0 or d - good[i - 1][0] > GAP:
                chain = [good[i]]
                for g in good[i + 1 :]:
                    if g[0] - chain[-1][0] > GAP:
                        break
                    chain.append(g)
                out.add(max(chain, key=lambda g: g[1])[2])
    return out


@pytest.fixture(scope="module")
def texts():
    rng, vocabulary = random.Random(3), "a the of license version gnu software under terms 2 0 x y z".split()
    out = []
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 5)):
            words += rng.choices(vocabulary, k=rng.randrange(0, 8))
            passage = rng.choice(TEMPLATES)[0].split()
            for _ in range(rng.randrange(0, 4)):  # words put in, left out, changed
                at = rng.randrange(len(passage))
                passage[at : at + rng.randrange(0, 2)] = rng.choices(vocabulary, k=rng.randrange(0, 4))
                passage = passage or ["x"]
            words += passage
        out.append(words)
    return out + [[], ["gnu"], TEMPLATES[0][0].split() * 40]


def test_spans_match_brute_force(spark, texts):
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {i: set() for i in range(len(texts))}
    for r in license_scan.scan(docs, spans_only=True).filter("not base").collect():
        got[r.doc_id].add((r.label, r.start, r.words, round(r.cover, 6)))
    assert got == {i: brute(w) for i, w in enumerate(texts)}
    longest = {label: max(len(t.split()) for t, n in TEMPLATES if n == label) for _, label in TEMPLATES}
    assert sum(map(len, got.values())) > 60 and all(n <= longest[label] + 2 * GAP for found in got.values() for label, _, n, _ in found)


def test_repeated_notices_are_single_spans(spark, texts):
    rows = license_scan.scan(spark.createDataFrame([(1, " ".join(texts[-1]))], "doc_id long, text string"), spans_only=True).filter("label = 'gpl-3.0'").collect()
    assert sorted((r.start, r.words) for r in rows) == [(12 * i, 12) for i in range(40)]
