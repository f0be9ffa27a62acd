"""Looks that save a search, and small inputs dealt to all cores."""

import pytest

from gossamer import session
from gossamer.functions import patterns as P
from gossamer.operators import extract

SHORTEST = {
    "github_token": "ghp_" + "a1" * 18,
    "crypto_labeled": "btc: " + "x" * 26,
    "crypto_btc": "1" + "a" * 25,
    "crypto_ltc": "L" + "a" * 26,
    "crypto_trx": "T" + "a" * 33,
    "crypto_xrp": "r" + "a" * 24,
    "crypto_xmr": "4" + "a" * 94,
    "crypto_dash": "X" + "a" * 33,
    "crypto_doge": "D5" + "a" * 32,
    "crypto_ada": "stake1" + "a" * 50,
    "crypto_ton": "EQ" + "a" * 46,
    "ipv6": "1:2:3",
}


def test_shortest_matches_are_found(spark):
    assert P.RUNS <= set(SHORTEST)
    rows = [(name, f"so{blank}{text}{blank}it is") for name, text in SHORTEST.items() for blank in (" ", "\n", "\t", "\u00a0")]
    found = extract.pattern_spans(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    for name, text in SHORTEST.items():
        assert sorted((r.start, r.text) for r in found if r.doc_id == name and r.pattern == name) == [(3, text)] * 4


@pytest.mark.parametrize("piece, limit, dealt", [(1 << 10, 32 << 20, True), (1 << 30, 32 << 20, False), (1 << 10, 0, False)])
def test_spread(spark, tiny, monkeypatch, piece, limit, dealt):
    monkeypatch.setattr(session, "PIECE", piece)
    monkeypatch.setattr(session, "SPREAD", limit)
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    out = session.spread(docs)
    assert (out is not docs) == dealt
    assert sorted(out.collect(), key=str) == sorted(docs.collect(), key=str)
