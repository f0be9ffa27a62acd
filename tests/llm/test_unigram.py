import struct

import pytest
import sentencepiece

from gossamer.llm import unigram
from gossamer.llm.unigram import Coder, Pieces

TEXTS = ["Hello  world\n\tagain ", "", " lead", "Ünïcödé 梦🙂 \u0000 x", "a" * 3000, "   ", "\n\n", "The quick brown fox, jumped. 12345 !!! ***"]


@pytest.fixture(scope="module")
def pieces():
    return Pieces.load()


@pytest.fixture(scope="module")
def coder(pieces):
    return Coder(pieces)


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def part(number, kind, value):
    return varint(number << 3 | kind) + (varint(value) if kind == 0 else (varint(len(value)) if kind == 2 else b"") + value)


def as_unigram(pieces):
    """The model file with our scores, marked as a unigram model, for the public library."""
    out, at = b"", 0
    for number, kind, value in unigram.wire(open(unigram.MODEL_FILE, "rb").read()):
        if number == 1:
            value = part(1, 2, pieces.names[at].encode()) + part(2, 5, struct.pack("<f", pieces.scores[at])) + part(3, 0, pieces.kinds[at])
            at += 1
        elif number == 2:
            value = b"".join(part(n, k, 1 if n == 3 else v) for n, k, v in unigram.wire(value))
        out += part(number, kind, value)
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def test_trie_finds_all_pieces_and_no_others(pieces):
    t = pieces.trie

    def look(word):
        s = 0
        for c in word:
            to = t.base[s] + c
            if to >= len(t.check) or t.check[to] != s or not to:
                return -1
            s = to
        return t.value[s]

    for i, (n, k) in enumerate(zip(pieces.names, pieces.kinds, strict=True)):
        assert look(n.encode()) == (i if k == unigram.NORMAL else -1)
    assert look("zqzqzq".encode()) == -1 and look(b"") == -1


def test_same_as_library(spark, tiny, pieces, coder):
    library = as_unigram(pieces)
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").limit(60).collect()]
    same = 0
    for t in texts:
        got, want = coder.encode(t), library.encode(t)
        assert coder.score(got) == pytest.approx(coder.score(want), abs=1e-2)
        same += got == want
        assert coder.decode(got) == library.decode(want)
    assert same >= 0.95 * len(texts)  # equal sums may be split otherwise


def test_best_of_all_segmentations():
    names = ["<unk>", "a", "b", "ab", "aba", "ba", "▁", "▁a", "é"]
    pieces = Pieces(names, [0.0, -2.0, -2.1, -3.5, -5.9, -3.0, -1.0, -2.5, -4.0], [2] + [1] * 8).ready()
    coder = Coder(pieces)
    by_name = {n: i for i, n in enumerate(names)}

    def best(text):
        if not text:
            return 0.0
        return max([coder.scores[by_name[text[:k]]] + best(text[k:]) for k in range(1, len(text) + 1) if text[:k] in by_name] + ([coder.unknown + best(text[1:])] if text[0] not in by_name else []))

    for text in ("abab", "abaab", "é ab ba", "xab", "aaabbb", "abababa"):
        marked = "▁" + text.replace(" ", "▁")
        ids = coder.encode(text)
        assert sum(coder.unknown if i == 0 else coder.scores[i] for i in ids) == pytest.approx(best(marked))


def test_round_trip_and_rows(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "x"), (3, None), (3, None), (9, "mark ▁ inside")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS ids")
    coded = unigram.encode(docs)
    out = coded.collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.n_tokens == len(r.ids) and r.round_trip == (r.doc_id != 9)
        assert r.n_tokens > 0 or r.doc_id in (1, 3)
    back = sorted((r.doc_id, r.text) for r in unigram.decode(coded).filter("doc_id < 8 and doc_id <> 3").collect())
    assert back == [(i, t) for i, t in enumerate(TEXTS) if i != 3]
    assert unigram.encode(docs.limit(0)).count() == 0
