"""Unigram encoding and decoding of text with the pieces of a SentencePiece model file.

The pieces stand in a double-array trie of UTF-8 bytes; Viterbi search finds the
segmentation with the highest sum of log scores. Characters in no piece become
their bytes' pieces; decoding puts blanks back for the marker. The model file is
given by path and read on the driver; executors get the trie's arrays.
"""

from __future__ import annotations

import math
import re
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: An unknown character scores this much less than the lowest piece.
UNKNOWN_PENALTY = 10.0
#: Zipf-Mandelbrot shift for models whose scores are merge ranks, not log chances.
ZIPF_SHIFT = 10.0
#: Segmented words that a worker remembers; two generations of this size at most.
MEMORY = 300_000


def wire(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(field number, wire type, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, kind, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, kind, data[at : at + size]
        at += size


@dataclass
class Trie:
    """Double-array trie: the child of s by byte c is base[s] + c where check says s. value: the id that ends there, or -1."""

    base: array
    check: array
    value: array

    @classmethod
    def build(cls, words: dict[bytes, int]) -> Trie:
        root: dict = {}
        for word, number in words.items():
            node = root
            for c in word:
                node = node.setdefault(c, {})
            node[-1] = number
        size = 1 << 12
        base, check, value = array("i", [0]) * size, array("i", [-1]) * size, array("i", [-1]) * size
        check[0] = 0
        first = 1
        queue = [(0, root)]
        for s, node in queue:
            value[s] = node.get(-1, -1)
            kids = sorted(c for c in node if c >= 0)
            if not kids:
                continue
            start = first
            while True:
                while start + 256 >= len(check):
                    base.extend([0] * len(base))
                    value.extend([-1] * len(value))
                    check.extend([-1] * len(check))
                if check[start] < 0 and start > kids[0] and all(check[start - kids[0] + c] < 0 for c in kids):
                    break
                start += 1
            if len(kids) == 1:  # a single child takes the first free place
                first = start + 1
            base[s] = start - kids[0]
            for c in kids:
                check[base[s] + c] = s
                queue.append((base[s] + c, node[c]))
        return cls(base, check, value)


@dataclass
class Pieces:
    """A model's pieces: names, log scores and kinds by id."""

    names: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool = True
    trie: Trie | None = None
    byte_ids: list[int] = field(default_factory=list)
    unknown_id: int = 0

    @classmethod
    def load(cls, path: str = MODEL_FILE) -> Pieces:
        """Read a model file. A model of merge ranks gets log scores by Zipf's law over the ranks, a unigram model keeps its own."""
        names, scores, kinds, kind_of_model, prefix = [], [], [], 1, True
        with open(path, "rb") as f:
            data = f.read()
        for number, _, value in wire(data):
            if number == 1:
                parts = {n: v for n, _, v in wire(value)}
                names.append(parts[1].decode())
                scores.append(float(np.frombuffer(parts.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(parts.get(3, NORMAL))
            elif number == 2:
                kind_of_model = next((v for n, _, v in wire(value) if n == 3), 1)
            elif number == 3:
                spec = {n: v for n, _, v in wire(value)}
                if spec.get(2, b"") or spec.get(4, 1):
                    raise ValueError("only models that leave the text as it is are read")
                prefix = bool(spec.get(3, 1))
        if kind_of_model != 1:
            normal = [i for i, k in enumerate(kinds) if k in (NORMAL, USER)]
            total = math.log(sum(1 / (r + ZIPF_SHIFT) for r in range(len(normal))))
            for r, i in enumerate(normal):
                scores[i] = float(np.float32(-math.log(r + ZIPF_SHIFT) - total))
        return cls(names, scores, kinds, prefix).ready()

    def ready(self) -> Pieces:
        usable = {n.encode(): i for i, n in enumerate(self.names) if self.kinds[i] in (NORMAL, USER)}
        self.trie = Trie.build(usable)
        by_byte = {int(n[3:5], 16): i for i, n in enumerate(self.names) if self.kinds[i] == BYTE}
        self.byte_ids = [by_byte.get(b, -1) for b in range(256)]
        self.unknown_id = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        return self

    def chunk_pattern(self) -> re.Pattern:
        """Splits a text where no piece can span: before blanks, which stand for the marker (unless a piece has it inside), and around line feeds that no piece has."""
        inside = any(MARK in n.lstrip(MARK) for n, k in zip(self.names, self.kinds, strict=True) if k in (NORMAL, USER))
        feeds = any("\n" in n for n, k in zip(self.names, self.kinds, strict=True) if k in (NORMAL, USER))
        if inside:
            return re.compile("(?s).+" if feeds else r"\n|[^\n]+")
        return re.compile(f"[ {MARK}]+[^ {MARK}]*|[^ {MARK}]+" if feeds else rf"\n|[ {MARK}]+[^ {MARK}\n]*|[^ {MARK}\n]+")


class Coder:
    """Encodes and decodes with remembered words; one for each Python worker."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.pattern = pieces, pieces.chunk_pattern()
        # Room behind the last state and none at the first: steps need no test of their range.
        self.base, self.check, self.value = list(pieces.trie.base), [-2, *pieces.trie.check[1:], *[-2] * 256], list(pieces.trie.value)
        #: No piece is longer, so a step reads no further: time grows in proportion to the text.
        self.longest = max((len(n.encode()) for n, k in zip(pieces.names, pieces.kinds, strict=True) if k in (NORMAL, USER)), default=1)
        usable = [s for s, k in zip(pieces.scores, pieces.kinds, strict=True) if k == NORMAL]
        self.unknown = (min(usable) if usable else 0.0) - UNKNOWN_PENALTY
        top = max(usable, default=0.0)
        self.scores = [len(n.encode()) * top - 0.1 if k == USER else s for n, s, k in zip(pieces.names, pieces.scores, pieces.kinds, strict=True)]
        self.young: dict[str, tuple[bytes, int, bool]] = {}
        self.old: dict[str, tuple[bytes, int, bool]] = {}

    def segment(self, chunk: str) -> list[int]:
        """Ids of the best segmentation. Of equal sums, the one whose last piece begins earlier."""
        raw = chunk.encode("utf-8", "replace")
        n, base, check, value, scores, longest = len(raw), self.base, self.check, self.value, self.scores, self.longest
        best, back, piece = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            so_far = best[i]
            if so_far == -math.inf:
                continue
            lead = raw[i]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            state, single, j = 0, False, i
            for c in raw[i : i + longest]:
                to = base[state] + c
                if check[to] != state:
                    break
                state, j = to, j + 1
                v = value[to]
                if v >= 0:
                    if j - i == width:
                        single = True
                    total = so_far + scores[v]
                    if total > best[j]:
                        best[j], back[j], piece[j] = total, i, v
            if not single and so_far + self.unknown > best[i + width]:
                best[i + width], back[i + width], piece[i + width] = so_far + self.unknown, i, -1
        ids, at = [], n
        while at:
            i = back[at]
            if piece[at] >= 0:
                ids.append(piece[at])
            elif min(codes := [self.pieces.byte_ids[b] for b in raw[i:at]]) >= 0:
                ids += codes[::-1]
            else:
                ids.append(self.pieces.unknown_id)
            at = i
        return ids[::-1]

    def score(self, ids: list[int]) -> float:
        return sum(self.scores[i] for i in ids)

    def word(self, chunk: str) -> tuple[bytes, int, bool]:
        """(ids as int32 bytes, how many are byte pieces, whether decoding gives the chunk back)."""
        got = self.young.get(chunk)
        if got is None:
            got = self.old.get(chunk)
            if got is None:
                marked = chunk.replace(" ", MARK)
                ids = self.segment(marked)
                kinds, names = self.pieces.kinds, self.pieces.names
                if "".join([names[i] for i in ids]) == marked:  # pieces only
                    got = (array("i", ids).tobytes(), 0, True)
                else:
                    got = (array("i", ids).tobytes(), sum(kinds[i] == BYTE for i in ids), self.join(ids) == marked)
            if len(chunk) <= 64:
                if len(self.young) >= MEMORY:
                    self.old, self.young = self.young, {}
                self.young[chunk] = got
        return got

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        return self.pattern.findall(" " + text if self.pieces.dummy_prefix else text)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for an empty or null one."""
        return np.frombuffer(b"".join(self.word(c)[0] for c in self.chunks(text or "")), np.int32).tolist()

    def join(self, ids: list[int]) -> str:
        """The marked text of ids; runs of byte pieces are read as UTF-8."""
        out, held, kinds, names = [], bytearray(), self.pieces.kinds, self.pieces.names
        for i in ids:
            if kinds[i] == BYTE:
                held.append(int(names[i][3:5], 16))
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            out.append("" if kinds[i] == CONTROL else " ⁇ " if kinds[i] == UNKNOWN else names[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: markers become blanks, the one put before the text goes."""
        text = self.join(ids)
        if self.pieces.dummy_prefix:
            text = text.removeprefix(MARK)
        return text.replace(MARK, " ")


_coders: dict[str, Coder] = {}


def _coder(shared) -> Coder:
    """This worker's coder for a broadcast model."""
    if shared.id not in _coders:
        _coders.clear()
        _coders[shared.id] = Coder(shared.value)
    return _coders[shared.id]


class _Shared:
    """A broadcast with a name of its own that survives pickling."""

    def __init__(self, spark, pieces: Pieces):
        self.held = spark.sparkContext.broadcast(pieces)
        self.id = uuid.uuid4().hex

    @property
    def value(self) -> Pieces:
        return self.held.value


def encode(docs: DataFrame, path: str = MODEL_FILE, with_ids: bool = True) -> DataFrame:
    """Rows (doc_id, text) to (doc_id, n_tokens, n_byte_tokens, round_trip[, ids]).

    Each row gives one, repeated or not; null and empty texts have no tokens, long ones, with or without blanks, take
    time and memory in proportion to their length. round_trip: decoding gives the
    text back (a text that holds the marker character itself, or lone surrogates, doesn't).
    """
    shared = _Shared(docs.sparkSession, Pieces.load(path))
    schema = "doc_id long, n_tokens long, n_byte_tokens long, round_trip boolean" + ", ids array<int>" * with_ids

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # bounds what the ids of a batch take
                part = batch.slice(at, 512)
                flat, ends, few, same = [], [0], [], []
                for text in part.column(1).to_pylist():
                    words = [coder.young.get(c) or coder.word(c) for c in coder.chunks(text or "")]
                    ids = b"".join([w[0] for w in words])
                    flat.append(ids)
                    ends.append(ends[-1] + len(ids) // 4)
                    few.append(sum([w[1] for w in words]))
                    same.append(all([w[2] for w in words]) and MARK not in (text or ""))
                ends = np.array(ends, np.int32)
                columns = [part.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.array(few, pa.int64()), pa.array(same, pa.bool_())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(flat), np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_byte_tokens", "round_trip", "ids"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, schema)


def decode(rows: DataFrame, path: str = MODEL_FILE) -> DataFrame:
    """Rows (doc_id, ids) to (doc_id, text); null ids are none."""
    shared = _Shared(rows.sparkSession, Pieces.load(path))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for b in batches:
            texts = [coder.decode(ids or []) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(task, "doc_id long, text string")
