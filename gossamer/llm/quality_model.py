"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import cut

FOLDS, HELD = 5, 0
#: The most labelled rows that take part in the fit.
MAX_ROWS = 20_000
FEATURES, RIDGE, WIDTH, SEED = 256, 1e-3, 3.0, 7
N_STATS = 15
THRESHOLD = 0.3


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text; those of a null text are those of an empty one."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    seen = np.bincount(raw, minlength=256)
    n, words = max(1, len(raw)), text.split()
    w = max(1, len(words))
    upper, lower = int(seen[65:91].sum()), int(seen[97:123].sum())
    symbols = int(seen[[35, 36, 37, 38, 42, 60, 62, 64, 94, 95, 126]].sum())
    lines = [x for x in text.split("\n") if x]
    return [
        math.log1p(len(words)),
        min(30.0, len(text) / w),
        upper / max(1, upper + lower),
        symbols / w,
        int(seen[33]) / w,
        int(seen[124]) / w,
        int(seen[48:58].sum()) / n,
        int(seen[44] + seen[46]) / w,
        int(seen[128:].sum()) / n,
        math.log1p(len(set(words))) / math.log1p(w),
        sum(map(eq, words, islice(words, 1, None))) / w,
        len(set(zip(words, islice(words, 1, None), strict=False))) / w,
        1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(w / max(1, len(lines))),
        sum(1 for x in lines if x.isupper()) / max(1, len(lines)),
    ]


def pav(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of y on x: the knots (mean x, mean y) of the pooled blocks. Equal x are one point."""
    order = np.argsort(x, kind="stable")
    xs, first, count = np.unique(x[order], return_index=True, return_counts=True)
    sums = np.add.reduceat(y[order].astype(float), first)
    blocks: list[list[float]] = []
    for v, s, c in zip(xs, sums, count, strict=True):
        blocks.append([v * c, s, float(c)])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


@dataclass
class Model:
    """Everything that scoring needs; a few hundred numbers."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    knots: tuple[np.ndarray, np.ndarray]

    def maps(self) -> tuple[np.ndarray, np.ndarray]:
        return frequencies()

    def lift(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features with a constant."""
        omega, phase = self.maps()
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ omega + phase) * math.sqrt(2 / FEATURES), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.lift(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated chance of label 1. Without training rows: 0.5."""
        if self.weights is None or not len(stats):
            return np.full(len(stats), 0.5)
        raw = self.raw(stats)
        # The step function's flats get a slight slope, so that scores keep the order of the fit.
        return np.clip(0.99 * np.interp(raw, *self.knots) + 0.01 / (1 + np.exp(-6 * (raw - 0.5))), 0, 1)


def frequencies() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.normal(0, 1 / WIDTH, (N_STATS, FEATURES)), rng.uniform(0, 2 * math.pi, FEATURES)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most about ``max_rows`` labelled rows outside the held-out fold.

    Each partition sums its part of the normal equations, a matrix a fold; the sums
    meet on the driver (at most 8 partitions, four folds). The ridge is fitted on
    all four folds. For the calibration, every row is scored by the ridge of the
    other three folds, at every size of the sample. doc_id serves for folds only.
    """
    fold = labelled.remainder(F.col("doc_id"), FOLDS)
    rows = labelled.sample(docs, labels, label, fold != HELD, max_rows, "quality")
    schema = "fold int, y int, stats array<double>"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [statistics(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(made, pa.list_(pa.float64()))], names=["fold", "y", "stats"])

    stored = cut(rows.select(fold.alias("fold"), "text", "y").mapInArrow(measure, schema), "quality-training")
    moments = stored.select(*[F.get("stats", F.lit(i)).alias(f"s{i}") for i in range(N_STATS)])
    found = moments.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in moments.columns], *[F.stddev_pop(c).alias(f"d_{c}") for c in moments.columns]).first()
    if not found["n"]:
        return Model(np.zeros(N_STATS), np.ones(N_STATS), None, (np.zeros(1), np.full(1, 0.5)))
    mean = np.array([found[f"m_s{i}"] for i in range(N_STATS)])
    scale = np.array([max(found[f"d_s{i}"], 1e-6) for i in range(N_STATS)])
    model = Model(mean, scale, None, (np.zeros(1), np.full(1, 0.5)))
    parts = min(8, math.ceil(found["n"] / 1000))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, FEATURES + 1, FEATURES + 2))
        for b in batches:
            if b.num_rows:
                z = model.lift(np.array(b.column(2).to_pylist()))
                y, at = np.array(b.column(1).to_pylist(), float), np.array(b.column(0).to_pylist())
                for f in np.unique(at):
                    total[f] += z[at == f].T @ np.hstack([z, y[:, None]])[at == f]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    by_fold = np.zeros((FOLDS, FEATURES + 1, FEATURES + 2))
    for r in stored.repartition(parts).mapInArrow(sums, "sums binary").toLocalIterator():
        by_fold += np.frombuffer(r["sums"]).reshape(by_fold.shape)

    def ridge(total: np.ndarray) -> np.ndarray:
        return np.linalg.solve(total[:, :-1] + RIDGE * max(1.0, total[-1, -2]) * np.eye(FEATURES + 1) / FEATURES, total[:, -1])

    total = by_fold.sum(0)
    others = np.stack([ridge(total - by_fold[f]) for f in range(FOLDS)])
    model.weights = ridge(total)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                raw = (model.lift(np.array(b.column(2).to_pylist())) * others[b.column(0).to_numpy()]).sum(1)
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array(raw)], names=["y", "raw"])

    judged = stored.select("fold", "y", "stats").mapInArrow(judge, "y int, raw double").toArrow()  # two numbers a row, about max_rows at most
    order = np.lexsort((judged["y"].to_numpy(), judged["raw"].to_numpy()))
    model.knots = pav(judged["raw"].to_numpy()[order], judged["y"].to_numpy()[order])
    return model


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    return model.score(np.array([statistics(t) for t in texts]).reshape(len(texts), N_STATS))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of (doc_id, text); rows are kept as they are, null ids are not held out."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(model, b.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, score double")
    return with_verdict(made, labelled.remainder(F.col("doc_id"), FOLDS) == HELD)


def with_verdict(scored: DataFrame, held: Column) -> DataFrame:
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is scored at the threshold or above."""
    where = docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(scores(model, b.column(where).to_pylist()) >= THRESHOLD))

    return docs.mapInArrow(task, docs.schema)
