"""Toxicity: a bidirectional gated recurrent network over character and word inputs, with attention pooling.

A text is read as overlapping windows of words. A word's input is a learned vector
of its own beside learned vectors of its character n-grams, for words and n-grams
that enough training texts hold; both begin with log odds between classes. Two
gated recurrent units run over a window, forwards and backwards; attention weighs
their states, and a logistic unit scores the window. A text's score is that of
its highest window, calibrated. Trained in numpy on the driver, on a bounded
sample; labels are of whole texts, so in each epoch training goes by the window that
looks most toxic of each toxic text, and by that window and up to four random ones of
each other text. Of long texts it draws spans from their whole length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import labelled

FOLDS, HELD = 4, 2
THRESHOLD = 0.3
#: The most labelled rows that training draws, half of either class if there are as many, and the characters that take part of a text.
MAX_ROWS, MAX_CHARS = 3_000, 6_000
#: Spans that stand for a longer text, one drawn from each equal part of it.
SPANS = 10
WINDOW, STRIDE = 32, 16
HIDDEN, WORD_SIZE, CHAR_SIZE = 8, 4, 5
INPUTS = WORD_SIZE + 1 + CHAR_SIZE
#: Sizes of n-grams in bytes, with marks at a word's ends, and the bytes from which a word is read in pieces.
GRAMS, WORD_BYTES = (3, 4, 5, 6), 48
#: Training texts that a word or n-gram must stand in to have a vector.
LEAST_TEXTS = 4
MEMORY = 250_000
TOKEN = re.compile(r"\w+")
#: Windows a batch of the forward pass has; texts that are read at once.
BATCH, TEXTS = 2048, 256


def words_of(text: str) -> list[str]:
    """Lower-case words. A longer one than WORD_BYTES (unspaced scripts, glued words) becomes pieces; every run of 6 characters is in a piece."""
    out = []
    for w in TOKEN.findall(text.lower()):
        if len(w) * 4 <= WORD_BYTES or len(w.encode("utf-8", "replace")) <= WORD_BYTES:
            out.append(w)
            continue
        size = WORD_BYTES // max(len(c.encode("utf-8", "replace")) for c in set(w))
        out += [w[i : i + size] for i in range(0, len(w) - size // 2, size // 2)]
    return out


def word_hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) for w in words], np.uint64)


def gram_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the word) of all byte n-grams of the marked words."""
    marked = [b"^" + w.encode("utf-8", "replace") + b"$" for w in words]
    owner = np.repeat(np.arange(len(marked)), [len(m) for m in marked])
    raw = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    hashes, owners = [], []
    for size in GRAMS:
        n = len(raw) - size + 1
        if n <= 0:
            continue
        h = np.full(n, size, np.uint64)
        for i in range(size):
            h = (h + raw[i : i + n] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        whole = owner[:n] == owner[size - 1 :]
        hashes.append(h[whole])
        owners.append(owner[:n][whole])
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def find(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Row of each hash: 1 + its place among the sorted known ones, 0 if it isn't there."""
    if not len(known) or not len(hashes):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at + 1, 0)


def starts(n: int) -> list[int]:
    """Where the windows over n words begin: together they cover all words, and neighbours overlap. One for no words."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Parameters. Gates stand as update, reset, candidate; row 0 of a table is that of unknown words or n-grams."""

    words: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))  # known hashes, sorted
    grams: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    word: np.ndarray | None = None
    char: np.ndarray | None = None
    odds: np.ndarray | None = None  # of n-grams; a word has its highest
    w: list[np.ndarray] = field(default_factory=list)  # input weights of either direction, (inputs, 3 hidden)
    u: list[np.ndarray] = field(default_factory=list)  # state weights, (hidden, 3 hidden)
    b: list[np.ndarray] = field(default_factory=list)
    attend: np.ndarray | None = None  # (2 hidden, 2 hidden), then a vector
    query: np.ndarray | None = None
    out: np.ndarray | None = None
    bias: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))
    calibration: tuple[float, float] = (1.0, 0.0)
    base: float = 0.0
    trained: bool = False

    @classmethod
    def fresh(cls, seed: int = 11) -> Network:
        rng, h = np.random.default_rng(seed), HIDDEN
        net = cls()
        for _ in range(2):
            net.w.append(rng.normal(0, 0.4, (INPUTS, 3 * h)).astype(np.float32))
            net.u.append(rng.normal(0, 0.3, (h, 3 * h)).astype(np.float32))
            net.b.append(np.zeros(3 * h, np.float32))
        net.attend = rng.normal(0, 0.3, (2 * h, 2 * h)).astype(np.float32)
        net.query = rng.normal(0, 0.5, 2 * h).astype(np.float32)
        net.out = rng.normal(0, 0.5, 2 * h).astype(np.float32)
        return net

    def learn_words(self, texts: list[tuple[list[str], int]], seed: int) -> None:
        """Take up the words and n-grams of enough texts, with shrunken log odds between the classes."""
        rng = np.random.default_rng(seed)
        total = np.bincount([y for _, y in texts], minlength=2)
        found: list[tuple[list[np.ndarray], list[np.ndarray]]] = [([], []), ([], [])]
        for words, y in texts:
            distinct = list(set(words))
            found[0][y].append(word_hashes(distinct))
            found[1][y].append(np.unique(gram_hashes(distinct)[0]))
        made = []
        for both in found:
            every = [np.concatenate(x) if x else np.empty(0, np.uint64) for x in both]
            known, n = np.unique(np.concatenate(every), return_counts=True)
            known, n = known[n >= LEAST_TEXTS], n[n >= LEAST_TEXTS]
            count = [np.bincount(find(known, x), minlength=len(known) + 1)[1:] for x in every]
            odds = np.log((count[1] + 0.5) / (total[1] + 1)) - np.log((count[0] + 0.5) / (total[0] + 1))
            made.append((known, np.concatenate([[0], np.clip(odds * n / (n + 10), -2, 8) / 3]).astype(np.float32)))
        (self.words, word_odds), (self.grams, self.odds) = made
        self.word = rng.normal(0, 0.05, (len(word_odds), WORD_SIZE)).astype(np.float32)
        self.char = rng.normal(0, 0.05, (len(self.odds), CHAR_SIZE)).astype(np.float32)
        self.word[0], self.char[0] = 0, 0
        self.word[:, 0] = word_odds

    def params(self) -> list[np.ndarray]:
        return [*self.w, *self.u, *self.b, self.attend, self.query, self.out, self.bias]

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word rows, and rows and owners of the known n-grams."""
        hashes, owner = gram_hashes(words)
        grams = find(self.grams, hashes)
        return find(self.words, word_hashes(words)), grams[grams > 0], owner[grams > 0]

    def embed(self, words: list[str]) -> np.ndarray:
        """(words, INPUTS)."""
        rows, grams, owner = self.rows(words)
        return self.gather(rows, grams, owner)

    def gather(self, rows: np.ndarray, grams: np.ndarray, owner: np.ndarray) -> np.ndarray:
        n = len(rows)
        out = np.zeros((n, INPUTS), np.float32)
        out[:, :WORD_SIZE] = self.word[rows]
        np.maximum.at(out[:, WORD_SIZE], owner, self.odds[grams])
        count = np.maximum(1, np.bincount(owner, minlength=n))
        for k in range(CHAR_SIZE):
            out[:, WORD_SIZE + 1 + k] = np.bincount(owner, weights=self.char[grams, k], minlength=n) / count
        return out


def forward(net: Network, x: list[np.ndarray], mask: np.ndarray, keep: bool = False):
    """Logits of windows. x: gate inputs of either direction, (time, windows, 3 hidden); mask: (time, windows), 1 for a word.

    A padded place keeps the state as it is and gets no attention.
    """
    t, n = mask.shape
    h = HIDDEN
    states, saved = np.zeros((t, n, 2 * h), np.float32), [[], []]
    for way in range(2):
        s = np.zeros((n, h), np.float32)
        u = net.u[way]
        for k in range(t):
            at = k if way == 0 else t - 1 - k
            g = x[way][at]
            zr = sigmoid(g[:, : 2 * h] + s @ u[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(g[:, 2 * h :] + (r * s) @ u[:, 2 * h :])
            m = mask[at][:, None]
            new = s + m * z * (c - s)
            if keep:
                saved[way].append((at, s, z, r, c, m))
            s = new
            states[at, :, way * h : (way + 1) * h] = s
    flat = np.tanh(states @ net.attend)
    e = flat @ net.query - 1e9 * (1 - mask)
    e -= e.max(0)
    a = np.exp(e)
    a /= a.sum(0)
    pooled = (a[:, :, None] * states).sum(0)
    logits = pooled @ net.out + net.bias[0]
    return (logits, states, saved, flat, a, pooled) if keep else logits


def gradients(net: Network, x: list[np.ndarray], mask: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """(loss, gradients of all but the embeddings, gradients of x)."""
    logits, states, saved, flat, a, pooled = forward(net, x, mask, keep=True)
    t, n = mask.shape
    h, p = HIDDEN, sigmoid(logits)
    loss = float(-(weight * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum())
    d_logit = weight * (p - y)
    d_out, d_bias = pooled.T @ d_logit, np.array([d_logit.sum()], np.float32)
    d_pooled = d_logit[:, None] * net.out
    d_states = a[:, :, None] * d_pooled
    d_a = (states * d_pooled).sum(2)
    d_e = a * (d_a - (a * d_a).sum(0))
    d_query = np.einsum("tn,tnk->k", d_e, flat)
    d_flat = d_e[:, :, None] * net.query * (1 - flat**2)
    d_attend = np.einsum("tni,tnj->ij", states, d_flat)
    d_states = d_states + d_flat @ net.attend.T
    d_u, d_x = [], []
    for way in range(2):
        u, du, dx = net.u[way], np.zeros_like(net.u[way]), np.zeros_like(x[way])
        carry = np.zeros((n, h), np.float32)
        for at, s, z, r, c, m in reversed(saved[way]):
            d = carry + d_states[at, :, way * h : (way + 1) * h]
            dc = d * m * z * (1 - c**2)
            dz = d * m * (c - s) * z * (1 - z)
            back = dc @ u[:, 2 * h :].T
            dr = back * s * r * (1 - r)
            dg = np.concatenate([dz, dr, dc], 1)
            dx[at] = dg
            du[:, : 2 * h] += s.T @ dg[:, : 2 * h]
            du[:, 2 * h :] += (r * s).T @ dc
            carry = d * (1 - m * z) + back * r + dg[:, : 2 * h] @ u[:, : 2 * h].T
        d_u.append(du)
        d_x.append(dx)
    return loss, d_u, d_attend, d_query, d_out, d_bias, d_x


def train(rows: list[tuple[str, int]], seed: int = 11, epochs: int = 4, least_steps: int = 300, prior: float | None = None) -> Network:
    """Fit on (text, 0 or 1). Without both classes, the score is the share of class 1.

    ``prior``: share of class 1 where the rows come from, for the calibration.
    """
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    net.base = float(np.mean([y for _, y in rows])) if rows else 0.0
    if net.base in (0.0, 1.0):
        return net
    docs = [(words_of(t), y) for t, y in rows]
    order = rng.permutation(len(docs))
    n_check = len(docs) // 5
    check, fit_on = [docs[i] for i in order[:n_check]], [docs[i] for i in order[n_check:]]
    if len({y for _, y in fit_on}) < 2:
        fit_on = docs
    net.learn_words(fit_on, seed)
    number: dict[str, int] = {"": 0}

    def windows(words: list[str]) -> np.ndarray:
        r = [number.setdefault(w, len(number)) for w in words]
        return np.array([(r[s : s + WINDOW] + [0] * WINDOW)[:WINDOW] for s in starts(len(r))], np.int32)

    cut = [(windows(words), y) for words, y in fit_on]
    word_rows, gram_rows, gram_of = net.rows(list(number))
    order = np.argsort(gram_of, kind="stable")
    gram_rows, first = gram_rows[order], np.searchsorted(gram_of[order], np.arange(len(number) + 1))

    def parts(used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word rows, n-gram rows and owners of the words numbered ``used``."""
        sizes = first[used + 1] - first[used]
        owner = np.repeat(np.arange(len(used)), sizes)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[used][owner]
        return word_rows[used], gram_rows[at], owner

    def inputs(ids: np.ndarray) -> np.ndarray:
        """(time, windows, inputs) of (windows, time) word numbers."""
        used, at = np.unique(ids, return_inverse=True)
        table = net.gather(*parts(used))
        table[used == 0] = 0
        return table[at.reshape(ids.shape)].transpose(1, 0, 2)

    # To begin with, the most toxic-looking window is that with the highest odds.
    look = net.gather(word_rows, gram_rows, gram_of[order])
    told = look[:, 0] + look[:, WORD_SIZE]
    told[0] = -9
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.params()]
    tables = [net.word[:, 1:], net.char]
    sparse = [(np.zeros_like(p), np.zeros_like(p)) for p in tables]
    step = epoch = 0
    while epoch < epochs or step < least_steps:
        best = [s.argmax() for s in raw_scores(net, cut, inputs)] if epoch else [told[w].max(1).argmax() for w, _ in cut]
        xs, ys = [], []
        for (w, y), b in zip(cut, best, strict=True):
            take = np.array([b]) if y else np.unique(np.append(rng.permutation(len(w))[:4], b))
            xs.append(w[take])
            ys += [y] * len(take)
        xs, ys = np.concatenate(xs), np.array(ys, np.float32)
        weight = np.where(ys == 1, 0.5 / max(1, ys.sum()), 0.5 / max(1, (1 - ys).sum())).astype(np.float32) * len(ys)
        order = rng.permutation(len(xs))
        for lo in range(0, len(xs), 128):
            pick = order[lo : lo + 128]
            ids = xs[pick]
            mask = padded_mask(ids.T)
            e = inputs(ids)
            x = [e @ net.w[way] + net.b[way] for way in range(2)]
            _, d_u, d_attend, d_query, d_out, d_bias, d_x = gradients(net, x, mask, ys[pick], weight[pick] / len(pick))
            d_w = [np.einsum("tni,tnj->ij", e, d, optimize=True) for d in d_x]
            d_b = [d.sum((0, 1)) for d in d_x]
            step += 1
            for p, g, (m, v) in zip(net.params(), [*d_w, *d_u, *d_b, d_attend, d_query, d_out, d_bias], moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            used, at = np.unique(ids, return_inverse=True)
            d_e = sum(d @ net.w[way].T for way, d in enumerate(d_x)).transpose(1, 0, 2).reshape(-1, INPUTS)
            by_word = np.stack([np.bincount(at.ravel(), weights=d_e[:, k], minlength=len(used)) for k in range(INPUTS)], 1).astype(np.float32)
            by_word[used == 0] = 0
            w_rows, g_rows, owner = parts(used)
            share = by_word[:, WORD_SIZE + 1 :] / np.maximum(1, np.bincount(owner, minlength=len(used)))[:, None]
            for table, (m, v), rows_of, grad in zip(tables, sparse, (w_rows, g_rows), (by_word[:, 1:WORD_SIZE], share[owner]), strict=True):
                rows_at, back = np.unique(rows_of, return_inverse=True)
                g = np.stack([np.bincount(back, weights=grad[:, k], minlength=len(rows_at)) for k in range(grad.shape[1])], 1).astype(np.float32)
                g[rows_at == 0] = 0
                m[rows_at] = 0.9 * m[rows_at] + 0.1 * g
                v[rows_at] = 0.99 * v[rows_at] + 0.01 * g * g
                table[rows_at] -= 0.002 * m[rows_at] / (np.sqrt(v[rows_at]) + 1e-4)
        epoch += 1
    net.trained = True
    # Calibrate on texts that took no part; where those lack a class, on all.
    held = check if len({y for _, y in check}) == 2 else docs
    top = Scorer(net).tops([" ".join(words) for words, _ in held])
    y = np.array([y for _, y in held], float)
    prior = y.mean() if prior is None else min(0.99, max(0.01, prior))
    net.calibration = platt(top.astype(float), y, np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean())))
    return net


def padded_mask(ids: np.ndarray) -> np.ndarray:
    """1 where a word stands, of (time, windows); an empty window attends to its first place."""
    mask = (ids > 0).astype(np.float32)
    mask[0, mask.sum(0) == 0] = 1
    return mask


def raw_scores(net: Network, cut: list[tuple[np.ndarray, int]], inputs) -> list[np.ndarray]:
    """Window logits of each text."""
    everything = np.concatenate([w for w, _ in cut])
    out = np.empty(len(everything), np.float32)
    for lo in range(0, len(everything), 1024):
        ids = everything[lo : lo + 1024]
        e = inputs(ids)
        out[lo : lo + 1024] = forward(net, [e @ net.w[k] + net.b[k] for k in range(2)], padded_mask(ids.T))
    return np.split(out, np.cumsum([len(w) for w, _ in cut])[:-1])


def platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic curve by Newton steps, with a little ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(weight * (p - y) * x).sum() + 0.05 * (a - 1), (weight * (p - y)).sum() + 0.05 * b])
        s = weight * p * (1 - p)
        hess = np.array([[(s * x * x).sum() + 0.05, (s * x).sum()], [(s * x).sum(), s.sum() + 0.05]])
        move = np.linalg.solve(hess, g)
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -2, 2)
    return float(max(a, 1e-3)), float(b)


class Scorer:
    """Scores texts; remembers the gate inputs of words in a table that is begun anew when full."""

    def __init__(self, net: Network):
        self.net = net
        self.weights = np.concatenate(net.w, 1)
        self.shift = np.concatenate(net.b)
        self.reset()

    def reset(self) -> None:
        self.row: dict[str, int] = {"": 0}
        self.table = np.zeros((4096, 6 * HIDDEN), np.float32)
        self.table[0] = self.shift

    def read(self, texts: list[str | None]) -> list[np.ndarray]:
        """Rows of the words of each text; of a text without words, row 0."""
        row = self.row
        words = [words_of(t or "") for t in texts]
        new = sorted({w for ws in words for w in ws if w not in row})
        if new:
            base = len(row)
            if base + len(new) > len(self.table):
                grown = np.zeros((max(2 * len(self.table), base + len(new)), self.table.shape[1]), np.float32)
                grown[:base] = self.table[:base]
                self.table = grown
            self.table[base : base + len(new)] = self.net.embed(new) @ self.weights + self.shift
            row.update(zip(new, range(base, base + len(new)), strict=True))
        return [np.array([row[w] for w in ws] or [0], np.int32) for ws in words]

    def logits(self, ids: np.ndarray) -> np.ndarray:
        """Logits of (windows, time) rows."""
        out = np.empty(len(ids), np.float32)
        for lo in range(0, len(ids), BATCH):
            part = np.ascontiguousarray(ids[lo : lo + BATCH].T)
            used = max(1, int((part > 0).any(1).sum()))
            part = part[:used]  # short windows need fewer steps
            g = self.table[part]
            out[lo : lo + BATCH] = forward(self.net, [g[:, :, : 3 * HIDDEN], g[:, :, 3 * HIDDEN :]], padded_mask(part))
        return out

    def tops(self, texts: list[str | None]) -> np.ndarray:
        """The highest window logit of each text; windows of many texts go together, those of one text in bounded parts."""
        tops = np.full(len(texts), -np.inf, np.float32)
        held, owner, n = [], [], 0

        def run() -> None:
            nonlocal held, owner, n
            if held:
                ids, who = np.concatenate(held), np.concatenate(owner)
                length = (ids > 0).sum(1)
                order = np.argsort(length, kind="stable")  # alike lengths together
                np.maximum.at(tops, who[order], self.logits(ids[order]))
            held, owner, n = [], [], 0

        read: list[np.ndarray] = []
        for i in range(len(texts)):
            if not i % TEXTS:
                if len(self.row) > MEMORY:
                    run()
                    self.reset()
                read = self.read(texts[i : i + TEXTS])
            rows = read[i % TEXTS]
            at = np.array(starts(len(rows)))
            padded = np.concatenate([rows, np.zeros(WINDOW, np.int32)])
            for lo in range(0, len(at), 8192):
                held.append(padded[at[lo : lo + 8192, None] + np.arange(WINDOW)])
                owner.append(np.full(len(held[-1]), i))
                n += len(held[-1])
                if n >= 16_384:
                    run()
        run()
        return tops

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.net.trained:
            return np.full(len(texts), self.net.base)
        a, b = self.net.calibration
        return 1 / (1 + np.exp(-np.clip(a * self.tops(texts).astype(float) + b, -30, 30)))


def bounded(text: Column) -> Column:
    """A text of at most MAX_CHARS characters as it is; of a longer one, SPANS spans from its whole length, MAX_CHARS characters in all."""
    length, size = F.length(text), MAX_CHARS // SPANS

    def span(i: Column) -> Column:
        begin = F.floor(length * i / SPANS)
        spare = F.floor(length * (i + 1) / SPANS) - begin - size
        at = begin + F.pmod(F.xxhash64(text, i), F.greatest(F.lit(1).cast("long"), spare + 1))
        return F.substr(text, (at + 1).cast("int"), F.lit(size))

    return F.when(length > MAX_CHARS, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SPANS - 1)), span), " ")).otherwise(F.coalesce(text, F.lit("")))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS) -> Network:
    """Train on a bounded sample of labelled rows outside the held-out fold; long texts take part by spans of their whole length."""
    fold = labelled.remainder(F.col("doc_id"), FOLDS)
    usable = labels.filter(fold != HELD).agg(F.avg(label)).first()[0] or 0.0
    rows = labelled.sample(docs, labels, label, fold != HELD, max_rows, "toxic", balance=True)
    drawn = rows.select("doc_id", bounded(F.col("text")).alias("text"), "y").collect()  # at most about max_rows * MAX_CHARS characters
    return train([(r["text"], r["y"]) for r in sorted(drawn, key=lambda r: (r["doc_id"], r["text"]))], prior=usable)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of (doc_id, text), repeated rows included; a null text is an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer.scores(b.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, score double")
    held = F.coalesce(labelled.remainder(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    return made.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
