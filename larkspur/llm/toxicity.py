"""Toxicity: a support vector machine on a string kernel, with Nystroem landmarks.

The kernel of two words is the gap-weighted count of the 3-letter subsequences that they share (each weighs ``DECAY`` to the power of its span, spans of
more than ``SPAN`` letters are left out), normalised by both words' own. So ``idxiot`` or ``i-d-i-o-t`` stay close to their word, and a stem with
any ending close to the stem. A sentence meets a landmark at its best word. Landmarks are words of the training sentences; Nystroem features are their kernels,
whitened by the landmarks' kernel matrix; a linear machine is trained on labelled sentences by dual coordinate descent: of toxic documents the sentence that scores
highest, re-chosen each round, of clean ones their hardest. A document scores as its worst sentence, through a logistic curve fitted on documents that the machine didn't see.

Defined results: a null or empty text has the score of a sentence without words; without training labels of both kinds all scores are the share of toxic labels (0.0 without
any); repeated rows are all kept; only ``text`` is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import ship

#: At most so many labelled documents of each label, of at most so many characters, are used to fit.
SAMPLE_DOCS, SAMPLE_CHARS = 2_000, 20_000
LANDMARKS, DECAY, SPAN, CODES = 64, 0.6, 6, 128
#: Kernels made at once: each takes a row of numbers for every subsequence of its word.
BLOCK = 128 * 1024
#: Letters of a unit that are compared at once, and how many of them the next window repeats (a span and a landmark of up to 26 letters lie in one window).
WINDOW, OVERLAP = 64, 32
_PATTERNS = [(a, b, DECAY ** (b + 1)) for a in range(1, SPAN - 1) for b in range(a + 1, SPAN)]
_SENTENCE = re.compile(r"[.!?]+(?=\s|$)|\n+")
_INNER = re.compile(r"[\W\d_]+")


def units(sentence: str) -> list[str]:
    """Words in lower case, letters only (what is inserted between them goes); runs of single letters, with or without punctuation between them, are one word.

    A longer unit than ``WINDOW`` is cut into overlapping windows that cover all of it.
    """
    out, run = [], []

    def add(w: str) -> None:
        out.extend(w[k : k + WINDOW] for k in range(0, max(len(w) - OVERLAP, 1), WINDOW - OVERLAP))

    for w in sentence.lower().split():
        if not w.isalpha():
            w = _INNER.sub("", w)
            if not w:
                continue
        if len(w) == 1:
            run.append(w)
            continue
        if len(run) > 2:
            add("".join(run))
        run = []
        if len(w) > 2:
            add(w)
    if len(run) > 2:
        add("".join(run))
    return out


def sentences(text: str | None) -> list[list[str]]:
    return [units(s) for s in _SENTENCE.split(text or "")]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's subsequences once, sorted by word: the word's number, the subsequence's code and its weight."""
    text = "".join(words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.where(codes < 128, codes & 31, 32 + codes % 89)  # letters keep codes of their own; accented ones share some
    size = np.array([len(w) for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), size)
    end = np.repeat(np.cumsum(size), size)
    at = np.arange(len(codes))
    keys, weights = [], []
    for a, b, w in _PATTERNS:
        i = np.flatnonzero(at + b < end)
        keys.append((owner[i] << 21) | (codes[i] << 14) | (codes[i + a] << 7) | codes[i + b])
        weights.append(np.full(len(i), w))
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    if not len(key):
        return key, key, weight
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first] >> 21, key[first] & (CODES**3 - 1), np.add.reduceat(weight, first)


class Kernel:
    """Kernels of words with fixed landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        owner, code, weight = subsequences(landmarks)
        norm = np.sqrt(np.bincount(owner, weight**2, minlength=len(landmarks)))
        known = np.unique(code)
        self.row = np.full(CODES**3, -1, np.int32)
        self.row[known] = np.arange(len(known))
        self.table = np.zeros((len(known), len(landmarks)), np.float32)
        self.table[self.row[code], owner] = weight / norm[owner]

    def __call__(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        step = max(1, BLOCK // len(self.landmarks))
        for k in range(0, len(words), step):
            part = words[k : k + step]
            owner, code, weight = subsequences(part)
            norm = np.sqrt(np.bincount(owner, weight**2, minlength=len(part)))
            row = self.row[code]
            hit = np.flatnonzero(row >= 0)
            if len(hit):
                o = owner[hit]
                first = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
                sums = np.add.reduceat(self.table[row[hit]] * weight[hit, None].astype(np.float32), first, axis=0)
                out[k + o[first]] = sums / norm[o[first], None]
        return out


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray  # on the kernels with the landmarks: the machine's weights times the whitening
    bias: float
    slope: float
    shift: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


class Scorer:
    def __init__(self, model: Model):
        self.model, self.kernel, self.seen = model, Kernel(model.landmarks), {}
        self.rows = np.zeros((0, len(model.landmarks)), np.float32)

    def features(self, docs: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """Kernels of every sentence with the landmarks (its best word each), and where each document's sentences start."""
        flat = [s for d in docs for s in d]
        if len(self.seen) > 200_000:
            self.seen, self.rows = {}, self.rows[:0]
        fresh = list(dict.fromkeys(w for s in flat for w in s if w not in self.seen))
        if fresh:
            self.seen |= {w: len(self.rows) + i for i, w in enumerate(fresh)}
            self.rows = np.concatenate([self.rows, self.kernel(fresh)])
        ids = np.array([self.seen[w] for s in flat for w in s], np.int64)
        size = np.array([len(s) for s in flat], np.int64)
        out = np.zeros((len(flat), self.rows.shape[1]), np.float32)
        full = np.flatnonzero(size)
        starts = (np.cumsum(size) - size)[full]
        for k in range(0, len(full), 2000):  # few sentences at once: the words' rows take memory
            lo, hi = starts[k], starts[k + 2000] if k + 2000 < len(full) else len(ids)
            out[full[k : k + 2000]] = np.maximum.reduceat(self.rows[ids[lo:hi]], starts[k : k + 2000] - lo, axis=0)
        return out, np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)

    def margins(self, docs: list[list[list[str]]]) -> np.ndarray:
        x, at = self.features(docs)
        return np.maximum.reduceat(x @ self.model.weights + self.model.bias, at[:-1]) if len(docs) else np.zeros(0)


def choose_landmarks(docs: list[list[list[str]]], toxic: np.ndarray, n: int) -> list[str]:
    """Words that tell toxic documents by their log-odds, no two alike, and the commonest of clean ones."""
    bad, good = Counter(), Counter()
    for d, t in zip(docs, toxic, strict=True):
        (bad if t else good).update({w for s in d for w in s})
    nb, ng = max(toxic.sum(), 1), max((~toxic).sum(), 1)
    worth = {w: c / nb * np.log(((c + 0.5) / (nb + 1)) / ((good[w] + 0.5) / (ng + 1))) for w, c in bad.items() if c > 1}
    ranked = sorted(worth, key=lambda w: (-worth[w], w))[:2000]
    chosen: list[str] = []
    if ranked:
        alike = np.concatenate([Kernel(ranked[k : k + 250])(ranked) for k in range(0, len(ranked), 250)], axis=1)  # by columns: a kernel's table grows with its landmarks
        left = np.ones(len(ranked), bool)
        for k in range(len(ranked)):
            if left[k] and worth[ranked[k]] > 0 and len(chosen) < n * 3 // 4:
                chosen.append(ranked[k])
                left &= alike[:, k] < 0.9
    common = sorted(good, key=lambda w: (-good[w], w))
    return list(dict.fromkeys(chosen + common[: n - len(chosen)])) or ["the"]


def train_machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 60, seed: int = 1) -> tuple[np.ndarray, float]:
    """A linear machine with hinge loss, by dual coordinate descent; y is -1 or 1. The bias is one more feature."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    alpha, w, q, rng = np.zeros(len(x)), np.zeros(x.shape[1]), (x**2).sum(1), np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1
            new = min(max(alpha[i] - g / q[i], 0.0), cost[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3:
            break
    return w[:-1], float(w[-1])


def fit(texts: list[str], toxic: list[int], n_landmarks: int = LANDMARKS, rounds: int = 3) -> Model:
    y = np.array(toxic, bool)
    share = float(y.mean()) if len(y) else 0.0
    if not len(y) or y.all() or not y.any():
        return Model(["the"], np.zeros(1, np.float32), 0.0, 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    same: dict[str, str] = {}  # one object for each word, however often it occurs
    docs = [[[same.setdefault(w, w) for w in s] for s in sentences(t)] for t in texts]
    held = np.arange(len(y)) % 5 == 4  # for the logistic curve
    train = np.flatnonzero(~held)
    landmarks = choose_landmarks([docs[i] for i in train], y[train], n_landmarks)
    kernel = Kernel(landmarks)
    values, vectors = np.linalg.eigh(kernel(landmarks).astype(float))
    keep = values > 1e-6 * values[-1]
    white = vectors[:, keep] / np.sqrt(values[keep])
    # The first choice of sentences is by their nearest to a landmark that tells.
    model = Model(landmarks, np.zeros(len(landmarks), np.float32), 0.0, 1.0, 0.0)
    telling = max(1, min(len(landmarks), n_landmarks * 3 // 4))
    scorer = Scorer(model)
    x, at = scorer.features([docs[i] for i in train])
    score = x[:, :telling].max(1)
    for _ in range(rounds):
        rows, label = [], []
        for k, i in enumerate(train):
            order = at[k] + np.argsort(-score[at[k] : at[k + 1]], kind="stable")
            take = order[:1] if y[i] else order[:4]
            rows.extend(take.tolist())
            label.extend([1.0 if y[i] else -1.0] * len(take))
        t = np.array(label)
        cost = np.where(t > 0, (t < 0).sum() / max((t > 0).sum(), 1) * 0.5, 1.0)
        w, bias = train_machine(x[rows] @ white, t, cost)
        model.weights, model.bias = (white @ w).astype(np.float32), bias
        score = x @ model.weights + bias
    margin = scorer.margins([docs[i] for i in np.flatnonzero(held)])
    model.slope, model.shift = _logistic(margin, y[held].astype(float))
    return model


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps, with a little pull to a slope of 1; labels are softened as Platt did."""
    y = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    z, p = np.stack([m, np.ones_like(m)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(z @ p, -30, 30)))
        g = z.T @ (q - y) + 1e-2 * (p - [1.0, 0.0])
        h = (z * (q * (1 - q))[:, None]).T @ z + 1e-2 * np.eye(2)
        p = p - np.clip(np.linalg.solve(h, g), -2, 2)
    return max(float(p[0]), 1e-3), float(p[1])


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, **how) -> Model:
    """Fit on at most sample_docs documents of each label (labels: doc_id, toxic), chosen by hash. docs: doc_id, text."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Twice as many as wanted, as some of them may have no document or too long a one.
    some = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample_docs) for t in (0, 1)]
    picked = some[0].unionByName(some[1]).select(F.col("doc_id").alias("_id"), "toxic")
    joined = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).where(F.length("text") <= sample_chars)
    rows = []
    for t in (0, 1):
        rows += joined.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample_docs).select("text", "toxic").collect()
    order = np.random.default_rng(3).permutation(len(rows))
    return fit([rows[i][0] for i in order], [rows[i][1] for i in order], **how)


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model)
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        scores = []
        for k in range(0, len(texts), 100):
            scores.append(model.probability(scorer.margins([sentences(t) for t in texts[k : k + 100]])))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())], names=[*batch.schema.names[:-1], "score"])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The columns of docs but the text, and score (0 to 1)."""
    ship(docs.sparkSession)
    others = [c for c in docs.columns if c not in (text, "score")]
    ready = docs.select(*others, text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema.fields[:-1])
    return ready.mapInArrow(partial(_scored, model=model), f"{fields}, score double")
