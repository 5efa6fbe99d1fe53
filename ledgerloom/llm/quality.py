"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network.

Each word has two entries: its stripped lower-case core (hashed to CORES rows) and its shape (runs of
lower, upper, digit and the remaining characters themselves, hashed to SHAPES rows). Every entry owns a
fixed sparse ternary index vector; its word vector is the sum of the index vectors met within WINDOW
places, over the fitting sample, normalised. A document is the mean of its word vectors, the norms of
the two means (which rise when few words repeat), the mean products of neighbouring words' unit vectors at distances of
one and two (near 1 where a word is repeated in a row), and its log length. A ReLU layer and a logistic unit
score that, and a temperature fitted on rows kept out of the training makes the scores probabilities.

Defined edge cases: null and empty texts pool to zero vectors and get a score like any other text;
repeated rows are scored each; extra columns are ignored; without labels of both classes every score
is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .labelled import PER_CLASS, labelled_sample
from .textbatch import flat, fold, map_texts

CORES, SHAPES, DIM, WINDOW = 1 << 13, 1 << 9, 32, 2
ROWS = CORES + SHAPES
NEIGHBOURS, LIMIT = (1, 2), 3.0
POOLED = 2 * DIM + 3 + len(NEIGHBOURS)
_RUNS = re.compile(rb"([a-z\x80-\xff]+)|([A-Z]+)|([0-9]+)")


def _shape(word: bytes) -> bytes:
    out = _RUNS.sub(lambda m: b"x" if m[1] else b"X" if m[2] else b"0", word)
    return bytes(c for i, c in enumerate(out) if not i or c != out[i - 1])


class _Entries(dict):
    """word -> core row * 2**16 + shape row."""

    def __missing__(self, word: bytes) -> int:
        core = word.strip(b".,;:!?*#$%&|<>\"'()").lower()
        value = (xxhash.xxh3_64_intdigest(core) % CORES) << 16 | (CORES + xxhash.xxh3_64_intdigest(_shape(word)) % SHAPES)
        self[word] = value
        return value


def index_vectors(seed: int = 11) -> np.ndarray:
    """Four +1 and four -1 in each row."""
    rng = np.random.default_rng(seed)
    out = np.zeros((ROWS, DIM), np.float32)
    for row in out:
        at = rng.choice(DIM, 8, replace=False)
        row[at[:4]], row[at[4:]] = 1, -1
    return out


def _ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    packed, offsets = flat((t.split() for t in texts), _Entries(), np.int64)
    return packed >> 16, packed & 0xFFFF, offsets


def _contexts(texts: list[bytes], index: np.ndarray) -> np.ndarray:
    """Sum, for every entry, of the index vectors within WINDOW words, document by document."""
    table = np.zeros((ROWS, DIM), np.float32)
    core, shape, offsets = _ids(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    for begin in range(0, len(core), 100_000):
        lo, hi = max(0, begin - WINDOW), min(len(core), begin + 100_000 + WINDOW)
        own, d = index[core[lo:hi]] + index[shape[lo:hi]], doc[lo:hi]
        near = np.zeros_like(own)
        for gap in range(1, WINDOW + 1):
            same = (d[:-gap] == d[gap:])[:, None]
            near[:-gap] += own[gap:] * same
            near[gap:] += own[:-gap] * same
        near = near[begin - lo : begin - lo + 100_000]
        for rows in (core[begin : begin + 100_000], shape[begin : begin + 100_000]):
            order = np.argsort(rows, kind="stable")
            starts = np.flatnonzero(np.diff(rows[order], prepend=-1))
            table[rows[order][starts]] += np.add.reduceat(near[order], starts, axis=0)
    return table


def pool(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    core, shape, offsets = _ids(texts)
    out = np.zeros((len(texts), POOLED), np.float32)
    counts = np.diff(offsets)
    for half, rows in ((0, core), (DIM, shape)):
        sums = np.zeros((len(texts), DIM), np.float64)
        begin = 0
        while begin < len(texts):  # so many documents at a time as have about 200,000 words
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + 200_000, "right")) - 1)
            lo, hi = offsets[begin], offsets[end]
            if end == begin + 1:
                for at in range(lo, hi, 200_000):
                    sums[begin] += vectors[rows[at : min(hi, at + 200_000)]].sum(0)
            elif hi > lo:
                some = np.flatnonzero(counts[begin:end])
                sums[begin + some] = np.add.reduceat(vectors[rows[lo:hi]], offsets[begin:end][some] - lo, axis=0)
            begin = end
        out[:, half : half + DIM] = sums / np.maximum(counts, 1)[:, None]
    length = np.maximum(np.linalg.norm(vectors, axis=1), 1e-9).astype(np.float32)
    doc = np.repeat(np.arange(len(texts)), counts)
    for k, gap in enumerate(NEIGHBOURS):
        near = np.zeros(len(texts))
        for lo in range(0, max(0, len(core) - gap), 100_000):
            a, b = core[lo : min(len(core) - gap, lo + 100_000)], core[lo + gap : lo + gap + 100_000]
            same = doc[lo : lo + len(a)] == doc[lo + gap : lo + gap + len(b)]
            product = np.einsum("ij,ij->i", vectors[a], vectors[b]) / (length[a] * length[b])
            near += np.bincount(doc[lo : lo + len(a)], product * same, len(texts))
        out[:, 2 * DIM + k] = near / np.maximum(counts - gap, 1)
    out[:, -3] = np.linalg.norm(out[:, :DIM], axis=1)
    out[:, -2] = np.linalg.norm(out[:, DIM : 2 * DIM], axis=1)
    out[:, -1] = np.log1p(counts)
    return out


def standard(pooled: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Pooled values in standard deviations, LIMIT of them at most: texts of a word or two lie far outside of all others."""
    return np.clip((pooled - mean) / scale, -LIMIT, LIMIT)


@dataclass
class QualityModel:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        hidden = np.maximum(standard(pooled, self.mean, self.scale) @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(pool(texts, self.vectors)) / self.temperature, -40, 40)))


def _train(x, y, w, hidden=24, epochs=60, batch=128, rate=3e-3, seed=5):
    """Adam on the weighted cross-entropy."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            k = order[at : at + batch]
            h = np.maximum(x[k] @ p[0] + p[1], 0)
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -40, 40))) - y[k]) * w[k] / w[k].mean() / len(k)
            back = d[:, None] * p[2] * (h > 0)
            t += 1
            for i, g in enumerate((x[k].T @ back + 1e-4 * p[0], back.sum(0), h.T @ d + 1e-4 * p[2], np.array([d.sum()]))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return p


def temperature(logits, y, w) -> float:
    """The divisor of the logits with the smallest weighted cross-entropy on rows kept out of the fit."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [np.sum(w * np.logaddexp(0, np.where(y == 1, -1, 1) * logits / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> QualityModel:
    """Learn word vectors and network from about ``per_class`` labelled rows of each class."""
    sample = labelled_sample(docs, labels, label, per_class)
    index = index_vectors()

    def contexts(_, texts):
        return pa.RecordBatch.from_arrays([pa.array([_contexts(texts, index).tobytes()], pa.binary())], ["table"])

    table = np.zeros((ROWS, DIM), np.float32)
    for row in map_texts(sample, contexts, "table binary").toLocalIterator():
        table += np.frombuffer(row["table"], np.float32).reshape(ROWS, DIM)
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    # an entry that the sample doesn't have stands for itself
    vectors = np.where(norm > 0, 0.5 * table / np.maximum(norm, 1e-9) + 0.5 * index / np.sqrt(8), index / np.sqrt(8)).astype(np.float32)

    def pooled(kept, texts):
        x = pool(texts, vectors).astype(np.float32)
        return pa.RecordBatch.from_arrays([*kept, pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "weight", "x"])

    rows = map_texts(sample, pooled, "doc_id long, label int, weight double, x binary", ("doc_id", "label", "weight")).withColumn("part", fold("doc_id", 5)).orderBy("doc_id").collect()
    y = np.array([r["label"] for r in rows], np.float64)
    w = np.array([r["weight"] for r in rows], np.float64)
    if not len(y) or y.min() == y.max():
        share = min(max(y.mean(), 0.01), 0.99) if len(y) else 0.5
        zero = np.zeros(POOLED)
        return QualityModel(vectors, zero, zero + 1, np.zeros((POOLED, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), 1.0)
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows]).astype(np.float64)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    held = np.array([r["part"] for r in rows]) == 1
    p = _train(standard(x[~held], mean, scale), y[~held], w[~held])
    model = QualityModel(vectors, mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    model.temperature = temperature(model.logits(x[held]), y[held], w[held])
    return model


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    return with_quality(docs.select("doc_id", "text"), model, "score").select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def with_quality(docs: DataFrame, model: QualityModel, name: str) -> DataFrame:
    """All columns of ``docs`` and the score as column ``name``: a filter on it needs no join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: about 1.1 MB
    columns = docs.columns

    def scores(kept, texts):
        return pa.RecordBatch.from_arrays([*kept, pa.array(shared.value.probabilities(texts).astype(np.float64))], [*columns, name])

    return map_texts(docs, scores, StructType([*docs.schema.fields, StructField(name, DoubleType())]), tuple(columns))
