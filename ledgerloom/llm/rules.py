"""Quality rules: fixed text statistics, then a logistic regression on hashed word and character n-grams.

Features of a text are the relative frequencies of hashed words, of hashed word pairs, of hashed byte
trigrams and of word n-grams without their words (which of the BACK words before a word it equals), WORD_ROWS + PAIR_ROWS + CHAR_ROWS + 2 ** BACK
rows in all, so a text's logit is the bias plus four means of learned weights; training minimises the weighted logistic loss with L2 on a bounded sample of labelled quality rows,
and Platt scaling on rows kept out of it calibrates the probability. Texts are scored whole, in Arrow batches.

Defined edge cases: null and empty texts have no words and fail the base rules (fewer than ten words); repeated rows
are judged each; other columns are ignored; without labels of both classes every score is the share of label 1
(0.5 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .labelled import PER_CLASS, labelled_sample
from .textbatch import Numbering, flat, fold, map_texts, rolling

WORD_ROWS, PAIR_ROWS, CHAR_ROWS = 1 << 14, 1 << 14, 1 << 14
BACK = 8
ROWS = WORD_ROWS + PAIR_ROWS + CHAR_ROWS + (1 << BACK)
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
SYMBOLS = b"#*$%&|<>"


def rule_counts(texts: list[bytes]) -> dict[str, list[int]]:
    """The five counts of each text. A character counts as one code point; windows compare words as they are."""
    number = Numbering()
    split = [t.split() for t in texts]
    at, offsets = flat(split, number, np.int64)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))
    lengths = np.fromiter((len(w.decode("utf-8", "replace")) for w in number), np.int64, len(number))
    rolled = rolling(hashes[at], WINDOW) if len(at) else np.zeros(0, np.uint64)
    out: dict[str, list[int]] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    for i, text in enumerate(texts):
        a, b = offsets[i], offsets[i + 1]
        out["n_words"].append(int(b - a))
        out["word_chars"].append(int(lengths[at[a:b]].sum()))
        out["n_symbols"].append(len(text) - len(text.translate(None, SYMBOLS)))
        lines = [line for line in text.split(b"\n") if line.split(None, 1)]
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        cover = 0
        if b - a > WINDOW:
            _, back, times = np.unique(rolled[a : b - WINDOW + 1], return_inverse=True, return_counts=True)
            mark = np.zeros(b - a + 1, np.int64)
            begins = np.flatnonzero(times[back] > 1)
            mark[begins] += 1
            mark[begins + WINDOW] -= 1
            cover = int((np.cumsum(mark)[:-1] > 0).sum())
        out["n_repeat_words"].append(cover)
    return out


def _features(texts: list[bytes]) -> tuple[list[np.ndarray], ...]:
    """Rows of the words, of the word pairs, of the byte trigrams and of the equalities of each text, with repeats."""
    number = Numbering()
    at, offsets = flat((t.split() for t in texts), number, np.int64)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.lower()) for w in number), np.uint64, len(number))[at] if len(at) else np.zeros(0, np.uint64)
    words = (hashes % np.uint64(WORD_ROWS)).astype(np.int32)
    pairs = (rolling(hashes, 2) % np.uint64(PAIR_ROWS)).astype(np.int32) + WORD_ROWS
    cuts = list(zip(offsets[:-1], offsets[1:], strict=True))
    begin = np.repeat(offsets[:-1], np.diff(offsets))
    equal = np.full(len(at), WORD_ROWS + PAIR_ROWS + CHAR_ROWS, np.int32)
    for k in range(1, BACK + 1):
        equal[k:] += ((hashes[k:] == hashes[:-k]) & (np.arange(k, len(at)) - k >= begin[k:])).astype(np.int32) << (k - 1)
    chars = []
    for t in texts:
        raw = np.frombuffer(t, np.uint8).astype(np.uint32)
        gram = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:] if len(raw) > 2 else raw[:0]
        chars.append(((gram * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int32) + WORD_ROWS + PAIR_ROWS)
    return [words[a:b] for a, b in cuts], [pairs[a : max(a, b - 1)] for a, b in cuts], chars, [equal[a:b] for a, b in cuts]


@dataclass
class RuleModel:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def logits(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for rows in _features(texts):
            for i, r in enumerate(rows):
                if len(r):
                    out[i] += self.weights[r].mean()
        return out

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(texts) + self.shift, -40, 40)))


def _train(doc: np.ndarray, row: np.ndarray, value: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 150, rate: float = 0.5, l2: float = 3e-3, floor: float = 0.1):
    """Full-batch Adagrad; a feature's value is scaled by its root mean square, but a rare feature's hardly."""
    scale = np.sqrt(np.bincount(row, value**2, ROWS) / max(len(y), 1)) + floor
    x = value / scale[row]
    theta, bias = np.zeros(ROWS), float(np.log((w @ y + 1) / (w @ (1 - y) + 1)))
    past, past_bias = np.full(ROWS, 1e-8), 1e-8
    w = w / w.sum()
    for _ in range(rounds):
        d = (1 / (1 + np.exp(-np.clip(np.bincount(doc, x * theta[row], len(y)) + bias, -30, 30))) - y) * w
        g = np.bincount(row, x * d[doc], ROWS) + l2 * theta
        past += g**2
        past_bias += d.sum() ** 2
        theta -= rate * 0.1 * g / np.sqrt(past)
        bias -= rate * d.sum() / np.sqrt(past_bias)
    return theta / scale, bias


def _platt(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logits by Newton's method, lightly drawn to (1, 0)."""
    a, b = 1.0, 0.0
    if not len(y):
        return a, b
    w = w / w.mean()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([(w * (p - y)) @ z + (a - 1), (w * (p - y)).sum() + 0.1 * b])
        s = w * p * (1 - p)
        h = np.array([[(s * z) @ z + 1, s @ z], [s @ z, s.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (a, b) if a > 0 else (1.0, 0.0)


def fit_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS // 2) -> RuleModel:
    """Fit on about ``per_class`` labelled rows of each class; the driver holds their hashed counts only."""
    sample = labelled_sample(docs, labels, label, per_class)

    def gather(kept, texts):
        packed = []
        for parts in zip(*_features(texts), strict=True):
            rows, values = [], []
            for part in parts:
                r, n = np.unique(part, return_counts=True)
                rows.append(r)
                values.append((n / max(len(part), 1)).astype(np.float32))
            packed.append((np.concatenate(rows).astype(np.int32).tobytes(), np.concatenate(values).tobytes()))
        return pa.RecordBatch.from_arrays([*kept, pa.array([r for r, _ in packed], pa.binary()), pa.array([v for _, v in packed], pa.binary())], ["doc_id", "label", "weight", "r", "v"])

    got = map_texts(sample, gather, "doc_id long, label int, weight double, r binary, v binary", ("doc_id", "label", "weight")).withColumn("part", fold("doc_id", 5)).orderBy("doc_id").collect()
    y, w = np.array([g["label"] for g in got], float), np.array([g["weight"] for g in got], float)
    if not len(y) or y.min() == y.max():
        share = min(max(y.mean(), 0.01), 0.99) if len(y) else 0.5
        return RuleModel(np.zeros(ROWS), float(np.log(share / (1 - share))), 1.0, 0.0)
    rows, values = [np.frombuffer(g["r"], np.int32) for g in got], [np.frombuffer(g["v"], np.float32).astype(float) for g in got]
    held = np.array([g["part"] for g in got]) == 1
    fit = np.flatnonzero(~held)
    doc = np.repeat(np.arange(len(fit)), [len(rows[i]) for i in fit])
    weights, bias = _train(doc, np.concatenate([rows[i] for i in fit]), np.concatenate([values[i] for i in fit]), y[fit], w[fit])
    z = np.array([bias + weights[rows[i]] @ values[i] for i in np.flatnonzero(held)])
    slope, shift = _platt(z, y[held], w[held])
    return RuleModel(weights, bias, slope, shift)


def apply_rules(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, the five counts, base_failed, score and kept of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ROWS weights: 0.4 MB

    def judge(kept, texts):
        counts = rule_counts(texts)
        return pa.RecordBatch.from_arrays([kept[0], *(pa.array(v, pa.int64()) for v in counts.values()), pa.array(shared.value.probabilities(texts))], ["doc_id", *counts, "score"])

    out = map_texts(docs, judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))
