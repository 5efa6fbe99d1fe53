"""Toxicity: a factorization machine over hashed terms.

A document is the bag of its hashed terms: lower-case words stripped of punctuation and the words' first
4 to 7 bytes. Terms are chosen on the fitting sample by how far their document counts in the two classes
differ; the machine scores ``b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``, so that a pair such as an insult
and a group mention can count for more than both apart. x is 1 + ln(times the text has the term).

Defined edge cases: a null or empty text has no terms and gets the machine's bias; repeated rows are scored
each; extra columns are ignored; without labels of both classes every score is the share of label 1
(0.5 without labels).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .labelled import PER_CLASS, labelled_sample
from .quality import temperature
from .textbatch import Numbering, flat, fold, map_texts

TERMS, FACTORS, MIN_DOCS, L2 = 4096, 8, 4, 1e-3
PREFIXES = (4, 5, 6, 7)
_STRIP = b".,;:!?*#$%&|<>\"'()"


def word_terms(words: list[bytes]) -> np.ndarray:
    """The hashed terms of each word, in columns; 0 where it has none."""
    out = np.zeros((len(words), 1 + len(PREFIXES)), np.uint64)
    for i, word in enumerate(words):
        core = word.strip(_STRIP).lower()
        if core:
            out[i, 0] = xxhash.xxh3_64_intdigest(core)
            for k, n in enumerate(PREFIXES):
                if len(core) > n:
                    out[i, k + 1] = xxhash.xxh3_64_intdigest(core[:n], seed=n)
    return out


def _bags(texts: list[bytes], of_words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text, the distinct nonzero terms and how often it has each; of_words gives a row of terms for each word."""
    vocabulary = Numbering()
    at, offsets = flat((t.split() for t in texts), vocabulary, np.int64)
    table = of_words(list(vocabulary))
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        found = table[at[a:b]]
        values, times = np.unique(found[found != 0], return_counts=True)
        out.append((values, np.minimum(times, 65535)))
    return out


@dataclass
class ToxicityModel:
    known: np.ndarray  # sorted term hashes
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    temperature: float

    def index(self, hashes: np.ndarray) -> np.ndarray:
        """Place among the known terms, from 1; 0 for an unknown one."""
        if not len(self.known):
            return np.zeros(hashes.shape, np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at + 1, 0)

    def logits(self, bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.empty(len(bags))
        for i, (k, x) in enumerate(bags):
            v = self.factors[k - 1] * x[:, None]
            s = v.sum(0)
            out[i] = self.bias + self.linear[k - 1] @ x + 0.5 * (s @ s - (v * v).sum())
        return out

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        bags = [(k, 1 + np.log(n)) for k, n in _bags(texts, lambda words: self.index(word_terms(words)))]
        return 1 / (1 + np.exp(-np.clip(self.logits(bags) / self.temperature, -40, 40)))


def _choose(counts: DataFrame, n_pos: int, n_neg: int) -> np.ndarray:
    """The TERMS terms of (term, pos, neg) whose document counts differ most between the classes, in standard errors."""
    p, n = max(1, n_pos), max(1, n_neg)
    pos, neg = F.col("pos"), F.col("neg")
    rate = (pos + neg + 1) / F.lit(float(p + n + 2))
    z = F.abs(pos / p - neg / n) / F.sqrt(rate * (1 - F.least(rate, F.lit(0.999))) * (1 / p + 1 / n))
    best = counts.where(pos + neg >= MIN_DOCS).select("term", z.alias("z")).where("z > 0").orderBy(F.desc("z"), "term").limit(TERMS).collect()
    return np.sort(np.array([r["term"] for r in best], np.int64).view(np.uint64))


def _train(bags: list, y: np.ndarray, w: np.ndarray, n_terms: int, epochs: int = 12, batch: int = 64, rate: float = 0.05, seed: int = 3):
    """Adagrad on the weighted cross-entropy with L2 on weights and factors."""
    rng = np.random.default_rng(seed)
    bias, gb = float(np.log(max(np.sum(w * y), 1e-3) / max(np.sum(w * (1 - y)), 1e-3))), 1e-8
    lin, gl = np.zeros(n_terms), np.full(n_terms, 1e-8)
    fac, gf = rng.normal(0, 0.02, (n_terms, FACTORS)), np.full((n_terms, FACTORS), 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            docs = order[at : at + batch]
            ids = np.concatenate([bags[d][0] for d in docs]) - 1
            x = np.concatenate([bags[d][1] for d in docs])
            row = np.repeat(np.arange(len(docs)), [len(bags[d][0]) for d in docs])
            v = fac[ids] * x[:, None]
            sums = np.zeros((len(docs), FACTORS))
            np.add.at(sums, row, v)
            z = bias + np.bincount(row, lin[ids] * x, len(docs)) + 0.5 * ((sums**2).sum(1) - np.bincount(row, (v * v).sum(1), len(docs)))
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[docs]) * w[docs]
            gb += d.sum() ** 2
            bias -= rate * d.sum() / np.sqrt(gb)
            touched, back = np.unique(ids, return_inverse=True)
            g1 = np.bincount(back, d[row] * x) + L2 * lin[touched]
            g2 = np.zeros((len(touched), FACTORS))
            np.add.at(g2, back, (d[row] * x)[:, None] * (sums[row] - v))
            g2 += 10 * L2 * fac[touched]
            gl[touched] += g1**2
            gf[touched] += g2**2
            lin[touched] -= rate * g1 / np.sqrt(gl[touched])
            fac[touched] -= rate * g2 / np.sqrt(gf[touched])
    return bias, lin, fac


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> ToxicityModel:
    """Fit on about ``per_class`` labelled rows of each class; terms are counted and chosen by Spark, and the driver holds how often a document has each chosen one."""
    sample = labelled_sample(docs, labels, label, per_class).withColumn("part", fold("doc_id", 5))

    def count(kept, texts):
        bags = _bags(texts, word_terms)
        if not any(len(t) for t, _ in bags):
            return None
        positive = np.repeat(kept[0].to_numpy() == 1, [len(t) for t, _ in bags])
        terms, at = np.unique(np.concatenate([t for t, _ in bags]), return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), *(pa.array(np.bincount(at[mine], minlength=len(terms)).astype(np.int64)) for mine in (positive, ~positive))], ["term", "pos", "neg"])

    sizes = Counter()
    for r in sample.groupBy("label", "part").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["label"], r["part"] == 1] += r["n"]
    total = {k: sizes[k, False] + sizes[k, True] for k in (0, 1)}
    if not total[0] or not total[1]:
        share = min(max(total[1] / sum(total.values()), 0.01), 0.99) if sum(total.values()) else 0.5
        return ToxicityModel(np.zeros(0, np.uint64), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, FACTORS)), 1.0)
    counts = map_texts(sample.where("part <> 1"), count, "term long, pos long, neg long", ("label",)).groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    known = _choose(counts, sizes[1, False], sizes[0, False])
    model = ToxicityModel(known, 0.0, np.zeros(len(known)), np.zeros((len(known), FACTORS)), 1.0)

    def gather(kept, texts):
        bags = _bags(texts, lambda words: model.index(word_terms(words)))
        return pa.RecordBatch.from_arrays([*kept, pa.array([t.astype(np.uint16).tobytes() for t, _ in bags], pa.binary()), pa.array([n.astype(np.uint16).tobytes() for _, n in bags], pa.binary())], ["doc_id", "label", "weight", "part", "t", "x"])

    rows = map_texts(sample, gather, "doc_id long, label int, weight double, part long, t binary, x binary", ("doc_id", "label", "weight", "part")).orderBy("doc_id").collect()
    y = np.array([r["label"] for r in rows], np.float64)
    w = np.array([r["weight"] for r in rows], np.float64)
    w = w / w.mean()
    bags = [(np.frombuffer(r["t"], np.uint16).astype(np.int64), 1 + np.log(np.frombuffer(r["x"], np.uint16))) for r in rows]
    fit = np.array([r["part"] for r in rows]) != 1
    mine = np.flatnonzero(fit)
    model.bias, model.linear, model.factors = _train([bags[i] for i in mine], y[mine], w[mine], len(known))
    held = np.flatnonzero(~fit)
    model.temperature = temperature(model.logits([bags[i] for i in held]), y[held], w[held])
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TERMS rows at most: about 0.3 MB

    def scores(kept, texts):
        return pa.RecordBatch.from_arrays([kept[0], pa.array(shared.value.probabilities(texts))], ["doc_id", "score"])

    return map_texts(docs, scores, "doc_id long, score double").select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
