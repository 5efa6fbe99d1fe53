"""Language-model scores by deleted interpolation.

Tokens are lower-case words and one end per document. For a token w after u the model says

    P(w | u) = a2 * c(u, w) / c(u) + a1 * c(w) / N + a0 / S

over S symbols: all different training words, the end, and one place for an unseen word. So the probabilities
sum to one (a2 is 0 after an unseen word). The weights a2, a1, a0 depend on the context's frequency,
in BUCKETS powers of four, and are learned by expectation-maximisation on held-out counts: training documents of
one more fold are scored with the counts of the others.

Counts cover every word and every pair of every training document. A chunk of documents sends the hashes of its different words and pairs
with how often its training documents have them, and gets the counts of the whole corpus back (see exchange), whatever
the size of the vocabulary. With its counts a chunk is written once, its texts as numbers of its words; the held-out tokens enter EM as a histogram of
their two ratios, which has a fixed size, and with the weights each chunk's texts are scored where they lie.

Words and pairs are told apart by hashes; one in 2^25 or fewer falls together with another one (up to corpora of 2^38 bytes, and with 64 bits beyond them).

Defined edge cases: a null or empty text is its end token; null ids are scored and form the fold of the empty string;
repeated rows count as often as they occur and get one score each; with no training tokens the model is uniform; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.tables import materialise
from .exchange import corpus_bytes, distinct, exchange, key_mask, planes, unplanes
from .textbatch import fold, mix, word_hashes

BUCKETS, CELLS = 10, 48
FOLDS, SCORED_FOLD, HELD_FOLD = 7, 2, 3
END_HASH = 0x454E44
_STEP, _ONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(1)
CHUNK = (
    "doc_id array<long>, part array<long>, ends array<int>, tokens binary, counts binary, pairs binary, "
    "cell array<int>, n array<double>, p2 array<double>, c1 array<double>, totals array<double>"
)


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the different tokens; every token's place among them, with the end (place 0) behind each document; and the
    offsets of the documents."""
    hashes, at, offsets = word_hashes(texts, lower=True)
    return mix(np.insert(hashes, 0, np.uint64(END_HASH))), np.insert(at + 1, offsets[1:], 0), offsets + np.arange(len(offsets))


def _before(at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The token before each one; a document begins after an end."""
    before = np.empty_like(at)
    before[1:] = at[:-1]
    before[offsets[:-1]] = 0
    return before


def _keys(words: np.ndarray, at: np.ndarray, before: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The keys of a chunk, words first, then one pair for each token; and how they sort and differ. The lowest bit that is kept
    tells words from pairs."""
    flag = mask & (~mask + _ONE)
    keys = np.concatenate((words & mask | flag, mix(words[before] * _STEP + words[at]) & mask & ~flag))
    return keys, distinct(keys)


def _bucket(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int64) // 2 + (counts > 0), BUCKETS - 1)


def _cell(ratio: np.ndarray) -> np.ndarray:
    """Half-octave cells of a ratio up to 1; 0 for none."""
    return np.where(ratio > 0, np.clip(2 * np.log2(np.maximum(ratio, 1e-300)) + CELLS, 1, CELLS).astype(np.int64), 0)


def _histogram(pair: np.ndarray, before: np.ndarray, token: np.ndarray) -> list[np.ndarray]:
    """Held-out tokens by retained counts of pair, context and token: cell, how many, sum of pair ratios, sum of token counts."""
    ratio = pair / np.maximum(before, 1)
    octave = np.where(token > 0, np.minimum(2 * np.log2(np.maximum(token, 1)).astype(np.int64) + 1, 127), 0)
    cells, at = np.unique((_bucket(before) * 64 + _cell(ratio)) * 128 + octave, return_inverse=True)
    return [cells, np.bincount(at, minlength=len(cells)), np.bincount(at, ratio, len(cells)), np.bincount(at, token, len(cells))]


def learn_weights(cells: list, uniform: float, rounds: int = 100) -> np.ndarray:
    """EM over (bucket, n, sum of pair ratios, sum of word ratios): rows a2, a1, a0 of each bucket."""
    out = np.tile([0.4, 0.5, 0.1], (BUCKETS, 1))
    for b in range(BUCKETS):
        mine = [c for c in cells if c[0] == b]
        if not mine:
            continue
        n = np.array([c[1] for c in mine], np.float64)
        p = np.stack([np.array([c[2] for c in mine]) / n, np.array([c[3] for c in mine]) / n, np.full(len(mine), uniform)], 1)
        a = out[b]
        for _ in range(rounds):
            share = p * a
            share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
            a = (share * n[:, None]).sum(0) / n.sum()
        out[b] = np.maximum(a, 1e-6) / np.maximum(a, 1e-6).sum()
    # a bucket without held-out tokens takes the weights of the one below it
    seen = {c[0] for c in cells}
    for b in range(1, BUCKETS):
        if b not in seen:
            out[b] = out[b - 1]
    out[0] *= (0, 1, 1)  # an unseen context has no pairs
    out[0] /= out[0].sum()
    return out


def _counted(docs: DataFrame, scored: int, held: int) -> DataFrame:
    """Chunks with their documents' tokens and all counts, held-out histograms, and totals."""
    size = corpus_bytes(docs)
    mask = key_mask(size, 26)
    flag = mask & (~mask + _ONE)
    end = mix(np.array([END_HASH], np.uint64))[0] & mask | flag

    def send(kept, texts):
        words, at, offsets = _tokens(texts)
        part = np.repeat(kept[1].to_numpy(zero_copy_only=False), np.diff(offsets))
        keys, (order, begins, which) = _keys(words, at, _before(at, offsets), mask)
        times = np.zeros((2, len(begins)), np.int64)
        for k, mine in enumerate(((part != scored) & (part != held), part == held)):
            times[k] = np.bincount(which[at[mine]], minlength=len(begins)) + np.bincount(which[len(words):][mine], minlength=len(begins))
        return keys[order[begins]], list(times), None

    def tell(kept, texts):
        words, at, offsets = _tokens(texts)
        info = [kept[0].cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).tobytes(), kept[0].is_null().to_numpy(zero_copy_only=False).tobytes(), kept[1].to_numpy(zero_copy_only=False).astype("<i8").tobytes()]
        return [*info, offsets.astype("<i4").tobytes(), words.tobytes(), planes(at)]

    def answer(keys, kept, own):
        order, begins, which = distinct(keys)
        kept, own = (np.add.reduceat(x[order], begins) for x in (kept, own))
        words = keys[order[begins]] & flag != 0
        return [kept[which], own[which]], np.array([words @ kept, words @ own, (words & (kept + own > 0)).sum(), ((keys[order[begins]] == end) & (kept + own > 0)).sum()], np.float64)

    def receive(info, answers):
        names = [x.split(" ")[0] for x in CHUNK.split(", ")]
        lists = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), *[pa.list_(pa.float64())] * 4]
        if info is None:
            row = [[], [], [], None, None, None, [], [], [], [], answers[0].tolist()]
            return pa.table({k: pa.array([x], t) for k, x, t in zip(names, row, lists, strict=True)})
        ids, null, part = np.frombuffer(info[0], "<i8"), np.frombuffer(info[1], bool), np.frombuffer(info[2], "<i8")
        offsets, words = np.frombuffer(info[3], "<i4").astype(np.int64), np.frombuffer(info[4], "<u8")
        at = unplanes(info[5], int(offsets[-1])).astype(np.int64)
        before = _before(at, offsets)
        _, (_, _, which) = _keys(words, at, before, mask)
        kept, own = answers
        w, p = which[: len(words)], which[len(words):]
        mine = np.repeat(part == held, np.diff(offsets))
        histogram = _histogram(kept[p[mine]], kept[w[before[mine]]], kept[w[at[mine]]])
        total = kept + own
        row = [[None if z else i for i, z in zip(ids.tolist(), null.tolist(), strict=True)], part, offsets, planes(at), planes(total[w]), planes(total[p]), *histogram, []]
        return pa.table({k: pa.array([x], t) for k, x, t in zip(names, row, lists, strict=True)})

    return materialise(exchange(docs, send, answer, receive, CHUNK, ("doc_id", "part"), size=size, tell=tell))


def score_texts(docs: DataFrame, folds: int = FOLDS, scored: int = SCORED_FOLD, held: int = HELD_FOLD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, score_per_token of every row.

    ``base_score`` is the unigram score with add-one counts over all words; scores are log10. Documents of
    the fold ``scored`` are scored but never learned from.
    """
    spark = docs.sparkSession
    chunks = _counted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold("doc_id", folds).alias("part"), "text"), scored, held)
    totals = np.zeros(4)
    for r in chunks.where(F.size("totals") > 0).select("totals").collect():  # 64 rows at most
        totals += r["totals"]
    n_kept, n_own, different, ends = (int(x) for x in totals)
    n, size = n_kept + n_own, different - (ends > 0) + 2
    cells = chunks.select(F.explode(F.arrays_zip("cell", "n", "p2", "c1")).alias("x")).select("x.*").groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("n", "p2", "c1"))).orderBy("cell").collect()  # BUCKETS * 64 * 128 at most
    weights = learn_weights([(r["cell"] >> 13, r["n"], r["p2"], r["c1"] / max(n_kept, 1)) for r in cells], 1 / size)
    floor = float(np.log10(n + different + 1))

    def score(batches):
        for b in batches:
            for row in b.to_pylist():
                offsets = np.array(row["ends"], np.int64)
                lengths = np.diff(offsets)
                at = unplanes(row["tokens"], int(offsets[-1])).astype(np.int64)
                counts = unplanes(row["counts"], int(at.max()) + 1).astype(np.int64)
                pair = unplanes(row["pairs"], len(at)).astype(np.float64)
                token, context = counts[at], counts[_before(at, offsets)]
                mixed = weights[_bucket(counts)][_before(at, offsets)]
                p = mixed[:, 0] * pair / np.maximum(context, 1) + mixed[:, 1] * token / max(n, 1) + mixed[:, 2] / size
                total = np.add.reduceat(np.log10(p), offsets[:-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_id"], pa.int64()), pa.array(np.array(row["part"]) == scored), pa.array(lengths), pa.array(np.add.reduceat((token > 0).astype(np.int64), offsets[:-1])),
                        pa.array(np.full(len(lengths), n)), pa.array(np.add.reduceat(np.log10(counts + 1)[at], offsets[:-1]) - lengths * floor), pa.array(total), pa.array(total / lengths),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "score_per_token"],
                )

    rows = chunks.where(F.size("totals") == 0).select("doc_id", "part", "ends", "tokens", "counts", "pairs")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, score_per_token double")
