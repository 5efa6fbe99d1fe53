"""Exact substring de-duplication with fixed-block anchors.

A word is removed when a window of WINDOW words that covers it also starts earlier: in a document with a smaller
id, or earlier in the same one.

1. Anchors. Every document's non-overlapping blocks of BLOCK words (places 0, 10, 20, ...) are the index; the
   rolling windows of BLOCK words at every place are the probes. A chunk of documents sends the hash of each different probe once,
   with the number of blocks that have it (none, one, more), and learns how many blocks of the corpus have it (see
   exchange). A place is a hit if a block other than itself has its hash. A window of 20 words holds a whole block wherever
   it begins, so a repeated window has a hit within it on both sides.
2. Extension. Windows of WINDOW words that hold a hit are hashed, and those that have an equal one at an earlier place are
   kept; neighbours among them make up the maximal exact repeats. (Hits are extended by hashing around them rather
   than pair by pair: a passage that a third of all texts share has as many pairs as the square of that.) A chunk compares its own windows
   first and sends the earliest of each kind, so such a passage sends a row for each chunk, not for each text.
3. Covered words are dropped, and the rest is joined and digested.

Hashes of probes only choose where to look, so that one in 256 may be a hit by chance at any size of the corpus; hashes of windows have 64 bits.

Rows are told apart by their id and a hash of their text. Defined edge cases: null, empty and blank texts have no words and an empty
rest; texts under 20 words lose nothing; rows that share an id are one document in the order of places: the same place of two such rows is earlier in
neither, so repeated rows keep what none of them has earlier; a null id counts as the largest id; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.tables import BROADCAST_ROWS, materialise
from .exchange import corpus_bytes, distinct, exchange, key_mask, planes, unplanes
from .textbatch import map_texts, rolling, word_hashes

WINDOW, BLOCK = 20, 10
NO_ID = (1 << 63) - 1
REPEATS = "key long, doc_id long, row long, at int, runs array<int>"


def _probes(values: np.ndarray, offsets: np.ndarray, block: int, mask: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat places of all probes, whether each is a block of its document, and their hashes."""
    hashes = rolling(values, block)
    place = np.arange(len(hashes))
    begin = np.repeat(offsets[:-1], np.diff(offsets))[: len(hashes)]
    end = np.repeat(offsets[1:], np.diff(offsets))[: len(hashes)]
    inside = place + block <= end
    return place[inside], ((place - begin) % block == 0)[inside], hashes[inside] & mask


def _runs(places: np.ndarray) -> list[int]:
    """[first, last, first, last, ...] of runs of consecutive places (sorted)."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    return np.stack((places[np.append(0, cut + 1)], places[np.append(cut, len(places) - 1)]), 1).ravel().tolist()


def _earliest(docs: DataFrame, window: int, block: int) -> DataFrame:
    """The earliest windows of each chunk, and (key null) for each document the windows that are later than another one of the chunk."""
    size = corpus_bytes(docs)
    mask = key_mask(size, 8)

    def send(_, texts):
        words, at, offsets = word_hashes(texts)
        _, aligned, keys = _probes(words[at], offsets, block, mask)
        order, begins, _ = distinct(keys)
        blocks = np.minimum(np.add.reduceat(aligned[order].astype(np.int64), begins), 2) if len(begins) else np.zeros(0, np.int64)
        return keys[order[begins]], [blocks], None

    def tell(kept, texts):
        words, at, offsets = word_hashes(texts)
        return [*(k.to_numpy(zero_copy_only=False).astype("<i8").tobytes() for k in kept), offsets.astype("<i4").tobytes(), words.tobytes(), planes(at)]

    def answer(keys, blocks):
        order, begins, which = distinct(keys)
        return [np.minimum(np.add.reduceat(blocks[order], begins), 2)[which]], None

    def receive(info, answers):
        doc_id, row, offsets, words = (np.frombuffer(x, t) for x, t in zip(info, ("<i8", "<i8", "<i4", "<u8"), strict=False))
        offsets = offsets.astype(np.int64)
        values = words[unplanes(info[4], int(offsets[-1])).astype(np.int64)]
        place, aligned, keys = _probes(values, offsets, block, mask)
        if len(keys):
            _, _, which = distinct(keys)
            place = place[answers[0].astype(np.int64)[which] > aligned]
        doc = np.searchsorted(offsets, place, "right") - 1
        low, high = np.maximum(place - (window - block), offsets[doc]), np.minimum(place, offsets[doc + 1] - window)
        wanted = np.zeros(len(values) + 1, np.int64)
        np.add.at(wanted, low[high >= low], 1)
        np.add.at(wanted, high[high >= low] + 1, -1)
        at = np.flatnonzero(np.cumsum(wanted) > 0)
        key = rolling(values, window)[at].view(np.int64)
        doc = np.searchsorted(offsets, at, "right") - 1
        at = at - offsets[doc]
        order = np.lexsort((row[doc], at, doc_id[doc], key))
        key, doc, at = key[order], doc[order], at[order]
        begins = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        first = np.repeat(begins, np.diff(np.append(begins, len(key))))
        later = (doc_id[doc] != doc_id[doc[first]]) | (at != at[first])
        # rows with equal id and text say the same: one of them does
        twin = np.append(False, (key[1:] == key[:-1]) & (at[1:] == at[:-1]) & (doc_id[doc[1:]] == doc_id[doc[:-1]]) & (row[doc[1:]] == row[doc[:-1]]))[: len(key)]
        some = ~later & ~twin
        by_doc = np.flatnonzero(some)[np.lexsort((at[some], doc[some]))]  # neighbours are alike then, and travel compressed
        columns = [key[by_doc], doc_id[doc[by_doc]], row[doc[by_doc]], at[by_doc]]
        order = np.lexsort((at[later], doc[later]))
        with_later, cuts = np.unique(doc[later][order], return_index=True)
        runs = [_runs(x) for x in np.split(at[later][order], cuts[1:])] if len(with_later) else []
        names = [x.split(" ")[0] for x in REPEATS.split(", ")]
        own = pa.table([*(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)), pa.nulls(len(columns[0]), pa.list_(pa.int32()))], names)
        known = pa.table([pa.nulls(len(runs), pa.int64()), pa.array(doc_id[with_later], pa.int64()), pa.array(row[with_later], pa.int64()), pa.nulls(len(runs), pa.int32()), pa.array(runs, pa.list_(pa.int32()))], names)
        return pa.concat_tables([own, known])

    return exchange(docs, send, answer, receive, REPEATS, ("doc_id", "row"), size=size, tell=tell)


def _repeats(docs: DataFrame, window: int, block: int) -> DataFrame:
    """(doc_id, row, at): places, as runs, of windows that also start earlier."""
    # of the windows that are the earliest of their chunk, all but those at the earliest place of the corpus (which rows sharing an id may share)
    order = Window.partitionBy(F.coalesce("key", "row"), F.col("key").isNull()).orderBy("doc_id", "at")
    ranked = _earliest(docs, window, block).withColumn("rank", F.rank().over(order))
    runs = ranked.where("key is null or rank > 1").select("doc_id", "row", F.coalesce("runs", F.array("at", "at")).alias("at"))

    def merge(batches):
        for b in batches:
            out = []
            for flat_runs in b.column(2).to_pylist():
                pairs = np.asarray(flat_runs, np.int64).reshape(-1, 2)
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                last = np.maximum.accumulate(pairs[:, 1])
                cut = np.append(True, pairs[1:, 0] > last[:-1] + 1)
                out.append(np.stack((pairs[cut, 0], last[np.append(cut[1:], True)]), 1).ravel().tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "row", "at"])

    gathered = runs.groupBy("doc_id", "row").agg(F.flatten(F.collect_set("at")).alias("at"))
    return materialise(gathered.mapInArrow(merge, "doc_id long, row long, at array<int>"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the remaining words, joined by a space) of every row.

    ``window`` must be at least ``2 * block - 1``.
    """
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block wherever it begins")
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("row"), "text")
    repeats = _repeats(docs, window, block)
    size = repeats.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("at")).alias("m")).first()
    if size["n"] <= BROADCAST_ROWS and (size["m"] or 0) <= 16 * BROADCAST_ROWS:
        repeats = F.broadcast(repeats)  # counted; beyond that both sides are shuffled

    def rest(kept, texts):
        n, removed, digests, left = [], [], [], []
        for text, runs in zip(texts, kept[1].to_pylist(), strict=True):
            words = text.split()
            n.append(len(words))
            if runs:
                cover = np.zeros(len(words) + 1, np.int64)
                spans = np.asarray(runs).reshape(-1, 2)
                np.add.at(cover, spans[:, 0], 1)
                np.add.at(cover, np.minimum(spans[:, 1] + window, len(words)), -1)
                gone = np.cumsum(cover)[:-1] > 0
                removed.append(int(gone.sum()))
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            else:
                removed.append(0)
            left.append(b" ".join(words))
            digests.append(hashlib.sha256(left[-1]).hexdigest())
        return pa.RecordBatch.from_arrays([kept[0], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests), pa.array([x.decode("utf-8", "replace") for x in left])], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    joined = docs.join(repeats, ["doc_id", "row"], "left")
    out = map_texts(joined, rest, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string", ("doc_id", "at"))
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
