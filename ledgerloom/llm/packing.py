"""Best-fit packing of documents into sequences by linear grouping.

Sizes are whole tokens up to the capacity, so all planning works on the histogram of piece lengths (at most
``capacity`` entries at any corpus size); documents never leave the executors.

1. Tokens. A text's ids are those of its words, as the tokenizer cuts at white space; the ids of distinct words
   are kept. Texts over the capacity are cut in pieces.
2. Linear grouping. Lengths over ``capacity / SMALL`` are large. Sorted by length they are cut into GROUPS groups
   of equal cardinality, and each length is rounded up to the largest of its group.
3. Configurations. Few sizes make few ways to fill a sequence; column generation over them solves the fractional
   problem, its multiplicities are rounded down.
4. Substitution. The slots of a configuration take the group's actual lengths, longest first, so what
   rounding wasted becomes room again.
5. Best fit. All other pieces, longest first, go to the fullest open sequence that has room. Sequences that are then still
   1/64 empty give up their pieces, which are fitted once more.
6. Documents. The task that cuts a piece numbers it among its own pieces of that length; behind those of the tasks before it, that is
   the piece's rank, and rank r of a length takes the r-th place that the plan has for it. Nothing is sorted, however many pieces have one length.

Defined edge cases: a null or empty text is the end id alone; repeated rows are packed each; other columns
are ignored; no documents give no rows.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.tables import BROADCAST_ROWS, materialise
from .textbatch import Numbering, flat, map_texts

CAPACITY, END_ID, GROUPS, SMALL = 4096, 1, 20, 8
#: Words whose ids a worker keeps from chunk to chunk (some 200 bytes each), beside those of the chunk at hand.
KEPT_WORDS = 120_000
_TOKENIZERS: dict = {}
#: A mark behind a letter that ends a word: a piece of its own to the tokenizer.
_MARK = re.compile(rb"[!-&(-/:-@\[-`{-~](?<=[a-z].)(?!\S)", re.DOTALL)
#: Words of the small letters of ASCII and Latin-1.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39)


class _WordIds(dict):
    """word -> its ids as little-endian unsigned 32-bit bytes.

    Words of letters and runs of punctuation are single pieces to the tokenizer, so thousands of new ones are
    encoded as one text and told apart where a piece ends; all other words are encoded one by one. A mark that ends a word is a word of its own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        # one thread: each further one would keep memory of its own beside the other worker's
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        # the same model for words of small letters, which no normalisation changes and which are one piece each
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encoded_pieces(self, new: list[bytes], tokenizer) -> dict[bytes, bytes]:
        pieces: dict[bytes, bytes] = {}
        for at in range(0, len(new), 2000):
            some = new[at : at + 2000]
            ids = np.asarray(tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            last = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(last) != len(some):
                pieces.update((x, self.whole(x.decode())) for x in some)
                continue
            raw, ends = ids.tobytes(), last.tolist()
            pieces.update(zip(some, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
        return pieces

    def learn(self, words: Iterable[bytes]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > KEPT_WORDS:
            used = {w: self[w] for w in words if w in self}
            self.clear()
            self.update(used)
        letters, others = [], []
        for word in new:
            (letters if _LETTERS(word) else others).append(word)
        self.update(self._encoded_pieces(letters, self.plain))
        split, rest = [], []
        for word in others:
            core = word.rstrip(_PUNCTUATION)
            if core.isalpha() or not core or core.decode("utf-8", "replace").lower().isalpha() and b"\xef\xbf\xbd" not in core:
                split.append((word, core, word[len(core) :]))
            else:
                rest.append(word)
        pieces = self._encoded_pieces(list({x for _, core, tail in split for x in (core, tail) if x and x not in self}), self.tokenizer)
        pieces[b""] = b""
        for word, core, tail in split:
            self[word] = b"".join(pieces[x] if x in pieces else self[x] for x in (core, tail))
        for at in range(0, len(rest), 2000):
            some = rest[at : at + 2000]
            for word, e in zip(some, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False), strict=True):
                self[word] = np.asarray(e.ids, "<u4").tobytes()

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text. Text that may hold a special token's string goes to the tokenizer as a whole."""
        own = [b"<|" not in t for t in texts]
        number = Numbering()
        at, offsets = flat((_MARK.sub(rb" \g<0>", t.lower()).split() if o else () for t, o in zip(texts, own, strict=True)), number, np.int32)
        self.learn(number)
        get = [self[w] for w in number].__getitem__
        return [b"".join(map(get, at[a:b].tolist())) if o else self.whole(t.decode("utf-8", "replace")) for t, o, a, b in zip(texts, own, offsets[:-1], offsets[1:], strict=True)]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, with the task that cut it and its number among the task's pieces of that length."""
    seen: dict[int, int] = defaultdict(int)  # a task has a copy of its own

    def cut(kept, texts):
        context = TaskContext.get()
        task = context.partitionId() if context else 0
        if tokenizer not in _TOKENIZERS:
            _TOKENIZERS[tokenizer] = _WordIds(tokenizer)
        end = np.asarray([end_id], "<u4").tobytes()
        rows = []
        for doc, ids in zip(kept[0].to_pylist(), _TOKENIZERS[tokenizer].ids(texts), strict=True):
            ids += end
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), task, seen[len(part) // 4]))
                seen[len(part) // 4] += 1
        columns = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), cut, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long")


def _fractional(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Configurations (columns) and multiplicities of the fractional problem, by column generation."""
    k = len(sizes)
    basis = np.diag(np.maximum(capacity // sizes, 1)).astype(float)
    for _ in range(60 * k):
        amount = np.linalg.solve(basis, demand)
        price = np.linalg.solve(basis.T, np.ones(k))
        # unbounded knapsack over the sizes for the best new column
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(int(sizes.min()), capacity + 1):
            fits = sizes <= room
            value = np.where(fits, best[np.maximum(room - sizes, 0)] + price, -1)
            j = int(np.argmax(value))
            if value[j] > best[room - 1] + 1e-12:
                best[room], last[room] = value[j], j
            else:
                best[room], last[room] = best[room - 1], -1
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        while room > 0:
            if last[room] < 0:
                room -= 1
            else:
                column[last[room]] += 1
                room -= int(sizes[last[room]])
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    return basis, np.linalg.solve(basis, demand)


def _grouped(lengths: list[int], counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Groups of equal cardinality of the longest-first list, each as (length, how many) runs."""
    total = sum(counts[n] for n in lengths)
    size = max(1, -(-total // groups))
    out: list[list[tuple[int, int]]] = [[]]
    room = size
    for n in lengths:
        left = counts[n]
        while left:
            take = min(left, room)
            out[-1].append((n, take))
            left, room = left - take, room - take
            if not room:
                out.append([])
                room = size
    return [g for g in out if g]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one sequence, how many such sequences): a packing of the whole histogram."""
    left = dict(histogram)
    done: list[tuple[tuple[int, ...], int]] = []
    open_bins: dict[int, list[list]] = defaultdict(list)  # room -> [lengths, how many]
    if left.get(capacity):
        done.append(((capacity,), left.pop(capacity)))
    large = sorted((n for n in left if n > capacity // small and left[n]), reverse=True)
    if large:
        runs = _grouped(large, left, groups)
        merged: dict[int, list[tuple[int, int]]] = {}
        for g in runs:  # groups that round to one size are one
            merged.setdefault(g[0][0], []).extend(g)
        sizes = np.array(list(merged), np.int64)
        demand = np.array([sum(c for _, c in merged[n]) for n in merged], float)
        basis, amount = _fractional(sizes, demand, capacity)
        queues = [[list(r) for r in merged[n]] for n in merged]
        for column, times in zip(basis.T, np.floor(amount + 1e-6), strict=True):
            slots = [g for g in range(len(sizes)) for _ in range(int(round(column[g])))]
            times = int(times)
            while times > 0:
                # the longest run of sequences over which no slot's actual length changes
                chosen, batch = [], times
                need: dict[int, int] = defaultdict(int)
                for g in slots:
                    need[g] += 1
                for g, n in need.items():
                    if sum(r[1] for r in queues[g][:2]) == 0:
                        batch = 0
                        break
                    if queues[g][0][1] >= n:
                        batch = min(batch, queues[g][0][1] // n)
                    else:
                        batch = 1
                if not batch:
                    break
                for g in need:
                    for _ in range(need[g]):
                        if not queues[g]:
                            break
                        chosen.append(queues[g][0][0])
                        queues[g][0][1] -= batch
                        if queues[g][0][1] <= 0:
                            queues[g].pop(0)
                for n in chosen:
                    left[n] -= batch
                open_bins[capacity - sum(chosen)].append([chosen, batch])
                times -= batch
    _best_fit(left, open_bins, capacity)
    # sequences that rounding left uneven: their pieces once more, if that takes fewer
    loose = [(room, b) for room, bins in open_bins.items() if room > capacity // 64 for b in bins]
    again: dict[int, int] = defaultdict(int)
    for _, (chosen, many) in loose:
        for n in chosen:
            again[n] += many
    repacked: dict[int, list[list]] = defaultdict(list)
    _best_fit(again, repacked, capacity)
    if sum(many for bins in repacked.values() for _, many in bins) < sum(many for _, (_, many) in loose):
        tight = [b for room, bins in open_bins.items() if room <= capacity // 64 for b in bins]
    else:
        tight, repacked = [b for bins in open_bins.values() for b in bins], {}
    return done + [(tuple(c), many) for c, many in [*tight, *(b for bins in repacked.values() for b in bins)] if c]


def _best_fit(left: dict[int, int], open_bins: dict[int, list[list]], capacity: int) -> None:
    """Put all pieces of ``left``, longest first, into the fullest open sequences that have room; equal ones at once."""
    rooms = sorted(room for room, bins in open_bins.items() if bins)
    for n in sorted((n for n in left if left[n]), reverse=True):
        while left[n]:
            at = bisect.bisect_left(rooms, n)
            if at < len(rooms):
                room = rooms[at]
                chosen, many = open_bins[room].pop()
                each = min(room // n, max(1, left[n] // many))
                used = min(many, left[n] // each)
                if used < many:
                    open_bins[room].append([chosen, many - used])
                if not open_bins[room]:
                    rooms.pop(at)
            else:
                room, chosen = capacity, []
                each = min(capacity // n, left[n])
                used = left[n] // each
            left[n] -= each * used
            if not open_bins[room - each * n]:
                bisect.insort(rooms, room - each * n)
            open_bins[room - each * n].append([[*chosen, *[n] * each], used])


def places(planned: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, ranks, first sequence, offset), by length and rank; rank r of a row lies in sequence
    ``first sequence + r - first rank``."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, many in planned:
        offset = 0
        for n in lengths:
            rows.append((n, used[n], many, sequence, offset))
            used[n] += many
            offset += n
        sequence += many
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row."""
    pieces = materialise(token_pieces(docs, tokenizer, capacity, end_id))
    each = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = materialise(each.select("length", "task", "n", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before")))
    histogram = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity at most
    table = places(plan(histogram, capacity))
    shared = docs.sparkSession.sparkContext.broadcast(table)  # as many rows as the plan has slots, below a few times capacity

    def place(batches):
        slots = shared.value
        key = slots[:, 0] << 44 | slots[:, 1]
        for b in batches:
            length, rank, earlier = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank", "before"))
            rank = rank + earlier
            s = slots[np.searchsorted(key, length << 44 | rank, "right") - 1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(s[:, 3] + rank - s[:, 1]), pa.array(s[:, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    offsets = before.select("length", "task", "before")
    if before.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)  # counted; beyond that both sides are shuffled
    return pieces.join(offsets, ["length", "task"]).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
