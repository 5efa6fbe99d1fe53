"""Periodic runs of words by a suffix automaton whose suffix links form a link-cut forest.

A run is a maximal stretch of words with smallest period q and a length of at least max(6, 4 * q). The words of a stretch are
appended to a suffix automaton one by one. Each append is an *access* of the new prefix's state in the link-cut forest of
suffix links: the path to the root takes the new end as its colour, and the path falls into segments by the colour that they had, which is where their
suffixes ended last. If the deepest state of a segment is as long as the distance of the two ends, the last words are a square of that
period; at three times the distance they are a run, whose begin is known from the state's length and whose end is found by comparing words.
Why that finds all: a suffix of 3 * q words of a run has period q, so if it had ended less than q ago, it would have the smaller period too; hence its last end is q ago, and
the segment that holds it says so. The automaton compares words themselves (by number), not hashes.

Only stretches that may hold a run are appended: within a run every window of five words has an equal one at most a quarter of the stretch away, so
windows without one end a stretch. That is a necessary condition and loses nothing; most texts have no such stretch.

``copied_stretch`` says where the rest of a text is replaced by repeats: a planted case whose place and period follow from the id.

Defined edge cases: null, empty and blank texts have no words, hence no run, and the digest of nothing; a null id is like any other, but its text is
never replaced by repeats; repeated rows give repeated results; very long texts are one chunk of their own, and take about 150 bytes for each word that lies in a stretch; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textbatch import Numbering, map_texts, rolling

WINDOW = 5
SCHEMA = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs array<struct<start:bigint,length:bigint,period:bigint>>, runs_sha256 string, collapsed_sha256 string, collapsed string"
)


def stretches(words: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """Begins and ends of the parts outside which no run can lie."""
    found, open_parts = [], [(0, len(words))]
    while open_parts:
        begin, end = open_parts.pop()
        n = end - begin
        if n < 6:
            continue
        keys = rolling(words[begin:end].astype(np.uint64) + np.uint64(1), window)
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        gap = np.diff(order)
        near = np.full(len(keys), n, np.int64)
        # order is stable, so equal windows stand by place: the nearest equal one is before or behind
        near[order[1:]] = np.where(same, gap, n)
        near[order[:-1]] = np.minimum(near[order[:-1]], np.where(same, gap, n))
        held = near * 4 <= n
        edges = np.flatnonzero(np.diff(np.concatenate(([0], held.astype(np.int8), [0]))))
        parts = [(begin + int(a), begin + int(b) + window - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]
        if parts == [(begin, end)]:
            found.append((begin, end))
        else:
            open_parts += parts
    return sorted(found)


class SuffixLinks:
    """A suffix automaton of whole numbers; its suffix links are a link-cut forest whose preferred paths have one colour each.

    State 1 is the root, state 0 none. The auxiliary trees are splay trees by depth; a tree's colour stands at its root.
    """

    def __init__(self):
        self.length, self.link = array("i", (0, 0)), array("i", (0, 0))
        self.symbol, self.target = array("i", (-1, -1)), array("i", (0, 0))  # a state's first transition
        self.more: dict[int, dict[int, int]] = {}  # and its others
        self.up, self.left, self.right = (array("i", (0, 0)) for _ in range(3))
        self.colour = array("i", (-1, -1))
        self.last, self.end = 1, -1

    def _state(self, length: int, link: int, colour: int) -> int:
        for column, value in ((self.length, length), (self.link, link), (self.symbol, -1), (self.target, 0), (self.up, link), (self.left, 0), (self.right, 0), (self.colour, colour)):
            column.append(value)
        return len(self.length) - 1

    def _next(self, state: int, word: int) -> int:
        if self.symbol[state] == word:
            return self.target[state]
        more = self.more.get(state)
        return more.get(word, 0) if more else 0

    def _set(self, state: int, word: int, target: int) -> None:
        if self.symbol[state] in (-1, word):
            self.symbol[state], self.target[state] = word, target
        else:
            self.more.setdefault(state, {})[word] = target

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        y = up[x]
        z = up[y]
        if left[z] == y:
            left[z] = x
        elif right[z] == y:
            right[z] = x
        if left[y] == x:
            b = left[y] = right[x]
            right[x] = y
        else:
            b = right[y] = left[x]
            left[x] = y
        if b:
            up[b] = y
        up[y], up[x] = x, z

    def _splay(self, x: int) -> None:
        """x becomes the root of its auxiliary tree and takes over the tree's colour."""
        up, left, right = self.up, self.left, self.right
        y = up[x]
        if not y or (left[y] != x and right[y] != x):
            return
        top = y
        while (z := up[top]) and (left[z] == top or right[z] == top):
            top = z
        self.colour[x] = self.colour[top]
        while (y := up[x]) and (left[y] == x or right[y] == x):
            z = up[y]
            if z and (left[z] == y or right[z] == y):
                self._rotate(y if (left[y] == x) == (left[z] == y) else x)
            self._rotate(x)

    def _extend(self, word: int) -> int:
        self.end += 1
        length, link = self.length, self.link
        p, new = self.last, self._state(length[self.last] + 1, 1, -1)
        while p and not self._next(p, word):
            self._set(p, word, new)
            p = link[p]
        if p:
            q = self._next(p, word)
            if length[q] > length[p] + 1:
                q = self._clone(p, q, word)
            link[new] = self.up[new] = q
        self.last = new
        return new

    def _clone(self, p: int, q: int, word: int) -> int:
        """A state for q's suffixes of at most length[p] + 1 words: just above q in q's path, hence with q's colour."""
        self._splay(q)
        copy = self._state(self.length[p] + 1, self.link[q], -1)
        self.symbol[copy], self.target[copy] = self.symbol[q], self.target[q]
        if q in self.more:
            self.more[copy] = dict(self.more[q])
        above = self.left[copy] = self.left[q]
        if above:
            self.up[above] = copy
        self.left[q], self.up[copy] = copy, q
        self.link[q] = copy
        while p and self._next(p, word) == q:
            self._set(p, word, copy)
            p = self.link[p]
        return copy

    def append(self, word: int) -> Iterator[tuple[int, int]]:
        """(last end before this one, length of the longest suffix that ended there) for each segment of the path, longest first.

        The segments must be read to the end before the next append.
        """
        x, below = self._extend(word), 0
        left, right, up, colour = self.left, self.right, self.up, self.colour
        while x:
            self._splay(x)
            deeper = right[x]
            if deeper:
                colour[deeper] = colour[x]
            if colour[x] >= 0:
                yield colour[x], self.length[x]
            right[x] = below
            colour[x] = self.end
            below, x = x, up[x]


def runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    found = []
    for begin, end in stretches(words):
        part = words[begin:end].tolist()
        links, reached = SuffixLinks(), {}  # reached: where the last run of a period ends
        for i, word in enumerate(part):
            for j, length in links.append(word):
                q = i - j
                if length < 3 * q or reached.get(q, -1) >= i:
                    continue
                stop = i + 1
                while stop < len(part) and part[stop] == part[stop - q]:
                    stop += 1
                reached[q] = stop - 1
                start = i - length - q + 1
                if stop - start >= 6:
                    found.append((begin + start, stop - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words no run holds behind its first period."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:n]) == 0


def copied_stretch(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p): the words from a on are to be those of p words from a on, again and again."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _unchanged(doc_id, n):
    return None


def periodic_runs(docs: DataFrame, text: str = "text", copied: Callable[[int | None, int], tuple[int, int] | None] = _unchanged) -> DataFrame:
    """The runs of each document, its most periodic one, and its words without repeats (``collapsed``), with their digests.

    ``copied`` names for an id and a number of words where a text is to be replaced by repeats before it is looked at.
    """
    struct = pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])
    longs = ("doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli")

    def per_chunk(kept: list[pa.Array], texts: list[bytes]) -> pa.RecordBatch:
        out: list[tuple] = []
        for doc_id, raw in zip(kept[0].to_pylist(), texts, strict=True):
            words = raw.split()
            n = len(words)
            if plan := copied(doc_id, n):
                a, p = plan
                words[a:] = (words[a : a + p] * (-(-(n - a) // p)))[: n - a]
            numbers = Numbering()
            found = runs(np.fromiter(map(numbers.__getitem__, words), np.int64, n)) if n >= 6 else []
            kept_text = b" ".join(words)
            best = (None,) * 4
            if found:
                start, length, period = min(found, key=lambda r: (_Exponent(r[1], r[2]), r[0], r[2]))
                best = (start, length, period, 1000 * length // period)
                kept_text = b" ".join(w for w, k in zip(words, kept_words(n, found).tolist(), strict=True) if k)
            listed = "".join(f"{s},{l},{q}\n" for s, l, q in found)
            out.append((doc_id, n, len(found), *best, [dict(zip(("start", "length", "period"), r, strict=True)) for r in found], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept_text).hexdigest(), kept_text.decode()))
        columns = list(zip(*out, strict=True))
        kinds = [pa.int64()] * 7 + [pa.list_(struct), pa.string(), pa.string(), pa.string()]
        names = [*longs, "runs", "runs_sha256", "collapsed_sha256", "collapsed"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return map_texts(docs.withColumn("doc_id", docs["doc_id"].cast("long")), per_chunk, SCHEMA, text=text)


class _Exponent:
    """length / period, greatest first, compared exactly."""

    def __init__(self, length: int, period: int):
        self.length, self.period = length, period

    def __lt__(self, other: _Exponent) -> bool:
        return self.length * other.period > other.length * self.period

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Exponent) and self.length * other.period == other.length * self.period
