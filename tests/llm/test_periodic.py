"""Periodic runs against comparing all periods."""

import hashlib
import itertools
import random
import zlib

import numpy as np

from ledgerloom.llm import periodic


def _runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i + q - start
            if length >= max(6, 4 * q) and not any(all(w[k] == w[k + d] for k in range(start, start + length - d)) for d in range(1, q)):
                out.append((start, length, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def _result(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    if n and doc_id is not None and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = _runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    listed = "".join(f"{s},{x},{q}\n" for s, x, q in runs)
    return (doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_last_ends_by_suffix_links():
    """Every segment of an access: its suffixes' last end."""
    for w in [*itertools.product(range(2), repeat=7), *([random.Random(k).randrange(1 + k % 4) for _ in range(24)] for k in range(150))]:
        links = periodic.SuffixLinks()
        for i, c in enumerate(w):
            want = {}
            for k in range(1, i + 1):
                j = next((j for j in range(i - 1, k - 2, -1) if w[j - k + 1 : j + 1] == w[i - k + 1 : i + 1]), None)
                if j is not None:
                    want[j] = k
            assert {j: k for j, k in links.append(c) if k} == want


def test_runs():
    rng = random.Random(1)
    found = 0
    for _ in range(1500):
        n, k, w = rng.randint(0, 60), rng.choice([1, 2, 2, 3, 5]), []
        while len(w) < n:
            w += [rng.randrange(k) for _ in range(rng.randint(1, 6))] if rng.random() < 0.5 else [rng.randrange(k) for _ in range(rng.randint(1, 5))] * rng.randint(2, 7)
        want = _runs(w[:n])
        assert periodic.runs(np.array(w[:n], np.int64)) == want
        found += len(want)
    assert found > 500
    # periods longer than a window, a passage repeated far away, and one word throughout
    far = list(range(50)) + [99] * 3 + list(range(50))
    assert periodic.runs(np.array(far)) == [] and periodic.stretches(np.array(far)) == []
    assert periodic.runs(np.array(list(range(40)) * 5 + [77])) == [(0, 200, 40)] and periodic.runs(np.zeros(3000, np.int64)) == [(0, 3000, 1)]


def test_periodic_runs(spark, odd_docs, empty_docs):
    rng = random.Random(2)
    more = [(2000 + i, " ".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))) for i in range(150)] + [(3000, "x " * 5), (3001, "x " * 6), (3002, "a b c d A " * 40)]
    docs = odd_docs.select("doc_id", "text", "score").union(spark.createDataFrame([(i, t, 1.0) for i, t in more], "doc_id long, text string, score double"))
    got = periodic.periodic_runs(docs, copied=periodic.copied_stretch)
    want = sorted((_result(r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    assert sorted((tuple(r) for r in got.drop("n_words", "runs", "collapsed").collect()), key=str) == want
    assert sum(r[1] > 0 for r in want) > 20
    one = {r["doc_id"]: r for r in got.where("doc_id in (3001, 3002)").collect()}
    assert one[3002]["collapsed"] == "a b c d A" and one[3002]["runs"][0].asDict() == {"start": 0, "length": 200, "period": 5}
    assert periodic.periodic_runs(empty_docs).collect() == []
