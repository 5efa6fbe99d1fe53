"""Manifest against a tree that is held whole."""

import hashlib
import string
import zlib

from pyspark.sql import functions as F

from ledgerloom.llm import manifest

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def _hash(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _hash("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def _paths(digests):
    ways, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for i, k in enumerate(at):
            begin = k - k % 16
            ways[i].append((level[begin:k], level[k + 1 : begin + 16]))
            at[i] = k // 16
        level = [_hash(level[k : k + 16]) for k in range(0, len(level), 16)]
    return level[0], ways


def _whole(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append(r)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    made = {s: sorted(trees[s], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r))) for s in names}
    ways = {s: _paths([_leaf(r) for r in made[s]]) for s in names}
    root, tops = _paths([ways[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        for r, way in zip(made[s], ways[s][1], strict=True):
            fold = _leaf((*r[:4], r[4].translate(_LOWER))) if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else _leaf(r)
            for left, right in way + top:
                fold = _hash([*left, fold, *right])
            out.append((r[0], _leaf(r), ways[s][0], root, _hash(x for left, right in way + top for x in [*left, *right]), fold, fold == root))
    return sorted(out, key=str)


def _rows():
    rows = [(i, "hot" if i % 3 else f"s{i % 40}", "en", i, f"Text {i} Of Words") for i in range(2500)]
    rows += [(5000 + i, f"lone{i}", None, None, "A") for i in range(30)]
    rows += [(7, None, "de", 0, None), (8, None, None, None, ""), (7, None, "de", 0, None), (8, None, None, None, "ß Ü A"), (None, "", "x", 1, "No id"), (9, "ÿ", "x", 1, "x" * 70_000)]
    return rows


def _manifest(docs):
    return manifest.build(manifest.leaves(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0))


def test_manifest_and_proofs(spark):
    rows = _rows()
    docs = spark.createDataFrame([(*r, "hash", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree int").repartition(7)
    made = _manifest(docs)
    want = _whole(rows)
    got = [tuple(r) for r in manifest.verified(manifest.proofs(made)).collect()]
    assert sorted(got, key=str) == want
    assert made.root() == want[0][3] and {x[-1] for x in want} == {True, False}
    # only every second level is stored, in blocks of at most 256
    assert max(r["n"] for t in made.stored for r in t.select(F.size("nodes").alias("n")).collect()) == 256
    assert len(made.stored) == 2 and made.stored[1].count() == sum(1 for s in {r[1] for r in rows} if sum(x[1] == s for x in rows) > 256)
    made.discard()


def test_small_tables(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    empty = _manifest(spark.createDataFrame([], schema))
    assert empty.root() is None and manifest.proofs(empty).collect() == []
    one = [(5, None, None, None, "ABC")]
    made = _manifest(spark.createDataFrame(one, schema))
    assert [tuple(r) for r in manifest.verified(manifest.proofs(made)).collect()] == _whole(one) and made.root() == _leaf(one[0])


def test_altered_leaf_is_found(spark):
    docs = spark.createDataFrame([(i, "s", "en", 1, f"Text {i}") for i in range(300)], "doc_id long, source string, lang string, n_chars long, text string")
    found = manifest.proofs(_manifest(docs)).withColumn("altered", F.when(F.col("doc_id") == 77, F.sha2(F.lit("x"), 256)))
    assert [r["doc_id"] for r in manifest.verified(found).where("not verified").collect()] == [77]
