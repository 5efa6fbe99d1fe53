"""Merkle manifest of a table: trees of arity 16 for each source, their roots under one root; checkpoint and recompute.

Only every second level of a tree is stored: a stored row is an aligned block of up to 256 digests of one level, under one node of the
next stored level. Proofs come from the top: each block regenerates the level between from its stored digests, gives every digest its siblings
of the two levels behind those that its parent came with, and discards what it regenerated. So a manifest takes a digest and its key for each leaf, and 1/256 of that for everything above, and a
proof of any leaf reads one block for each stored level.

    manifest = build(leaves(docs))
    proofs(manifest)                       # one row for each leaf, with the siblings on its way
    folded("altered", "path")              # the root that a digest leads to; equal to the manifest's root, or altered

Places in a tree come from a sort by ranges, with counts by partition carried on (a row for each partition and source), and blocks are at most 256 rows, so a
source with a third of all rows is divided like all others. The tree of the sources' roots is built the same way.

A leaf is the hash of its columns, each ``-`` if null and else its length in UTF-8 bytes, a colon and its value. Digests are lowercase
hex sha256, hashed as text.

Defined edge cases: rows are ordered by id (null first), then digest, so repeated rows have places of their own (and either order
gives the same tree); a null source is a source of its own, before all others; a lone leaf is its source's root, and a lone
source's root is the root; an empty table has no rows and the root ``None``; texts of any length are hashed whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.tables import discard, materialise

ARITY = 16
#: Levels from one stored level to the next.
STEP = 2
BLOCK = ARITY**STEP
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIDES = "array<struct<left:string,right:string>>"


def leaf_digest(**columns: Column) -> Column:
    """The digest of a row's columns, in the order of COLUMNS."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in (columns[c].cast("string") for c in COLUMNS)]), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def leaves(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """doc_id, source, leaf, and ``altered``: the digest after ``text`` is replaced by lower case, where that condition holds."""
    own = {c: F.col(c) for c in COLUMNS}
    leaf = leaf_digest(**own)
    second = F.when(altered, leaf_digest(**(own | {"text": lowered(F.col("text"))}))) if altered is not None else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf.alias("leaf"), second.alias("altered"))


def _placed(rows: DataFrame, tree: str, *order) -> DataFrame:
    """Materialised ``rows`` with ``place`` (0, 1, ... in their tree in the given order) and ``total`` (rows of the tree)."""
    at = materialise(rows.orderBy(F.col(tree), *order).withColumn("_at", F.monotonically_increasing_id()))
    part, index = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    # a tree's rows in a partition follow one another: one row for each partition, and one for each tree
    held = at.groupBy(part.alias("_part"), F.col(tree)).agg(F.min(index).alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(tree)
    before = F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    held = held.select("_part", tree, (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("total"))
    out = at.withColumn("_part", part).join(held, ["_part", tree]).withColumn("place", index + F.col("_shift")).drop("_at", "_part", "_shift")
    out._read = at
    return out


def _hash(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def _levels(digests: list[str], total: int, level: int) -> list[list[str]]:
    """The levels of a block from its stored one up to the next stored one, or to the tree's root; ``total``: nodes of the tree at the stored level."""
    out = [digests]
    for _ in range(STEP):
        if total == 1:
            break
        out.append([_hash(out[-1][k : k + ARITY]) for k in range(0, len(out[-1]), ARITY)])
        total = -(-total // ARITY)
    return out


def _sides(levels: list[list[str]], k: int) -> list[tuple[str, str]]:
    """Left and right siblings, joined, of node k's way through a block's levels."""
    out = []
    for nodes in levels[:-1]:
        begin = k - k % ARITY
        out.append(("".join(nodes[begin:k]), "".join(nodes[k + 1 : begin + ARITY])))
        k //= ARITY
    return out


@dataclass
class Manifest:
    """``stored``: blocks of each stored level from the leaves up (tree, block, total, digests and, of leaves, keys), as tables; ``above``: the
    manifest of the trees' roots (None for that one itself); ``tops``: (tree, root) of each tree."""

    stored: list[DataFrame]
    tops: DataFrame
    above: Manifest | None = None

    def root(self) -> str | None:
        row = (self.above or self).tops.select("root").first()
        return row["root"] if row else None

    def discard(self) -> None:
        discard(*self.stored, self.tops)
        if self.above:
            self.above.discard()


def _blocks(rows: DataFrame, *more: str) -> DataFrame:
    own = F.struct((F.col("place") % BLOCK).cast("int").alias("k"), "digest", *more)
    return rows.groupBy("tree", F.expr(f"place div {BLOCK}").alias("block")).agg(F.max("total").alias("total"), F.sort_array(F.collect_list(own)).alias("nodes"))


def _climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The node over each block: its tree, place, digest, and the nodes of the tree at that level."""
    for b in batches:
        rows = []
        for tree, block, total, nodes in zip(*(b.column(c).to_pylist() for c in ("tree", "block", "total", "nodes")), strict=True):
            levels = _levels([x["digest"] for x in nodes], total, 0)
            rows.append((tree, block, -(-total // BLOCK), levels[-1][0]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["tree", "place", "total", "digest"])


def _trees(rows: DataFrame, *more: str) -> Manifest:
    """rows: tree, place, total, digest, and more columns that the lowest blocks keep."""
    stored, tops = [], []
    while True:
        stored.append(materialise(_blocks(rows, *more)))
        more = ()
        over = stored[-1].select("tree", "block", "total", "nodes.digest").withColumn("nodes", F.expr("transform(digest, x -> struct(x as digest))")).drop("digest").mapInArrow(_climb, "tree string, place long, total long, digest string")
        over = materialise(over)
        tops.append(over)
        rows = over.where("total > 1")
        if not rows.limit(1).count():
            break
    ended = tops[0].where("total = 1")
    for t in tops[1:]:
        ended = ended.union(t.where("total = 1"))
    out = Manifest(stored, materialise(ended.select("tree", F.col("digest").alias("root"))))
    discard(*tops)
    return out


def build(rows: DataFrame) -> Manifest:
    """The manifest of the rows that leaves() gives."""
    # a tree's name is never null, so that it can be joined by; "" (the null source) comes first
    named = rows.withColumn("tree", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    placed = _placed(named, "tree", F.col("doc_id").asc_nulls_first(), "leaf")
    base = _trees(placed.withColumnRenamed("leaf", "digest"), "doc_id", "altered")
    discard(placed._read)
    tops = base.tops.select(F.lit("").alias("all"), "tree", "root")
    placed = _placed(tops, "all", "tree")
    base.above = _trees(placed.select(F.col("all").alias("tree"), "place", "total", F.col("root").alias("digest"), F.col("tree").alias("key")), "key")
    discard(placed._read)
    return base


_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _descend(*keys: str):
    """Rows for the digests of a block: the block's path behind the siblings of the levels that are regenerated here."""
    kinds = {"doc_id": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):  # the rows of 64 blocks in memory
                rows = []
                for r in whole.slice(at, 64).to_pylist():
                    nodes = r["nodes"]
                    levels = _levels([x["digest"] for x in nodes], r["total"], 0)
                    above = [(x["left"], x["right"]) for x in r["path"]]
                    for k, x in enumerate(nodes):
                        path = [dict(left=a, right=b) for a, b in _sides(levels, k) + above]
                        rows.append((r["tree"], r["block"] * BLOCK + k, r["top"], x["digest"], *(x[c] for c in keys), path))
                types = [pa.string(), pa.int64(), pa.string(), pa.string(), *(kinds.get(c, pa.string()) for c in keys), _PATH]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["tree", "place", "top", "digest", *keys, "path"])

    return run


def _extract(trees: Manifest, ways: DataFrame, *keys: str) -> DataFrame:
    """tree, place, top, digest, keys and path of every lowest digest; ways: (tree, top, path) of the trees' roots."""
    reached, made = None, []
    for k in reversed(range(len(trees.stored))):
        blocks = trees.stored[k]
        begins = blocks.where(f"total <= {BLOCK}").select("tree", "block").join(ways, "tree").select("tree", "block", "top", "path")
        here = begins if reached is None else begins.unionByName(reached.select("tree", F.col("place").alias("block"), "top", "path"))
        own = keys if k == 0 else ()
        schema = "tree string, place long, top string, digest string" + "".join(f", {c} {'long' if c == 'doc_id' else 'string'}" for c in own) + f", path {SIDES}"
        reached = blocks.join(here, ["tree", "block"]).mapInArrow(_descend(*own), schema)
        if k:
            reached = materialise(reached)
            made.append(reached)
    reached._made = made
    return reached


def proofs(manifest: Manifest) -> DataFrame:
    """(doc_id, tree, place, leaf, altered, subroot, root, path) of each leaf; path: joined siblings left and right of the way, level by level up to the root."""
    above = manifest.above
    start = above.tops.select("tree", F.col("root").alias("top"), F.expr(f"cast(array() as {SIDES})").alias("path"))
    tops = materialise(_extract(above, start, "key").select(F.col("key").alias("tree"), F.col("digest").alias("subroot"), F.col("top").alias("root"), "path"))
    ways = tops.select("tree", F.concat_ws(" ", "subroot", "root").alias("top"), "path")
    out = _extract(manifest, ways, "doc_id", "altered")
    both = F.split("top", " ")
    return out.select("doc_id", "tree", "place", F.col("digest").alias("leaf"), "altered", both[0].alias("subroot"), both[1].alias("root"), "path")


def folded(digest: str, path: str) -> Column:
    """The root to which a digest leads by its siblings."""
    return F.aggregate(F.col(path), F.col(digest), lambda d, x: F.sha2(F.concat(x["left"], d, x["right"]), 256))


def siblings(path: str) -> Column:
    """All siblings of a path, joined."""
    return F.array_join(F.transform(F.col(path), lambda x: F.concat(x["left"], x["right"])), "")


def verified(found: DataFrame) -> DataFrame:
    """Rows of proofs() as digests: the proof's own, the root that ``altered`` (else the leaf) leads to, and whether that is the root."""
    out = found.withColumn("_from", F.coalesce("altered", "leaf"))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings("path"), 256).alias("proof_sha256"), folded("_from", "path").alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
