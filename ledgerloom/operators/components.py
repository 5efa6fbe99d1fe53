"""Connected components by alternating star contractions (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from ..plans.tables import discard, materialise


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, and their number and hash, taken while they are written."""
    seen = Observation()
    table = materialise(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")))
    return table, (seen.get["n"], seen.get["x"])


def _folded(edges: DataFrame) -> tuple[DataFrame, DataFrame, int, list[DataFrame]]:
    """(edges, put aside, number of edges, their tables): the smaller neighbours of each node (u) are tied to the smallest one (v), and nodes that have no other edge then are put aside with it."""
    least = materialise(edges.groupBy("u").agg(F.min("v").alias("v")))
    tied, (n, _) = _written(edges.join(least.withColumnRenamed("v", "m"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
    ends = tied.select("u").union(least.select("v")).distinct().withColumn("live", F.lit(True))  # every smaller end: a smallest one or tied to it
    marked = materialise(least.join(ends, "u", "left"))
    discard(least)
    live = marked.where("live").select("u", "v")
    return tied.union(live), marked.where("live is null").select("u", "v"), n + live.count(), [tied, marked]


def connected_components(edges: DataFrame, src: str = "source", dst: str = "target", few: int = 1_000_000) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node of its set.

    More than ``few`` edges are folded first: the larger end of an edge is put aside with its smallest neighbour, to which the others are tied, so a graph of few centres and many leaves
    shrinks to its centres in a few rounds. That ends after two rounds that leave more than two thirds of the edges each.
    In each round of the rest all larger neighbours of a node are hooked to its smallest neighbour, then all smaller ones; the edge
    set becomes a star around each minimum after O(log^2 n) rounds. Only grouped minima and joins are used, and
    no round has more edges than the input, so a hub costs one partially aggregated row for each task. Tables of earlier rounds are deleted.
    Self loops and edges with a null end are ignored.
    """
    a, b = F.col(src), F.col(dst)
    now, state = _written(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    n, put_aside, tables, idle = state[0], [], [now], 0
    while n > few and idle < 2:
        now, aside, left, written = _folded(now)
        idle, n = idle + 1 if left > n * 2 / 3 else 0, left
        put_aside.append(aside)
        discard(tables[0])  # the edges before; nodes put aside are needed below
        tables = written
    found = _stars(now)
    for aside in reversed(put_aside):
        known = aside.join(found.select(F.col("node").alias("v"), "component"), "v", "left").select(F.col("u").alias("node"), F.coalesce("component", "v").alias("component"))
        centres = aside.select(F.col("v").alias("node")).distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
        found = materialise(found.union(known).union(centres))
    return found


def _stars(edges: DataFrame) -> DataFrame:
    now, state = _written(edges.distinct())
    before = None
    while state[0] and state != before:
        before, last = state, now
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialise(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now, state = _written(small.distinct())
        discard(last, large)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def merged_components(first: DataFrame, second: DataFrame) -> DataFrame:
    """(node, component) of two graphs taken together, from those of each: a node of both ties its two components."""
    both = materialise(first.withColumnRenamed("component", "a").join(second.withColumnRenamed("component", "b"), "node", "full_outer"))
    tied = materialise(connected_components(both.where("a <> b").select("a", "b").distinct(), "a", "b"))
    return both.select("node", F.coalesce("a", "b").alias("a")).join(tied.select(F.col("node").alias("a"), "component"), "a", "left").select("node", F.coalesce("component", "a").alias("component"))
