"""Iterative graph algorithms as joins: components, shortest paths, spanning trees.

Each loop works on whole edge tables; what a round leaves is a table in the shared folder, so that plans stay short and lost
executors can be replaced. Ties are broken by node id.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, Window, functions as F

from ..plans.tables import BROADCAST_ROWS, discard, materialise, numbered, shared_folder
from .components import connected_components
from .graphs import undirected

#: Rounds after which what has been found is written as one table.
COMPACT = 16
#: What sums of equal costs in another order may differ by, and more.
SLACK = 1e-9


def families(projection: DataFrame, min_similarity: float = 0.75) -> DataFrame:
    """family_id, supplier_id, family_size: components of the pairs that are similar enough, largest first."""
    found = connected_components(projection.where(F.col("similarity") >= min_similarity))
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("family_size"))
    ranked = numbered(sizes, "r", F.desc("family_size"), "component")
    return found.join(ranked, "component").select(F.format_string("F%03d", "r").alias("family_id"), F.col("node").alias("supplier_id"), "family_size")


def component_summary(nodes: DataFrame, edges: DataFrame, limit: int = 20, found: DataFrame | None = None, kind=None) -> DataFrame:
    """component (C001 is the largest), size, composition (TYPE:n) and sample (labels of the four smallest nodes) of the largest components.

    ``found`` are the components, where they are known; ``kind`` makes the type of a column of nodes, where that can be told from the node, so that not all nodes are looked up.
    """
    found = materialise(connected_components(edges)) if found is None else found
    kinds = found.withColumn("node_type", kind("node")) if kind else found.join(nodes.select(F.col("node_id").alias("node"), "node_type"), "node", "left")
    typed = kinds.groupBy("component", F.coalesce("node_type", F.lit("OTHER")).alias("node_type")).agg(F.count(F.lit(1)).alias("n"))
    top = typed.groupBy("component").agg(F.sum("n").alias("size"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "node_type", "n"))), ", ").alias("composition")).orderBy(F.desc("size"), "component").limit(limit)
    top = materialise(top.withColumn("r", F.row_number().over(Window.orderBy(F.desc("size"), "component"))))  # ``limit`` rows
    # the four smallest of every task first, then of the component: no task sorts a component
    four = lambda c: F.slice(F.array_sort(c), 1, 4)
    some = found.join(F.broadcast(top.select("component")), "component", "left_semi").select("component", F.pmod(F.xxhash64("node"), F.lit(64)).alias("part"), "node")
    least = some.groupBy("component", "part").agg(four(F.collect_list("node")).alias("x")).groupBy("component").agg(four(F.flatten(F.collect_list("x"))).alias("x"))
    least = materialise(least.select("component", F.explode("x").alias("node")))  # four times ``limit`` rows
    names = nodes.where(F.col("node_id").isin([r["node"] for r in least.select("node").collect()])).select(F.col("node_id").alias("node"), "label")
    named = least.join(names, "node", "left").groupBy("component").agg(F.array_sort(F.collect_list(F.struct("node", F.coalesce("label", "node").alias("label")))).alias("x"))
    sample = F.concat(F.array_join(F.transform("x", lambda x: x["label"]), ", "), F.when(F.col("size") > 4, "…").otherwise(""))
    return top.join(named, "component").select(F.format_string("C%03d", "r").alias("component"), "size", "composition", sample.alias("sample"))


def _single(both: DataFrame, node, **columns) -> DataFrame:
    kind = both.schema["source"].dataType
    out = both.sparkSession.createDataFrame([(node,)], "node string").select(F.col("node").cast(kind).alias("node"), *(F.lit(v).cast(t or kind).alias(k) for k, (v, t) in columns.items()))
    out._rows = 1
    return out


def adjacency(edges: DataFrame, buckets: int | None = None) -> DataFrame:
    """Distinct (source, target) both ways as a table in the shared folder, bucketed and sorted by source: to be written once for many searches.

    A frontier is joined with it bucket by bucket, so the edges are never shuffled again. hop_distances() and shortest_path() take it in place of edges.
    """
    spark = edges.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"adjacency_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/{name}"
    undirected(edges).repartition(buckets, "source").write.bucketBy(buckets, "source").sortBy("source").option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out._both = True
    return out


def _counted(front: DataFrame) -> int:
    """Rows of a frontier, BROADCAST_ROWS + 1 if they are more; counted once."""
    if not hasattr(front, "_rows"):
        front._rows = front.limit(BROADCAST_ROWS + 1).count()
    return front._rows


def neighbours(edges: DataFrame, front: DataFrame) -> DataFrame:
    """(node, parent) of every edge between a node and one of ``front`` (column node, a table), either way.

    Edges are read as they are, a frontier of few nodes being broadcast after it is counted; an adjacency() is joined by its buckets.
    """
    if getattr(edges, "_both", False):
        return edges.join(front.select(F.col("node").alias("source")), "source").select(F.col("target").alias("node"), F.col("source").alias("parent"))
    ids = front.select("node")
    if _counted(front) <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    ways = [edges.join(ids.withColumnRenamed("node", own), own).select(F.col(other).alias("node"), F.col(own).alias("parent")) for own, other in (("source", "target"), ("target", "source"))]
    return ways[0].union(ways[1]).where("node <> parent")


def hop_distances(edges: DataFrame, start, max_hops: int | None = None, goal=None) -> DataFrame:
    """node, hops, parent of every node reached from ``start``, breadth first, until nothing new is reached (or ``max_hops``, or ``goal``).

    ``edges`` is read once for each hop: give a table, or an adjacency(). Only the frontier is joined; since edges go both ways, a new node's neighbours are in the last two frontiers or new, so only those are
    taken out by an anti join.
    """
    frontiers = [_single(edges, start, hops=(0, "int"), parent=(None, None))]
    hop = 0
    while max_hops is None or hop < max_hops:
        hop += 1
        reached = neighbours(edges, frontiers[-1]).groupBy("node").agg(F.min("parent").alias("parent"))
        for old in frontiers[-2:]:
            reached = reached.join(old.select("node"), "node", "left_anti")
        new = materialise(reached.select("node", F.lit(hop).alias("hops"), "parent"))
        if not _counted(new):
            break
        frontiers.append(new)
        if goal is not None and new.where(F.col("node") == goal).head(1):
            break
        if len(frontiers) > COMPACT:
            frontiers = [materialise(_union(frontiers[:-2])), *frontiers[-2:]]
    return _union(frontiers)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def shortest_path(edges: DataFrame, start, goal) -> list:
    """Nodes of the path with fewest edges, the first in order of nodes of equal ones; empty if there is none.

    Grown from both ends, the smaller frontier first, until the two meet or one has no more; then read off level by level, so the driver
    sees a node of the path at a time. ``edges`` is read once for each level: give a table, or an adjacency().
    """
    if start == goal:
        return [start]
    levels = {end: [_single(edges, end)] for end in (start, goal)}
    sizes = {start: 1, goal: 1}
    near = lambda rows: neighbours(edges, rows).select("node").distinct()
    while True:
        end, other = (start, goal) if sizes[start] <= sizes[goal] else (goal, start)
        grown = near(levels[end][-1])
        for old in levels[end][-2:]:
            grown = grown.join(old, "node", "left_anti")
        levels[end].append(materialise(grown))
        sizes[end] = _counted(levels[end][-1])
        if not sizes[end]:
            return []
        met = materialise(levels[end][-1].join(levels[other][-1], "node", "left_semi"))
        if met.head(1):
            break
    # on the start's side only nodes that lead to the meeting level; on the goal's side every way down leads to the goal
    alive = [met] if len(levels[start]) > 1 else []
    for level in reversed(levels[start][1:-1]):
        alive.append(materialise(level.join(near(alive[-1]), "node", "left_semi")))
    path = [start]
    for level in [*reversed(alive), *reversed(levels[goal][:-1])]:
        path.append(level.join(near(_single(edges, path[-1])), "node", "left_semi").agg(F.min("node")).first()[0])
    return path


def cheapest_paths(edges: DataFrame, start, weight: str = "weight") -> DataFrame:
    """node, cost, parent, total_weight of the paths that prefer heavy edges: an edge costs 1 / (weight + 1).

    Parallel edges count as their heaviest. Costs are lowered by joins with the nodes that changed in the last round, until
    none does. What changed is kept beside the table of costs and folded into it now and then.
    """
    w = F.greatest(F.coalesce(F.col(weight), F.lit(0.0)), F.lit(0.0))
    one = edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), w.alias("w")).groupBy("a", "b").agg(F.max("w").alias("w"))
    both = materialise(one.select(F.col("a").alias("source"), F.col("b").alias("target"), (1 / (F.col("w") + 1)).alias("cost"), "w").union(one.select("b", "a", 1 / (F.col("w") + 1), "w")))
    changes = [_single(both, start, cost=(0.0, "double"), parent=(None, None), total_weight=(0.0, "double"))]
    best = lambda: _union(changes).groupBy("node").agg(F.min(F.struct("cost", "parent", "total_weight")).alias("o")).select("node", "o.*")
    while True:
        offers = both.join(changes[-1].select(F.col("node").alias("source"), F.col("cost").alias("before"), "total_weight"), "source").groupBy(F.col("target").alias("node")).agg(F.min(F.struct((F.col("before") + F.col("cost")).alias("cost"), F.col("source").alias("parent"), (F.col("total_weight") + F.col("w")).alias("total_weight"))).alias("o"))
        joined = offers.join(best().select("node", F.col("cost").alias("known")), "node", "left").where(F.col("known").isNull() | (F.col("o.cost") < F.col("known") - 1e-12))
        changed = materialise(joined.select("node", "o.cost", "o.parent", "o.total_weight"))
        if not changed.head(1):
            return best()
        changes.append(changed)
        if len(changes) > COMPACT:
            old, changes = changes[:-1], [materialise(_union(changes[:-1]).groupBy("node").agg(F.min(F.struct("cost", "parent", "total_weight")).alias("o")).select("node", "o.*")), changes[-1]]
            discard(*old)


def _touching(edges: list[DataFrame], near: DataFrame, small: bool, both: bool = True) -> DataFrame:
    """The rows of ``near`` (column parent) with each neighbour (node) and the weight w between, along edges (source, target, w), either way or only from the source."""
    near = F.broadcast(near) if small else near
    ways = (("source", "target"), ("target", "source"))[: 2 if both else 1]
    return _union([e.select(F.col(own).alias("parent"), F.col(other).alias("node"), "w").join(near, "parent") for e in edges for own, other in ways])


def _offers(edges: list[DataFrame], front: DataFrame, both: bool) -> DataFrame:
    """node, cost, parent: the cheapest way to each neighbour of ``front`` (node, cost).

    Edges are read as they are, a frontier of few nodes being broadcast after it is counted; of parallel edges the heaviest is the cheapest.
    """
    rows = _touching(edges, front.select(F.col("node").alias("parent"), F.col("cost").alias("before")), _counted(front) <= BROADCAST_ROWS, both)
    return rows.groupBy("node").agg(F.min(F.struct((F.col("before") + 1 / (F.col("w") + 1)).alias("cost"), "parent")).alias("o")).select("node", "o.*")


class _Side:
    """Costs from one end, lowered round by round: what changed in each round, as tables."""

    def __init__(self, edges: list[DataFrame], end, both: bool = True) -> None:
        self.edges, self.both, self.rounds = edges, both, 0
        self.changes = [_single(edges[0], end, cost=(0.0, "double"), parent=(None, None))]
        self.front = self.changes[0]

    def costs(self) -> DataFrame:
        return _union(self.changes).groupBy("node").agg(F.min(F.struct("cost", "parent")).alias("o")).select("node", "o.*")

    def grow(self, keep) -> DataFrame:
        """One round from the frontier. ``keep`` takes the offers that may matter. The changed nodes are the new frontier."""
        offers = keep(_offers(self.edges, self.front, self.both)).join(self.costs().select("node", F.col("cost").alias("known")), "node", "left")
        self.front = materialise(offers.where(F.col("known").isNull() | (F.col("cost") < F.col("known") - 1e-12)).select("node", "cost", "parent"))
        self.rounds += 1
        if _counted(self.front):
            self.changes.append(self.front)
        if len(self.changes) > COMPACT:
            old, self.changes = self.changes[:-1], [materialise(_union(self.changes[:-1]).groupBy("node").agg(F.min(F.struct("cost", "parent")).alias("o")).select("node", "o.*")), self.changes[-1]]
            discard(*old)
        return self.front


def heaviest_connection(edges: DataFrame | list[DataFrame], start, goal, weight: str = "amount") -> tuple[list, float]:
    """(path, its weight, rounded to two places) between two nodes; ([], 0.0) if there is none.

    Costs are those of cheapest_paths(), but ``edges`` are neither written nor shuffled while frontiers are small; they are read once for each round, so give a table or columns of one. Of a list
    of tables each is searched by itself.
    Costs grow from both ends, the smaller frontier first. A node that both know bounds the cost; as no edge costs less than the heaviest one, paths of more edges than rounds were made cost more
    than the bound at some time. Then the edges that can lie on a way within the bound are written, costs are lowered from the start along these, and the path is read off from the goal: of parents
    that fit a node's cost the first in order of nodes.
    """
    if start is None or goal is None or start == goal:
        return ([start] if start is not None and start == goal else []), 0.0
    w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = [e.select("source", "target", w.alias("w")) for e in (edges if isinstance(edges, list) else [edges])]
    heaviest = _union([e.select("w") for e in rows]).agg(F.max("w")).first()[0]
    if heaviest is None:
        return [], 0.0
    least, bound = 1 / (heaviest + 1), math.inf
    ahead, back = _Side(rows, start), _Side(rows, goal)
    within = lambda: bound + SLACK * max(1.0, bound)
    while (ahead.rounds + back.rounds + 1) * least <= within():
        side, other, end = (ahead, back, goal) if _counted(ahead.front) <= _counted(back.front) else (back, ahead, start)
        front = side.grow(lambda offers: offers.where(F.col("cost") + F.when(F.col("node") == end, 0.0).otherwise(least) <= within()))
        if not _counted(front):  # all that this end can reach within the bound is known
            break
        met = front.join(other.costs().select("node", F.col("cost").alias("rest")), "node").agg(F.min(F.col("cost") + F.col("rest"))).first()[0]
        bound = bound if met is None else min(bound, met)
    if bound == math.inf:
        return [], 0.0
    # costs known from both ends are least ones; a node that an end's rounds haven't reached is further than these
    (far_ahead, to), (far_back, fro) = (((side.rounds + 1) * least, materialise(side.costs().select("node", F.col("cost").alias(name)))) for side, name in ((ahead, "g"), (back, "h")))
    known = to.join(fro, "node", "full_outer").select("node", F.least(F.coalesce("g", F.lit(far_ahead)), F.lit(far_ahead)).alias("g"), F.least(F.coalesce("h", F.lit(far_back)), F.lit(far_back)).alias("h"))
    known = materialise(known.where(F.col("g") + F.col("h") <= within()))
    small = _counted(known) <= BROADCAST_ROWS
    end = known.select("node", "h")
    between = _touching(rows, known.select(F.col("node").alias("parent"), "g"), small).join(F.broadcast(end) if small else end, "node")
    between = between.where((F.col("node") != F.col("parent")) & (F.col("g") + 1 / (F.col("w") + 1) + F.col("h") <= within()))
    links = materialise(between.groupBy(F.col("parent").alias("source"), F.col("node").alias("target")).agg(F.max("w").alias("w")))  # the way towards the goal
    forth = _Side([links], start, both=False)
    while _counted(forth.front):
        forth.grow(lambda offers: offers)
    near = materialise(forth.costs())
    costs = [near.select(F.col("node").alias(n), F.col("cost").alias(c)) for n, c in (("source", "x"), ("target", "y"))]
    links = links.join(costs[0], "source").join(costs[1], "target").select(F.col("source").alias("before"), F.col("target").alias("node"), "w", "x", "y")
    fits = (F.abs(F.col("x") + 1 / (F.col("w") + 1) - F.col("y")) < 1e-13) & (F.col("x") < F.col("y"))
    parents = links.join(near.select("node", F.col("parent").alias("before"), F.lit(True).alias("kept")), ["node", "before"], "left").where(fits | F.col("kept"))
    parents = materialise(parents.select("node", "before", "w", fits.alias("fits")))
    path, total = [goal], 0.0
    while path[-1] != start:  # a parent at a time: as many lookups as the path has nodes
        row = parents.where(F.col("node") == path[-1]).orderBy(F.desc("fits"), "before").select("before", "w").head()
        path.append(row["before"])
        total += row["w"]
    return path[::-1], round(total, 2)


def path_rows(nodes: DataFrame, path: list) -> DataFrame:
    """step (from 1), node, label of a path."""
    steps = nodes.sparkSession.createDataFrame([(i, n) for i, n in enumerate(path, 1)], "step int, node string")
    return F.broadcast(steps).join(nodes.select(F.col("node_id").alias("node"), "label"), "node", "left").select("step", "node", F.coalesce("label", F.lit("")).alias("label"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The edges (source, target, weight) of the minimum spanning forest.

    Borůvka: each component takes its lightest outgoing edge, components are merged, and again; edges are ordered by (weight,
    source, target), which makes the forest the one that Kruskal's algorithm accepts. Rounds are logarithmic in the nodes.
    """
    key = F.struct("weight", "source", "target")
    left = materialise(edges.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "weight").where("source <> target").groupBy("source", "target").agg(F.min("weight").alias("weight")).select("source", "target", "weight", F.col("source").alias("a"), F.col("target").alias("b")))
    forest = left.limit(0).select("source", "target", "weight")
    for _ in range(64):
        if not left.head(1):
            break
        out = left.select(F.col("a").alias("c"), key.alias("k")).union(left.select("b", key)).groupBy("c").agg(F.min("k").alias("k"))
        chosen = materialise(out.select("k.source", "k.target", "k.weight").distinct())
        forest = materialise(forest.union(chosen.select("source", "target", "weight")))
        names = left.join(chosen.select("source", "target"), ["source", "target"], "left_semi").select("a", "b")
        merged = materialise(connected_components(names, "a", "b"))
        for end in ("a", "b"):
            left = left.join(merged.select(F.col("node").alias(end), F.col("component").alias("n")), end, "left").withColumn(end, F.coalesce("n", end)).drop("n")
        left = materialise(left.where("a <> b").select("source", "target", "weight", "a", "b"))
    return forest


def kruskal_view(edges: DataFrame, limit: int | None = 60) -> tuple[DataFrame, dict]:
    """(edges in the order Kruskal considers them with ``step`` and ``accepted``, metrics); all of them without ``limit``."""
    forest = materialise(spanning_forest(edges))
    pairs = edges.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "weight").where("source <> target").groupBy("source", "target").agg(F.min("weight").alias("weight"))
    seen = pairs.join(forest.select("source", "target", F.lit(True).alias("accepted")), ["source", "target"], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    m = seen.agg(F.count(F.lit(1)).alias("n"), F.count_if("accepted").alias("tree"), F.sum(F.when(F.col("accepted"), F.col("weight"))).alias("w")).first()
    nodes = undirected(edges).select("source").distinct().count()
    metrics = {"nodes": nodes, "tree_edges": m["tree"], "rejected": m["n"] - m["tree"], "total_weight": m["w"] or 0.0, "components": nodes - m["tree"]}
    order = ("weight", "source", "target")
    if limit is None:
        return numbered(seen, "step", *order), metrics
    first = seen.orderBy(*order).limit(limit)
    return first.withColumn("step", F.row_number().over(Window.orderBy(*order)).cast("long")), metrics  # ``limit`` rows


def spanning_display(considered: DataFrame, limit: int = 60) -> DataFrame:
    """At most ``limit`` edges to show of a forest: accepted ones, and a few that would close a cycle.

    ``considered`` has step, source, target, weight and accepted of all edges in Kruskal's order. Cycles are taken from the steps up to
    the last accepted edge, first those inside the accepted edges that are shown. step becomes the place in what is shown, considered_step the one before.
    """
    accepted, rejected = considered.where("accepted"), considered.where("not accepted")
    end = accepted.agg(F.max("step")).first()[0]
    cycles = rejected if end is None else rejected.where(F.col("step") <= end)
    budget = min(cycles.limit(limit).count(), max(4, min(12, limit // 3)))
    shown = materialise(accepted.orderBy("step").limit(max(0, limit - budget)))
    groups = connected_components(shown).select("node", "component")
    a, b = (groups.select(F.col("node").alias(x), F.col("component").alias(f"{x}_in")) for x in ("source", "target"))
    inside = cycles.join(F.broadcast(a), "source", "left").join(F.broadcast(b), "target", "left")  # twice ``limit`` rows at most
    picked = inside.orderBy(F.desc(F.coalesce(F.col("source_in") == F.col("target_in"), F.lit(False))), "step").limit(budget)
    columns = [c for c in considered.columns if c != "step"]
    both = shown.select("step", *columns).union(picked.select("step", *columns)).orderBy("step").limit(limit)
    return both.select(F.row_number().over(Window.orderBy("step")).alias("step"), F.col("step").alias("considered_step"), *columns)  # ``limit`` rows
