import datetime
import itertools
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import activity, attributes, attributes as attr, components, graphs, normalization as norm, optimise, paths, recommend, search
from ledgerloom.operators.components import connected_components
from ledgerloom.plans.build import PipelineError, build_dataset, dataset_summary, graph_summary
from ledgerloom.plans.tables import materialise, numbered, running
from ledgerloom.sources.catalog import Catalog
from ledgerloom.sources.files import read_table


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("1.234,50", 1234.5), ("0,0847", 0.0847), (" 1 200 ", 1200.0), ("", 0.0), (None, 0.0), ("abc", 0.0), ("nan", 0.0), ("-3.5", -3.5), ("1_000", 0.0), ("1e3", 1000.0)])
def test_to_float(spark, raw, want):
    assert _one(spark, T.to_float(F.lit(raw).cast("string"))) == want


def test_text_functions(spark):
    assert _one(spark, T.normalize_text(F.lit("  Ñandú, 30ML c/tapa N° 5 "))) == "NANDU 30ML C TAPA N 5"
    assert _one(spark, T.normalize_text(F.lit(None).cast("string"))) == ""
    assert _one(spark, T.parse_date(F.lit("1/3/2025 10:00"))) == datetime.date(2025, 3, 1)
    assert _one(spark, T.parse_date(F.lit("31/02/2025"))) is None
    assert _one(spark, T.compound_document(F.lit("F"), F.lit(" - "), F.lit(None).cast("string"), F.lit("12"))) == "F-12"
    assert _one(spark, T.clean_description(F.lit("FRASCO AMBAR  FRASCO AMBAR"))) == "FRASCO AMBAR"
    assert _one(spark, T.stable_int(F.lit("Ñ"), F.lit("a"))) == 209 + 2 * 124 + 3 * 97
    assert _one(spark, T.singular(F.lit("FRASCOS"))) == "FRASCO" and _one(spark, T.singular(F.lit("COLORES"))) == "COLOR"
    assert _one(spark, T.format_g(F.lit(30.0))) == "30" and _one(spark, T.format_g(F.lit(1.5))) == "1.5"
    assert T.token_set_ratio("A B", "B A C") == 1.0 and T.token_set_ratio("", "A") == 0.0 and 0 < T.token_set_ratio("FRASCO", "FRASKO") < 1


def test_schema_detection():
    columns = ["CÓDIGO", "DESCRIPCIÓN", "CANTIDAD", "DENOMINACIÓN ENTIDAD", "DOC ENTIDAD NÚMERO", "NÚMERO", "TOTAL", "PRECIO UNITARIO"]
    found = norm.detect_schema(columns, "sales")
    assert found["entity"][0] == "DENOMINACIÓN ENTIDAD" and found["entity_id"][0] == "DOC ENTIDAD NÚMERO" and found["price"][0] == "PRECIO UNITARIO" and found["lat"][0] is None
    assert norm.detect_schema(["NÚMERO", "DOC ENTIDAD NÚMERO"], "sales", first_column_wins=True)["entity_id"][0] == "NÚMERO"


def test_attributes(spark):
    names = ["FRASCO GOTERO VIDRIO AMBAR 30ML C/TAPA B18", "POTE NO ESTERIL 1KG TAPA CHUPON", "COSA", None]
    rows = {r["product_id"]: r for r in attr.extract_attributes(spark.createDataFrame(list(enumerate(names)), "product_id int, product_name string")).collect()}
    a, b, c, d = (rows[i] for i in range(4))
    assert (a["product_type"], a["subtype"], a["material"], a["color"], a["capacity_value"], a["capacity_unit"], a["mouth_size_mm"]) == ("frasco", "gotero", "VIDRIO", "AMBAR", 30.0, "ML", 18.0)
    assert b["accessory"] == "chupon|tapa" and b["feature"] == "no_esteril" and b["capacity_unit"] == "KG" and a["use_category"] == "empaque_envase"
    assert c["use_category"] == "general" and c["confidence"] == 0.6 and c["attribute_count"] == 0 and d["attribute_count"] == 0
    merged = attr.merge_rules(attr.validate_rules(), {"attribute_rules": {"shape": {"rules": [{"keywords": ["CUADRADO"], "value": "cuadrado"}]}, "product_type": {"rules": [{"keywords": ["X"], "value": "x"}]}}})
    assert len(merged["attribute_rules"]["shape"]["rules"]) == 5 and len(merged["attribute_rules"]["product_type"]["rules"]) == 15
    better, accepted = attr.refine_rules(spark.createDataFrame([(1, "COSA CUADRADO"), (2, "FRASCO")], "product_id int, product_name string"), attr.validate_rules(), lambda rows: {"attribute_rules": {"shape": {"rules": [{"keywords": ["CUADRADO"], "value": "cuadrado"}]}}})
    assert accepted and len(better["attribute_rules"]["shape"]["rules"]) == 5


def test_families(spark):
    edges = spark.createDataFrame([("A", "B", 0.8), ("C", "D", 0.7)], "source string, target string, similarity double")
    assert [(r["family_id"], r["supplier_id"], r["family_size"]) for r in paths.families(edges).orderBy("supplier_id").collect()] == [("F001", "A", 2), ("F001", "B", 2)]


def test_triangle(spark):
    edges = spark.createDataFrame([("A", "B", 1.0), ("B", "C", 2.0), ("A", "C", 3.0)], "source string, target string, weight double")
    view, metrics = paths.kruskal_view(edges)
    assert [r["accepted"] for r in view.collect()] == [True, True, False]
    assert metrics == {"nodes": 3, "tree_edges": 2, "rejected": 1, "total_weight": 3.0, "components": 1}


def test_graph_algorithms_against_brute_force(spark):
    rng = random.Random(4)
    nodes = [f"n{i:02d}" for i in range(30)]
    rows = [(a, b, float(rng.randint(0, 20))) for a, b in itertools.combinations(nodes, 2) if rng.random() < 0.06]
    edges = spark.createDataFrame(rows, "source string, target string, weight double")
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    tree = []
    for a, b, w in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            tree.append((a, b, w))
    assert {r["node"]: r["component"] for r in connected_components(edges).collect()} == {n: find(n) for n in nodes if any(n in r[:2] for r in rows)}
    assert sorted(tuple(r) for r in paths.spanning_forest(edges).collect()) == sorted(tree)
    start = rows[0][0]
    cost, hops, todo = {start: 0.0}, {start: 0}, [start]
    for n in todo:
        for a, b, _ in rows:
            for x, y in ((a, b), (b, a)):
                if x == n and y not in hops:
                    hops[y] = hops[n] + 1
                    todo.append(y)
    for _ in nodes:
        for a, b, w in rows:
            for x, y in ((a, b), (b, a)):
                if x in cost and cost[x] + 1 / (w + 1) < cost.get(y, 1e9):
                    cost[y] = cost[x] + 1 / (w + 1)
    assert {r["node"]: r["hops"] for r in paths.hop_distances(edges, start).collect()} == hops
    assert {r["node"]: round(r["cost"], 9) for r in paths.cheapest_paths(edges, start).collect()} == {k: round(v, 9) for k, v in cost.items()}
    goal = max(hops, key=hops.get)
    found = paths.shortest_path(edges, start, goal)
    assert len(found) == hops[goal] + 1 and found[0] == start and found[-1] == goal and all({x, y} in [{a, b} for a, b, _ in rows] for x, y in zip(found, found[1:], strict=False))
    assert paths.shortest_path(edges, start, "nowhere") == [] and paths.shortest_path(edges, start, start) == [start]
    assert paths.heaviest_connection(edges, start, goal, "weight")[0][-1] == goal


def _semantic(spark):
    nodes = spark.createDataFrame([("PRODUCT:P1", "PRODUCT", "Frasco vidrio 30ML", 5.0), ("PRODUCT:P2", "PRODUCT", "Frasco vidrio", 42.0), ("TYPE:FRASCO", "TYPE", "frasco", 0.0), ("MATERIAL:VIDRIO", "MATERIAL", "VIDRIO", 0.0), ("CAPACITY:30ML", "CAPACITY", "30ML", 0.0)], "node_id string, node_type string, label string, units_sold double")
    edges = spark.createDataFrame([("PRODUCT:P1", "TYPE:FRASCO", 0.9), ("PRODUCT:P1", "MATERIAL:VIDRIO", 0.9), ("PRODUCT:P1", "CAPACITY:30ML", 0.95), ("PRODUCT:P2", "TYPE:FRASCO", 0.9), ("PRODUCT:P2", "MATERIAL:VIDRIO", 0.9)], "source string, target string, weight double")
    return nodes, edges


def test_semantic_search(spark):
    nodes, edges = _semantic(spark)
    both = search.search(nodes, edges, "frascos de vidrio").collect()
    assert [r["product"] for r in both] == ["PRODUCT:P2", "PRODUCT:P1"] and both[0]["relevance"] == round((0.9 + 0.9) * 5 * 21, 2)
    assert [r["product"] for r in search.search(nodes, edges, "frasco vidrio 30ML").collect()] == ["PRODUCT:P1"]
    assert search.search(nodes, edges, "frasco 123ML").collect() == [] and search.seed_groups(nodes, "frasco 123ML")[2] == ["capacity:123ML"]
    assert len(search.search(nodes, edges, "frasco", 1).collect()) == 1


def test_allocation(spark):
    options = spark.createDataFrame([("P", "A", 2.0, 5.0, 5.0), ("P", "B", 3.0, 10.0, 10.0)], "product_id string, supplier_id string, unit_cost double, capacity_units double, supplier_capacity double")
    demand = spark.createDataFrame([("P", 8.0)], "product_id string, quantity double")
    for solve in (optimise.allocate, optimise.min_cost_flow):
        assert sorted((r["supplier_id"], r["units"]) for r in solve(options, demand).collect()) == [("A", 5.0), ("B", 3.0)]


def test_shared_capacity_needs_flow(spark):
    options = spark.createDataFrame([("P", "A", 1.0, 5.0, 5.0), ("Q", "A", 1.0, 5.0, 5.0), ("P", "B", 2.0, 9.0, 9.0), ("Q", "C", 9.0, 9.0, 9.0)], "product_id string, supplier_id string, unit_cost double, capacity_units double, supplier_capacity double")
    demand = spark.createDataFrame([("P", 5.0), ("Q", 5.0)], "product_id string, quantity double")
    assert optimise.binding_suppliers(optimise.allocate(options, demand), options).count() == 1
    flow = optimise.min_cost_flow(options, demand).collect()
    assert sorted((r["product_id"], r["supplier_id"], r["units"]) for r in flow) == [("P", "B", 5.0), ("Q", "A", 5.0)]


def test_budgets(spark):
    rng = random.Random(1)
    lots = [(i + 1, round(rng.uniform(5, 60), 2), round(rng.uniform(1, 30), 2)) for i in range(9)]
    df = spark.createDataFrame(lots, "lot int, cost double, value double")
    chosen = [r for r in optimise.best_subset(df, 100.0).collect() if r["selected"]]
    best = max(sum(x[2] for x in s) for n in range(10) for s in itertools.combinations(lots, n) if sum(round(x[1] * 100) for x in s) <= 10000)
    assert abs(sum(r["value"] for r in chosen) - best) < 1e-9
    products = spark.createDataFrame([("A", 4.0, 2.5), ("B", 10.0, 4.0), ("C", 3.0, 0.0)], "product_id string, stock double, unit_cost_purchase double")
    items = spark.createDataFrame([("A", 6.0, 12.0), ("B", 5.0, 30.0), ("D", 2.0, 1.0)], "product_id string, quantity double, value double")
    plan = {r["product_id"]: r["units"] for r in optimise.catalog_budget(products, items, 20.0).collect()}
    value = {"A": 2.0, "B": 6.0, "D": 0.5}
    cost = {"A": 2.5, "B": 4.0, "D": 1.0}
    best = max(2 * a + 6 * b + 0.5 * d for a in range(5) for b in range(6) for d in range(3) if 2.5 * a + 4 * b + d <= 20)
    assert sum(value[k] * n for k, n in plan.items()) == best and sum(cost[k] * n for k, n in plan.items()) <= 20


def test_campaign_paths_cost_what_they_say(spark):
    options = spark.createDataFrame([(f"P{i}", f"Producto {i}", f"s{j}", f"Proveedor {j}", 1.0 + i + j, 100.0) for i in range(3) for j in range(4)], "product_id string, product_name string, supplier_id string, supplier string, unit_cost double, capacity_units double")
    prices = spark.createDataFrame([("P0", 9.0)], "product_id string, unit_price_sale double")
    offers = optimise.campaign_offers(options, prices, "2025-01-01")
    weights = {(r["source"], r["target"]): r["weight"] for r in optimise.campaign_edges(offers).collect()}
    rows = offers.collect()
    assert len(rows) == 27 and optimise.best_campaigns(offers).count() == 9
    for r in rows:
        steps = r["path"].split("|")
        assert abs(sum(weights[p] for p in zip(steps, steps[1:], strict=False)) - r["final_cost"]) < 1e-6


def test_flow_outputs(spark):
    options = spark.createDataFrame([("P", "Frasco", "A", "Ana", 2.0, 5.0, 5.0), ("P", "Frasco", "B", "Beto", 3.0, 2.0, 10.0), ("Q", "Tapa", "A", "Ana", 1.0, 1.0, 5.0)], "product_id string, product_name string, supplier_id string, supplier string, unit_cost double, capacity_units double, supplier_capacity double")
    demand = spark.createDataFrame([("P", 8.0), ("R", 1.0)], "product_id string, quantity double")
    flow = optimise.min_cost_flow(options, demand)
    assert sorted((r["product_name"], r["supplier"], r["units"], r["line_cost"]) for r in optimise.flow_lines(flow, options).collect()) == [("Frasco", "Ana", 5.0, 10.0), ("Frasco", "Beto", 2.0, 6.0)]
    assert sorted((r["product_id"], r["shortfall"]) for r in optimise.flow_unmet(flow, demand).collect()) == [("P", 1.0), ("R", 1.0)]
    assert tuple(optimise.flow_totals(flow, demand).first()) == (9.0, 7.0, 16.0, 2, 2)
    network = {(r["source"], r["target"]): (r["capacity"], r["flow"]) for r in optimise.flow_network(flow, options, demand).collect()}
    assert network == {("SOURCE", "P:P"): (8.0, 7.0), ("SOURCE", "P:R"): (1.0, 0.0), ("P:P", "S:A"): (5.0, 5.0), ("P:P", "S:B"): (2.0, 2.0), ("S:A", "SINK"): (5.0, 5.0), ("S:B", "SINK"): (10.0, 2.0)}
    assert [tuple(r)[:4] + tuple(r)[6:] for r in optimise.flow_steps(flow, demand).orderBy("step").collect()] == [(1, "P", "A", 5.0, 10.0, 3.0), (2, "P", "B", 2.0, 16.0, 1.0)]


def _cheapest(options, capacity, demand):
    """Units served and cost by successive cheapest paths over source, products, suppliers and sink."""
    names = {k: i for i, k in enumerate(["source", *(("p", p) for p in demand), *(("s", s) for s in capacity), "sink"])}
    out, arcs = [[] for _ in names], []

    def arc(a, b, room, cost):
        out[names[a]].append(len(arcs))
        arcs.append([names[b], room, cost])
        out[names[b]].append(len(arcs))
        arcs.append([names[a], 0.0, -cost])

    for p, q in demand.items():
        arc("source", ("p", p), q, 0.0)
    for p, s, cost, room in options:
        arc(("p", p), ("s", s), room, cost)
    for s, room in capacity.items():
        arc(("s", s), "sink", room, 0.0)
    served = total = 0.0
    while True:
        dist, via, changed = [math.inf] * len(names), [None] * len(names), True
        dist[0] = 0.0
        while changed:
            changed = False
            for a, edges in enumerate(out):
                for e in edges:
                    b, room, cost = arcs[e]
                    if room > 1e-9 and dist[a] + cost < dist[b] - 1e-12:
                        dist[b], via[b], changed = dist[a] + cost, e, True
        if via[-1] is None:
            return served, total
        way, at = [], len(names) - 1
        while at:
            way.append(via[at])
            at = arcs[via[at] ^ 1][0]
        push = min(arcs[e][1] for e in way)
        for e in way:
            arcs[e][1] -= push
            arcs[e ^ 1][1] += push
        served, total = served + push, total + push * dist[-1]


@pytest.mark.parametrize("seed", [3, 11])
def test_flow_equals_cheapest_paths(spark, seed):
    """Parts whose suppliers bind, one of them too small for its demand."""
    rng = random.Random(seed)
    rows, capacity, demand, want = [], {}, {}, [0.0, 0.0]
    for part in range(3):
        own = {f"s{part}{j}": float(rng.randint(10, 40) if part else 15) for j in range(3)}
        asked = {f"p{part}{i}": float(rng.randint(1, 20)) for i in range(7)}
        options = [(p, s, float(rng.randint(1, 40)), float(rng.randint(3, 30))) for p in asked for s in own if rng.random() < 0.7]
        got = _cheapest(options, own, asked)
        want = [want[0] + got[0], want[1] + got[1]]
        rows += options
        capacity |= own
        demand |= asked
    table = spark.createDataFrame([(*r, capacity[r[1]]) for r in rows], "product_id string, supplier_id string, unit_cost double, capacity_units double, supplier_capacity double")
    rounds = []
    flow = optimise.min_cost_flow(table, spark.createDataFrame(list(demand.items()), "product_id string, quantity double"), rounds=rounds).collect()
    assert sum(r["units"] for r in flow) == pytest.approx(want[0]) and sum(r["units"] * r["unit_cost"] for r in flow) == pytest.approx(want[1], abs=optimise.EPSILON * want[0])
    assert rounds and max(sum(r["units"] for r in flow if r["supplier_id"] == s) - c for s, c in capacity.items()) < 1e-6 and want[0] < sum(demand.values())


def test_flow_over_a_chain_of_exchanges(spark):
    """Only the last supplier of a chain has room: one unit must be passed on along all of it."""
    n = 5
    options = [(f"p{i}", f"s{i + k}", 1.0 + k, 10.0, 5.0 if i + k < n else 9.0) for i in range(n) for k in (0, 1)] + [("x", "s0", 1.0, 10.0, 5.0)]
    table = spark.createDataFrame(options, "product_id string, supplier_id string, unit_cost double, capacity_units double, supplier_capacity double")
    demand = spark.createDataFrame([(f"p{i}", 5.0) for i in range(n)] + [("x", 1.0), ("none", 3.0), ("p9", -1.0)], "product_id string, quantity double")
    flow = {(r["product_id"], r["supplier_id"]): r["units"] for r in optimise.min_cost_flow(table, demand).collect()}
    assert flow == {("x", "s0"): 1.0, **{(f"p{i}", f"s{i}"): 4.0 for i in range(n)}, **{(f"p{i}", f"s{i + 1}"): 1.0 for i in range(n)}}
    assert optimise.min_cost_flow(table.limit(0), demand).collect() == []


def _all_plans(kinds, room):
    """Most value and its least cost, over all numbers of units."""
    best = {0: 0.0}
    for cents, value, n in kinds:
        best = _merged(best, cents, value, n, room)
    top = max(best.values())
    return top, min(c for c, v in best.items() if v >= top - 1e-9)


def _merged(best, cents, value, n, room):
    out = {}
    for c, v in best.items():
        for k in range(n + 1):
            if c + k * cents <= room:
                out[c + k * cents] = max(out.get(c + k * cents, -1.0), v + k * value)
    return out


def test_best_bundles_equal_all_plans():
    rng = random.Random(3)
    for t in range(150):
        kinds = [(rng.randint(1, 30), float(rng.randint(1, 20)) if t % 2 else rng.uniform(0.5, 20), rng.randint(1, 6)) for _ in range(rng.randint(0, 9))]
        room = rng.randint(0, 200)
        _, cents, value = optimise._bundles(pd.DataFrame(kinds, columns=["cents", "value", "n"]))
        picked = optimise.best_bundles(cents, value, room)
        want = _all_plans(kinds, room)
        assert value[picked].sum() == pytest.approx(want[0]) and cents[picked].sum() == want[1]


@pytest.mark.parametrize("near", [2, 128])
def test_catalogue_budget_equals_all_plans(spark, near):
    rng = random.Random(near)
    kinds = [(rng.randint(50, 400), float(rng.randint(1, 90)), rng.randint(1, 5)) for _ in range(60)]
    kinds = list({(c, v): (c, v, n) for c, v, n in kinds}.values())
    took = optimise.best_kinds(spark.createDataFrame(kinds, "cents long, value double, n long"), 9_000, near).collect()
    want = _all_plans(kinds, 9_000)
    assert sum(r["take"] * r["value"] for r in took) == pytest.approx(want[0]) and sum(r["take"] * r["cents"] for r in took) == want[1]
    most = {(c, v): n for c, v, n in kinds}
    assert all(0 < r["take"] <= most[r["cents"], r["value"]] for r in took)


def test_catalogue_budget_takes_smaller_ids_of_equal_units(spark):
    products = spark.createDataFrame([(f"P{i}", 3.0, 2.0) for i in range(9)], "product_id string, stock double, unit_cost_purchase double")
    items = spark.createDataFrame([(f"P{i}", 5.0, 10.0) for i in range(8, -1, -1)] + [("free", 2.0, None), ("P0", None, 0.0)], "product_id string, quantity double, value double")
    got = {r["product_id"]: r["units"] for r in optimise.catalog_budget(products, items, 15.0).collect()}
    assert got == {"P0": 3, "P1": 3, "P2": 1, "free": 1}


def test_long_chains(spark):
    n = 24
    chain = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}", 1.0) for i in range(n)] + [("n000", "z", 1.0)], "source string, target string, weight double")
    assert paths.shortest_path(chain, "n000", f"n{n:03d}") == [f"n{i:03d}" for i in range(n + 1)]
    assert paths.hop_distances(chain, "n000").agg(F.max("hops")).first()[0] == n
    assert paths.heaviest_connection(chain, "z", f"n{n:03d}", "weight") == (["z", *(f"n{i:03d}" for i in range(n + 1))], n + 1.0)


def test_heaviest_connection_writes_no_edges(spark, monkeypatch):
    """What is written grows with the frontiers and not with the edges, which a second table may hold too; of equal paths the one of the first parents is taken, also if it has more edges."""
    text = "source string, target string, amount double"
    rng, written = random.Random(3), []
    far = spark.createDataFrame([(f"f{rng.randrange(3000)}", f"f{rng.randrange(3000)}", float(rng.randrange(50))) for _ in range(9000)], text)
    near = spark.createDataFrame([("s", "b", 3.0), ("b", "g", 3.0), ("s", "x", 7.0), ("a", "x", 7.0), ("x", "a", 2.0), ("a", "g", 3.0), ("s", "g", 0.5), ("s", "s", 9.0), ("g", "f1", None)], text)
    monkeypatch.setattr(paths, "materialise", lambda df: written.append(materialise(df)) or written[-1])
    assert paths.heaviest_connection([far, near], "s", "g") == (["s", "x", "a", "g"], 17.0)
    assert sum(t.count() for t in written) < 200
    assert paths.heaviest_connection(near, "s", "nowhere") == ([], 0.0) and paths.heaviest_connection(near, "s", "s") == (["s"], 0.0) and paths.heaviest_connection(near, "s", None) == ([], 0.0)


def _sets(edges):
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in parent}


def test_components_fold_leaves_first(spark, monkeypatch):
    """Folding leaves few edges of a graph of centres to the star rounds, and no graph gets other components by it; those of two graphs are tied by what both know."""
    rng, left = random.Random(8), []
    stars = components._stars
    monkeypatch.setattr(components, "_stars", lambda edges: left.append(edges.count()) or stars(edges))
    as_table = lambda rows: spark.createDataFrame(rows, "source string, target string")
    got = lambda found: {r["node"]: r["component"] for r in found.collect()}
    lines = [(f"C{rng.randrange(9)}", f"{kind}{rng.randrange(n)}") for kind, n in (("D", 600), ("P", 90)) for _ in range(1500)] + [("X1", "Y1"), ("X1", "Y1"), ("Y1", "X1"), ("Z", "Z")]
    assert got(components.connected_components(as_table(lines), few=20)) == _sets([e for e in lines if e[0] != e[1]]) and left.pop() <= 20
    chain = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(12)] + [(f"m{rng.randrange(40):02d}", f"m{rng.randrange(40):02d}") for _ in range(30)]
    chain = [e for e in chain if e[0] != e[1]]
    assert got(components.connected_components(as_table(chain), few=0)) == _sets(chain)
    assert got(components.merged_components(*(components.connected_components(as_table(x)) for x in (chain[:20], chain[20:])))) == _sets(chain)


def test_links_hang_a_transaction_graph_together(spark):
    rows = [("a", "d1", 1), ("a", None, 2), ("b", " ", 3), ("b", "d2", None), (None, "d2", 4), (None, "d3", 5), (None, None, 6), ("c", "d1", 7)]
    lines = spark.createDataFrame([(*r, "", "", 1.0, 1.0) for r in rows], "entity_norm string, document string, product_id int, entity_name string, product_name string, quantity double, total double")
    edges = [tuple(r) for r in graphs.transaction_graph(lines, "CLIENT", "sale")[1].select("source", "target").collect()]
    assert _sets([tuple(r) for r in graphs.transaction_links(lines, "CLIENT").collect()]) == _sets(edges)
    by_kind = [tuple(r) for e in graphs.transaction_kinds(lines, "CLIENT")[1].values() for r in e.select("source", "target").collect()]
    assert sorted(by_kind) == sorted(edges)
    nodes = [tuple(r) for n in graphs.transaction_kinds(lines, "CLIENT")[0].values() for r in n.withColumn("kind", graphs.kind_of("node_id")).collect()]
    assert sorted(n[:3] for n in nodes) == sorted(tuple(r) for r in graphs.transaction_graph(lines, "CLIENT", "sale")[0].collect()) and all(n[1] == n[3] for n in nodes)


def test_searches_over_a_kept_adjacency(spark):
    """Same answers as over the edges; a frontier's join with it shuffles no edges."""
    rng = random.Random(8)
    edges = spark.createDataFrame([(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(80)], "source string, target string")
    kept = paths.adjacency(edges, 4)
    assert sorted(map(tuple, paths.hop_distances(kept, "n00").collect()), key=str) == sorted(map(tuple, paths.hop_distances(edges, "n00").collect()), key=str)
    assert paths.shortest_path(kept, "n00", "n31") == paths.shortest_path(edges, "n00", "n31") and paths.shortest_path(kept, "n00", "none") == []
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        front = spark.createDataFrame([("n00",), ("n01",)], "node string")
        plan = paths.neighbours(kept, front)._jdf.queryExecution().sparkPlan().toString() + paths.neighbours(kept, front)._jdf.queryExecution().executedPlan().toString()
        edge_side = plan[plan.rindex("SortMergeJoin") :]
        assert "Bucketed: true" in edge_side and edge_side.count("Exchange") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_numbered(spark):
    rows = [(i % 7, i) for i in range(500)]
    got = numbered(spark.createDataFrame(rows, "a int, b int").repartition(6), "n", F.desc("a"), "b").collect()
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["n"])] == sorted(rows, key=lambda r: (-r[0], r[1])) and sorted(r["n"] for r in got) == list(range(1, 501))


def test_name_index_finds_what_comparing_all_names_finds(spark, tmp_path):
    rng = random.Random(2)
    words = ["TAPA", "FRASCO", "VIDRIO", "GOTERO", "NEGRO", "ÑANDU", "30ML", "TAPAS"]
    rows = [(i, " ".join(rng.choice(words).lower() for _ in range(rng.randint(1, 4)))) for i in range(300)] + [(900, None), (901, ""), (902, "Único")]
    products = spark.createDataFrame(rows, "product_id int, product_name string").repartition(5)
    search.name_index(products).write.parquet(f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    for query in ("frasco", "frasco vidrio", "tapa negro 30ml", "unico", "nand", "gotero xyz", ""):
        want = [tuple(r) for r in search.text_search(products, query, 12).collect()]
        assert [tuple(r) for r in search.text_search(products, query, 12, index).collect()] == want, query
    plan = search.text_search(products, "frasco vidrio", 12, index)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(word,FRASCO)" in plan and "Python" not in plan and "Arrow" not in plan
    # the entries that are read: those of one word
    assert index.where("word = 'FRASCO'").count() < 0.5 * len(rows)


def test_decimal_aware_sizes(spark):
    products = spark.createDataFrame([(1, "Frasco 1.5L"), (2, "Tapa 24/410"), (3, "Bolsa 16*19 cm"), (4, "Gotero 0,5 ml ámbar"), (5, "Frasco 30ML B24"), (6, None)], "product_id int, product_name string")
    plain, aware = ({r["product_id"]: (r["capacity_value"], r["capacity_unit"], r["mouth_size_mm"], r["size_text"]) for r in attr.extract_attributes(products, decimal_aware=x).collect()} for x in (False, True))
    assert plain[1] == (5.0, "L", None, None) and plain[2] == plain[3] == (None, None, None, None)
    assert aware == {1: (1.5, "L", None, None), 2: (None, None, 24.0, None), 3: (None, None, None, "16*19 CM"), 4: (0.5, "ML", None, None), 5: (30.0, "ML", 24.0, None), 6: (None, None, None, None)}


@pytest.mark.parametrize("most", [0, 40, 10_000])
def test_grouped_median(spark, most):
    """Groups that one buffer may hold and groups that are divided, null keys and null values among them."""
    rng = random.Random(most)
    rows = [("hot" if i % 3 else [f"g{i % 7}", None][i % 2], rng.choice([None, 1.0, 2.5, rng.random()])) for i in range(900)] + [("none", None), ("one", 4.0)]
    want = {}
    for g, v in rows:
        want.setdefault(g, []).append(v)
    want = {g: float(pd.Series(v, dtype=float).median()) if any(x is not None for x in v) else None for g, v in want.items()}
    got = {r["g"]: r["m"] for r in activity.grouped_median(spark.createDataFrame(rows, "g string, v double").repartition(8), ["g"], "v", "m", most).collect()}
    assert got == pytest.approx(want)


def test_supply_options_of_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("p", None, "s", "S", float(rng.randint(1, 9)), 0.0, float(rng.randint(1, 90)), datetime.date(2024, 1, 1 + i % 28)) for i in range(300)] + [(f"p{i % 9}", f"n{i % 9}", f"s{i % 4}", "X", 2.0, float(i), 8.0, None) for i in range(80)]
    lines = spark.createDataFrame(rows, "product_id string, product_name string, entity_norm string, entity_name string, quantity double, unit_value double, total double, date date")
    assert sorted(map(str, activity.supply_options(lines, most=50).collect())) == sorted(map(str, activity.supply_options(lines).collect()))


@pytest.mark.parametrize("few", [0, 10_000])
def test_running(spark, few):
    rng = random.Random(few)
    rows = [("hot" if i % 3 else f"g{i % 7}", i, float(rng.randint(0, 9))) for i in range(700)]
    got = running(spark.createDataFrame(rows, "g string, i int, v double").repartition(9), ["g"], [F.desc("i")], {"before": "v", "n": F.lit(1)}, few).collect()
    assert len(got) == 700 and set(got[0].asDict()) == {"g", "i", "v", "before", "before_total", "n", "n_total"}
    for r in got:
        own = [(i, v) for g, i, v in rows if g == r["g"]]
        assert (r["before"], r["n"], r["before_total"], r["n_total"]) == (sum(v for i, v in own if i > r["i"]), sum(i > r["i"] for i, _ in own), sum(v for _, v in own), len(own))


def test_projection_sends_products_and_not_pairs(spark, monkeypatch):
    """Before pairs are formed a block of suppliers gets a product once: far fewer rows are dealt out than there are pairs, and pairs equal those counted one by one."""
    rng = random.Random(2)
    sold = {f"s{i}": {rng.randrange(30) for _ in range(12)} for i in range(60)}
    monkeypatch.setattr(graphs, "BLOCK", 7)
    rows = spark.createDataFrame([(s, p) for s, ps in sold.items() for p in ps] + [("s1", None), (None, 3)], "entity_norm string, product_id int")
    frame, sent = type(rows), []
    monkeypatch.setattr(frame, "repartition", lambda self, *by, deal=frame.repartition: sent.append(self.count()) or deal(self, *by))
    out = graphs.supplier_projection(rows, 0.3, 3)
    want = {(a, b): (len(sold[a] & sold[b]), len(sold[a]), len(sold[b]), len(sold[a] & sold[b]) / len(sold[a] | sold[b])) for a in sold for b in sold if a < b and len(sold[a] & sold[b]) >= 3}
    got = {(r["source"], r["target"]): (r["shared_products"], r["source_product_count"], r["target_product_count"], r["similarity"]) for r in out.collect()}
    assert got == {k: v for k, v in want.items() if v[3] >= 0.3} and got
    pairs = sum(1 for a in sold for b in sold if a < b for _ in sold[a] & sold[b])
    assert sent and sent[0] < pairs / 4


def test_spanning_display(spark):
    rng = random.Random(4)
    edges = spark.createDataFrame([(f"n{a:02d}", f"n{b:02d}", round(rng.random(), 6)) for a in range(30) for b in range(a + 1, 30) if rng.random() < 0.5], "source string, target string, weight double")
    considered, metrics = paths.kruskal_view(edges, None)
    shown = paths.spanning_display(considered, 20).orderBy("step").collect()
    assert metrics["tree_edges"] == 29 and len(shown) == 20 and [r["step"] for r in shown] == list(range(1, 21))
    assert sum(not r["accepted"] for r in shown) == 6 and all(x["considered_step"] < y["considered_step"] for x, y in zip(shown, shown[1:], strict=False))
    assert paths.spanning_display(considered, 100).where("accepted").count() == 29


def test_hot_products_of_the_projection(spark, monkeypatch):
    sold = spark.createDataFrame([(f"s{i}", p) for i in range(40) for p in range(12) if (i * p) % 5 != 1], "entity_norm string, product_id int")
    want = sorted(map(tuple, graphs.supplier_projection(sold).collect()))
    monkeypatch.setattr(graphs, "PROJECTED", 3)
    assert sorted(map(tuple, graphs.supplier_projection(sold).collect())) == want and want


def test_names_that_may_be_alike(spark):
    rng = random.Random(2)
    words = ["TAPA", "FRASCO", "PET", "ANDINA", "SAC", "A", "LIMA"]
    names = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(80)] + ["".join(rng.choice("ABCDE") for _ in range(rng.randint(1, 9))) for _ in range(80)] + ["", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for text in ("TAPA PET", "ABCA", "FRASCOS"):
        able = {r["n"] for r in df.where(T.may_reach(text, F.col("n"), 0.5)).collect()}
        assert {n for n in names if n and T.token_set_ratio(text, n) >= 0.5} <= able and len(able) < len(set(names)) - 5


def test_suppliers_by_name(spark):
    suppliers = spark.createDataFrame([("10", "Andina Tapas SRL"), ("11", "Lima Envases"), ("12", "Nexo")], "supplier_id string, supplier string")
    projection = spark.createDataFrame([("10", "11", 4, 0.5, 0.4, 0.3), ("10", "12", 2, 0.2, 0.9, 0.1)], "source string, target string, shared_products int, source_coverage double, target_coverage double, similarity double")
    families = spark.createDataFrame([("F001", "10", 3), ("F001", "11", 3), ("F001", "12", 3)], "family_id string, supplier_id string, family_size int")
    got = recommend.substitutes_for(suppliers, projection, families, "lima envase").collect()
    assert [(r["supplier_id"], r["supplier_name"], r["coverage"], r["matched_id"], r["match_score"], r["family_id"]) for r in got] == [("10", "Andina Tapas SRL", 0.4, "11", 0.92, "F001")]
    assert recommend.substitutes_for(suppliers, projection, families, "zzzzzz").collect() == [] and recommend.suggestions(suppliers, "nexos").first()["supplier"] == "Nexo"


def test_find_node(spark):
    nodes = spark.createDataFrame([("CLIENT:9", "CLIENT", "Señor Núñez"), ("SUPPLIER:1", "SUPPLIER", "Nunez SA"), ("CLIENT:2", "CLIENT", "Otro")], "node_id string, node_type string, label string")
    assert search.find_node(nodes, "nuñez") == "CLIENT:9" and search.find_node(nodes, "NUNEZ", "SUPPLIER") == "SUPPLIER:1" and search.find_node(nodes, "x y") is None and search.find_node(nodes, "client:2") is None


def test_dates(spark):
    cases = {
        "15/03/2024": "2024-03-15", "2024-3-5": "2024-03-05", "05-03-2024 10:20": "2024-03-05", "2024/03/15": "2024-03-15", "15.03.2024": "2024-03-15", "15 Mar 2024": "2024-03-15", "15 march 2024": "2024-03-15", "March 15, 2024": "2024-03-15",
        "20240315": "2024-03-15", "03/25/2024": "2024-03-25", "2024-03-15T08:00:00Z": "2024-03-15", "5/3/24": "2024-03-05", "1st Jan 2024": "2024-01-01", "hello": None, "": None, None: None, "32/13/2024": None,
    }
    got = {r["t"]: str(r["d"]) if r["d"] else None for r in spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.parse_date(F.col("t")).alias("d")).collect()}
    assert got == cases


def test_rule_additions():
    raw = {"attribute_rules": {"shape": {"rules": [{"keywords": ["redondo"], "value": "Muy Redondo", "confidence": 7}, {"keywords": [], "value": "x"}, "bad"]}, "product_type": {"rules": [{"keywords": ["a"], "value": "b"}]}, "feature": {"method": "eval", "rules": []}}, "material_rules": [{"keyword": "vidrio", "material": "glass"}, {"keyword": "", "material": "x"}], "color_keywords": ["rojo", "x1"]}
    got = attributes.sanitize_additions(raw)
    assert got["attribute_rules"] == {"shape": {"method": "keyword_first_match", "rules": [{"keywords": ["REDONDO"], "value": "muy_redondo", "confidence": 1.0}]}}
    assert got["material_rules"] == [{"keyword": "VIDRIO", "material": "GLASS", "family": "GLASS", "confidence": 0.94}] and got["color_keywords"] == ["ROJO"]
    with pytest.raises(ValueError):
        attributes.sanitize_additions([])
    assert attributes.extract_json_object('```json\n{"a": 1}\n```') == attributes.extract_json_object('sure: {"a": 1} ok') == {"a": 1}
    with pytest.raises(ValueError):
        attributes.extract_json_object("none")


def test_sample_descriptions(spark):
    products = spark.createDataFrame([(i, "FRASCO " + "X" * (i % 9) + f" {i % 20}") for i in range(60)], "product_id int, product_name string")
    found = attributes.extract_attributes(products)
    names = [r[0] for r in attributes.sample_descriptions(products, found, 12).collect()]
    assert len(names) == len(set(names)) == 12 and attributes.sample_descriptions(products, found, 500).count() == len({r[1] for r in products.collect()})


def test_rule_methods_and_sizes(spark):
    rules = {"attribute_rules": {"shape": {"method": "contains_any", "rules": [{"keywords": ["CUADRADO", "LISO"], "value": "v1"}, {"keywords": ["LISO"], "value": "v2"}]}, "accessory": {"method": "not_contains_any", "rules": [{"keywords": ["TAPA"], "value": "sin_tapa"}]}}}
    df = spark.createDataFrame([(1, "Caja liso 10 x 20 cm"), (2, "Frasco con tapa")], "product_id int, product_name string")
    got = {r["product_id"]: r for r in attributes.extract_attributes(df, rules).collect()}
    assert (got[1]["shape"], got[1]["accessory"], got[1]["size_text"]) == ("v1|v2", "sin_tapa", "10 X 20 CM") and (got[2]["shape"], got[2]["accessory"], got[2]["size_text"]) == (None, None, None)


def test_small_functions(spark):
    row = spark.createDataFrame([('{"a": 0.5}', 1500, 250, 7, "ANDINA tapas s.a.")], "j string, a long, b long, c long, n string").select(
        T.parse_confidence(F.col("j")).alias("j"), *(T.package_label(F.col(c)).alias(c) for c in "abc"), T.readable_supplier_name(F.col("n")).alias("n")).first()
    assert (row["j"], row["a"], row["b"], row["c"], row["n"]) == ({"a": 0.5}, "1.5 millares", "2 cientos", "7 unidades", "Andina Tapas SA")


def test_budget_takes_lots_or_catalogue(spark):
    options = spark.createDataFrame([("P", "A", 2.0, 5.0)], "product_id string, supplier string, unit_cost double, capacity_units double")
    products = spark.createDataFrame([("P", "Frasco", 5.0, 9.0, 2.0)], "product_id string, product_name string, unit_price_sale double, stock double, unit_cost_purchase double")
    items = spark.createDataFrame([("P", 3.0, 6.0)], "product_id string, quantity double, value double")
    assert {"lot", "selected"} <= set(optimise.optimise_budget(options, products, items, 100.0).columns) and optimise.optimise_budget(None, products, items, 100.0).first()["units"] == 3


def test_quoted_line_ends_and_order_of_files(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a;b\n1;"one\ntwo"\n2;"say ""x"""\n', "utf-8")
    assert [(r["a"], r["b"]) for r in read_table(spark, f"{tmp_path}/q.csv").orderBy("_ord").collect()] == [("1", "one\ntwo"), ("2", 'say "x"')]
    (tmp_path / "many").mkdir()
    for k, n in ((0, 5), (1, 4000), (2, 3)):
        (tmp_path / "many" / f"f{k}.csv").write_text("x,y\n" + "".join(f"{k * 10000 + i},t\n" for i in range(n)), "utf-8")
    got = [int(r["x"]) for r in read_table(spark, f"{tmp_path}/many").orderBy("_ord").collect()]
    assert got == sorted(got) and len(got) == 4008
    (tmp_path / "bar.csv").write_text("a|b\n1|2\n", "utf-8")
    (tmp_path / "one.csv").write_text("a\n1\n", "utf-8")
    assert read_table(spark, f"{tmp_path}/bar.csv").columns[:2] == ["a", "b"] and read_table(spark, f"{tmp_path}/one.csv").columns[0] == "a"


def test_export(spark, tmp_path):
    catalog = Catalog(spark, f"{tmp_path}/store")
    catalog.write_table("d1", "t", spark.createDataFrame([(1, "x, y"), (2, None)], "a int, b string"))
    catalog.export_csv("d1", "t", f"{tmp_path}/out")
    assert sorted(map(tuple, spark.read.csv(f"{tmp_path}/out", header=True).collect())) == [("1", "x, y"), ("2", None)]
    assert {"loaded_at", "updated_at", "bytes"} <= set(catalog.datasets().columns)


def _fixture(folder, n=12, coordinates=True):
    (folder / "p.csv").write_text("CODIGO INTERNO;DESCRIPCIÓN;STOCK ACTUAL DISPONIBLE;PRECIO COMPRA UNITARIO (CON IGV);VALOR VENTA UNITARIO (SIN IGV)\n" + "".join(f"P{i};FRASCO VIDRIO {10 + i}ML;{i};{1 + i},5;{2 + i},5\n" for i in range(n)), "utf-8-sig")
    place = ";LATITUD;LONGITUD" if coordinates else ""
    at = lambda k: f";-12,0{k};-77,0{k}" if coordinates else ""
    (folder / "v.csv").write_text(f"FECHA DE EMISIÓN;SERIE;NÚMERO;DENOMINACIÓN ENTIDAD;CÓDIGO;DESCRIPCIÓN;CANTIDAD;TOTAL;ANULADO{place}\n" + "".join(f"0{1 + i % 9}/03/2025;F001;{i};Cliente {i % 4};P{i};FRASCO VIDRIO {10 + i}ML;4;{4 * (2 + i)},0;{'SI' if i == 0 else 'NO'}{at(i % 4)}\n" for i in range(n)), "utf-8-sig")
    (folder / "c.csv").write_text(f"FECHA DE EMISIÓN;SERIE;NÚMERO;DENOMINACIÓN ENTIDAD;CÓDIGO;DESCRIPCIÓN;CANTIDAD;VALOR UNITARIO;TOTAL{place}\n" + "".join(f"2025-03-1{i % 9};C001;{i};Proveedor {i % 2 + j};P{i};FRASCO VIDRIO {10 + i}ML;50;{1 + i},1;0{at(i % 3)}\n" for i in range(n) for j in range(2)), "utf-8-sig")
    return [f"{folder}/{x}.csv" for x in "pvc"]


def test_build(spark, tmp_path):
    files = _fixture(tmp_path)
    assert read_table(spark, files[0]).count() == 12
    catalog = Catalog(spark, f"{tmp_path}/store")
    out = build_dataset(spark, catalog, *files, today="2025-01-01")
    assert out.status == "ready" and {"business_edges", "attribute_edges", "logistics_edges", "supplier_families", "campaign_best"} <= set(out.generated) and out.row_counts == {"products": 12, "sales": 11, "purchases": 24}
    assert dataset_summary(catalog, out.dataset_id)["row_counts"]["sales"] == 11
    sizes = {(r["graph"], r["metric"]): r["n"] for r in graph_summary(catalog, out.dataset_id).collect()}
    assert {"G_attr", "G_business", "G_sales", "G_purchases", "supplier_projection", "offers", "flow", "logistics", "all"} == {g for g, _ in sizes} and sizes["all", "nodes_PRODUCT"] == 12
    assert catalog.read_json(out.dataset_id, "normalization_report")["thresholds"]["rows"] == 10
    assert [r["dataset_id"] for r in catalog.datasets().collect()] == [out.dataset_id] and "supply_options" in catalog.artifacts(out.dataset_id)
    assert catalog.delete(out.dataset_id)
    with pytest.raises(FileNotFoundError):
        catalog.read_table(out.dataset_id, "sales")


def test_build_without_coordinates_and_too_small(spark, tmp_path):
    catalog = Catalog(spark, f"{tmp_path}/store")
    out = build_dataset(spark, catalog, *_fixture(tmp_path, coordinates=False), today="2025-01-01")
    assert "logistics_edges" not in out.generated and ("logistics", "no coordinates") in [tuple(x) for x in out.omitted]
    with pytest.raises(PipelineError):
        build_dataset(spark, catalog, *_fixture(tmp_path, 5), today="2025-01-01")
