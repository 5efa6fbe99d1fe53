"""Buying: campaigns, budgets and minimum-cost allocation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import package_label, readable_supplier_name, stable_int
from ..plans.tables import discard, materialise, numbered, running

#: Names for suppliers without one, names that say nothing, campaign names, margins and budget shares by profile.
SUPPLIER_POOL = [
    "Frascos Chorrillos SAC", "Andina Tapas SRL", "Nexo Industrial EIRL", "Altura PET SAC", "Atomizadores Lince SAC", "Nova Envases EIRL", "Plastinka Mayorista SAC", "Kuntur Packaging SAC",
]
GENERIC_NAMES = ["", "QUESITO SA", "QUESITO S.A.", "COTIZACION ALTERNATIVA", "COTIZACIÓN ALTERNATIVA", "PROVEEDOR GENERICO", "PROVEEDOR GENÉRICO"]
CAMPAIGNS = ["Cyberday", "Aniversario proveedor", "Cierre de mes"]
MARGINS = [0.50, 0.43, 0.35, 0.27, 0.23, 0.18]
BUDGET_SHARES = [0.22, 0.31, 0.42, 0.55, 0.68, 0.82]
SCALED_BUDGET, MAX_LOTS, MAX_OFFERS = 1500, 12, 180
#: Steps that are summed up together.
RUN = 4096


def _pick(values: list, i: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (i + 1).cast("int"))


def supplier_name(product: Column, raw: Column, salt: Column, avoid: Column | None = None) -> Column:
    """A readable supplier name; a name that says nothing is replaced by one of the pool, not ``avoid``."""
    clean = F.trim(F.coalesce(raw, F.lit("")))
    start = F.pmod(stable_int(product, clean, salt), F.lit(len(SUPPLIER_POOL)))
    one = _pick(SUPPLIER_POOL, start)
    other = _pick(SUPPLIER_POOL, F.pmod(start + 1, F.lit(len(SUPPLIER_POOL))))
    pooled = one if avoid is None else F.when(one == avoid, other).otherwise(one)
    return F.when(F.upper(clean).isin(*GENERIC_NAMES), pooled).otherwise(readable_supplier_name(clean))


def campaign_offers(options: DataFrame, sale_prices: DataFrame, today: str, max_offers: int = MAX_OFFERS) -> DataFrame:
    """Three variants (buy today, or wait for one of two campaigns) of the cheapest three offers of each product.

    ``sale_prices`` has product_id and unit_price_sale; the first ``max_offers`` offers are taken, by product. The paths of this
    graph are its variants, so their costs are arithmetic and need no relaxation.
    """
    text = F.col("product_id").cast("string")
    w = Window.partitionBy("product_id").orderBy("unit_cost", F.desc("capacity_units"), "supplier_id")
    offers = (
        options.where("unit_cost > 0 and capacity_units > 0").withColumn("_r", F.row_number().over(w)).where("_r <= 3")
        .orderBy(text, "_r").limit(max_offers).withColumn("offer", F.row_number().over(Window.orderBy(text, "_r")))  # at most max_offers rows
        .join(sale_prices.select("product_id", "unit_price_sale"), "product_id", "left")
    )
    supplier = F.coalesce("supplier", F.lit(""))
    offers = offers.select(
        "offer", text.alias("product_id"), F.coalesce(F.nullif("product_name", F.lit("")), text).alias("product_name"), supplier.alias("supplier"), "unit_cost",
        F.greatest(F.floor("capacity_units"), F.lit(1)).alias("had"), F.coalesce("unit_price_sale", F.lit(0.0)).alias("price"),
    )
    seed, lot = stable_int(F.col("product_id"), F.col("supplier")), stable_int(F.col("product_id"), F.col("supplier"), F.lit("lot"))
    offers = offers.withColumn("seed", seed).withColumn("units", F.greatest("had", F.bround((1500 + lot % 3001) / F.greatest("unit_cost", F.lit(0.01)), 0).cast("long")))
    offers = offers.withColumn("base_cost", F.col("unit_cost") * F.col("units")).withColumn("base_revenue", F.when(F.col("price") <= F.col("unit_cost"), F.col("unit_cost") * 1.35).otherwise(F.col("price")) * F.col("units"))
    s, base = F.col("seed"), F.col("base_cost")
    none = F.struct(F.lit(0).alias("alternative"), F.lit("Comprar hoy").alias("campaign"), F.lit(0).cast("long").alias("wait_days"), F.lit(0.0).alias("pct"), F.lit(0.0).alias("coupon_discount"), F.lit("").alias("coupon"))
    variants = [none]
    for k in range(2):
        coupon = F.when((base >= 1500) & ((s + k) % 3 != 0), 60.0 + (F.floor(s / (k + 5)) % 5) * 40.0).otherwise(0.0)
        variants.append(F.struct(
            F.lit(k + 1).alias("alternative"), _pick(CAMPAIGNS, (s + k) % 3).alias("campaign"), (2 + (s + k * 5) % 8).cast("long").alias("wait_days"), (0.03 + (F.floor(s / (k + 3)) % 10) / 100).alias("pct"),
            coupon.alias("coupon_discount"), F.when(coupon > 0, F.concat(F.lit("CUPON"), (10 + (s + k) % 70).cast("string"))).otherwise("").alias("coupon"),
        ))
    out = offers.withColumn("v", F.explode(F.array(*variants))).select("*", "v.*").drop("v")
    out = out.withColumn("wait_cost", F.col("wait_days") * F.greatest(F.lit(70.0), base * 0.022)).withColumn("campaign_discount", base * F.col("pct"))
    out = out.withColumn("final_cost", base + F.col("wait_cost") - F.col("campaign_discount") - F.col("coupon_discount")).withColumn("savings", base - F.col("final_cost"))
    number = F.concat(F.lpad(F.col("offer").cast("string"), 3, "0"), F.lit(":"), F.col("alternative").cast("string"))
    path = F.concat_ws(
        "|", F.lit("SOURCE"), F.concat(F.lit("OFFER:"), F.lpad(F.col("offer").cast("string"), 3, "0")), F.concat(F.lit("DECISION:"), number), F.when(F.col("campaign_discount") > 0, F.concat(F.lit("CAMPAIGN:"), number)),
        F.when(F.col("coupon_discount") > 0, F.concat(F.lit("COUPON:"), number)), F.concat(F.lit("FINAL:"), number),
    )
    return out.select(
        "product_id", "product_name", "supplier", "units", "base_cost", "base_revenue", F.when(F.col("wait_days") > 0, "esperar").otherwise("comprar_hoy").alias("decision"), "campaign", "coupon",
        F.date_add(F.lit(today).cast("date"), F.col("wait_days").cast("int")).cast("string").alias("buy_date"), "wait_days", "wait_cost", "campaign_discount", "coupon_discount", "final_cost", "savings",
        F.try_divide("savings", "base_cost").alias("savings_pct"), F.concat(F.lit("FINAL:"), number).alias("final_node"), path.alias("path"),
    )


def best_campaigns(candidates: DataFrame) -> DataFrame:
    """The cheapest variant, the sooner of equals, of each product and supplier."""
    w = Window.partitionBy("product_id", "supplier").orderBy("final_cost", "wait_days", "final_node")
    return candidates.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def campaign_edges(candidates: DataFrame) -> DataFrame:
    """source, target, weight along every path of the candidates; their sum is the final cost."""
    steps = candidates.select("base_cost", "wait_cost", "campaign_discount", "coupon_discount", F.split("path", r"\|").alias("p"))
    pairs = steps.select("*", F.posexplode(F.slice("p", 2, 100)).alias("i", "target")).withColumn("source", F.col("p")[F.col("i")])
    kind = F.split("target", ":")[0]
    weight = F.when(kind == "OFFER", F.col("base_cost")).when(kind == "DECISION", F.col("wait_cost")).when(kind == "CAMPAIGN", -F.col("campaign_discount")).when(kind == "COUPON", -F.col("coupon_discount")).otherwise(0.0)
    return pairs.select("source", "target", weight.alias("weight")).distinct()


def campaign_trace(best: DataFrame, candidates: DataFrame) -> DataFrame:
    """step, source, target, weight, edge_type along the path of the best row of all: most savings, then share, then its node."""
    first = best.orderBy(F.desc("savings"), F.desc("savings_pct"), "final_node").limit(1)
    edges = campaign_edges(candidates.join(F.broadcast(first.select("final_node")), "final_node", "left_semi"))  # one row
    order = first.select(F.posexplode(F.split("path", r"\|")).alias("step", "target"))
    kind = F.lower(F.split("target", ":")[0])
    return edges.join(F.broadcast(order), "target").select("step", "source", "target", F.round("weight", 4).alias("weight"), kind.alias("edge_type"))


def offers_size(candidates: DataFrame) -> DataFrame:
    """nodes, edges of the campaign graph."""
    edges = campaign_edges(candidates)
    nodes = edges.select("source").union(edges.select("target")).distinct().agg(F.count(F.lit(1)).alias("nodes"))
    return nodes.crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))  # one row each


def allocate(options: DataFrame, demand: DataFrame) -> DataFrame:
    """product_id, supplier_id, unit_cost, units: demand served from the cheapest options, as far as they go.

    Options of one product, supplier and cost are added up. Exact when no supplier's whole capacity binds across products, as is
    always so for options that supply_options() made; check binding_suppliers() for others.
    """
    asked = demand.groupBy("product_id").agg(F.sum("quantity").alias("wanted"))
    own = options.where("unit_cost > 0 and capacity_units > 0").groupBy("product_id", "supplier_id", "unit_cost").agg(F.sum("capacity_units").alias("capacity")).join(asked, "product_id")
    w = Window.partitionBy("product_id").orderBy("unit_cost", "supplier_id").rowsBetween(Window.unboundedPreceding, -1)
    units = F.greatest(F.lit(0.0), F.least(F.col("capacity"), F.col("wanted") - F.coalesce(F.sum("capacity").over(w), F.lit(0.0))))
    return own.withColumn("units", units).where("units > 0").select("product_id", "supplier_id", "unit_cost", "units")


def binding_suppliers(allocation: DataFrame, options: DataFrame) -> DataFrame:
    """Suppliers that an allocation asks for more than their whole capacity."""
    capacity = options.groupBy("supplier_id").agg(F.max("supplier_capacity").alias("supplier_capacity"))
    return allocation.groupBy("supplier_id").agg(F.sum("units").alias("units")).join(capacity, "supplier_id").where("units > supplier_capacity + 1e-9")


#: What a unit may cost above the cheapest plan: refused bids raise a price by it.
EPSILON = 1e-3
_NONE = 1e-9
_ARC = ["product_id", "supplier_id", "unit_cost"]


def min_cost_flow(options: DataFrame, demand: DataFrame, epsilon: float = EPSILON, rounds: list | None = None) -> DataFrame:
    """Cheapest allocation of as much demand as can be served when suppliers' whole capacities may bind across products.

    An auction whose bids and prices are tables. A product with unserved demand takes its cheapest options, at their costs plus the suppliers' prices. Suppliers that
    are asked for all they have or more get a price: what it costs, over any chain of exchanges, to free one of their units (exchange_prices()). A supplier that is asked for more than its whole
    capacity keeps the holdings that would be dearest to serve elsewhere, and its price rises above the dearest one that it gives up; what it gives up is unserved again. The
    first round is allocate(); later ones touch only the products that lost something. A demand may also stay unserved at a cost above any chain of
    exchanges, so as much is served as can be.

    Once nothing is given up, no product would save more than epsilon a unit by exchanging an option for one with room, at prices that are
    zero where a supplier has room: the plan costs at most epsilon a unit more than the cheapest. There is no limit on options, and no part of the problem is
    solved in one task: running sums over a product's options and a supplier's holdings are divided by ranges. ``rounds`` receives the number of holdings given up in each round.

    Defined edge cases: options without cost, capacity or ids and demands that aren't positive are left out; repeated options and demands are added up;
    a supplier without a whole capacity has that of its largest option; ties go to the smaller supplier, then product.
    """
    text = lambda c: F.col(c).cast("string").alias(c)
    asked = materialise(demand.where("product_id is not null").groupBy(text("product_id")).agg(F.sum("quantity").cast("double").alias("unserved")).where(F.col("unserved") > 0))
    known = options.where("unit_cost > 0 and capacity_units > 0 and product_id is not null and supplier_id is not null")
    whole = F.coalesce(F.nullif(F.col("supplier_capacity").cast("double"), F.lit(0.0)), F.col("capacity_units").cast("double"))
    room = materialise(known.groupBy(text("supplier_id")).agg(F.max(whole).alias("room")))
    arcs = materialise(
        known.groupBy(text("product_id"), text("supplier_id"), F.col("unit_cost").cast("double").alias("unit_cost")).agg(F.sum("capacity_units").cast("double").alias("capacity"))
        .join(asked.select("product_id"), "product_id", "left_semi")
    )
    most = arcs.agg(F.max("unit_cost")).first()[0] or 0.0
    never = (most + epsilon) * (room.count() + 2)
    spark = options.sparkSession
    held = materialise(spark.createDataFrame([], "product_id string, supplier_id string, unit_cost double, units double"))
    prices = materialise(spark.createDataFrame([], "supplier_id string, price double"))
    while True:
        taken = _taken(arcs, held, prices, asked, never)
        held, old = materialise(held.unionByName(taken).groupBy(*_ARC).agg(F.sum("units").alias("units"))), held
        discard(old, asked)
        full = materialise(held.groupBy("supplier_id").agg(F.sum("units").alias("load")).join(room, "supplier_id").where(F.col("load") >= F.col("room") - _NONE))
        over = full.where(F.col("load") > F.col("room") + _NONE)
        if not over.head(1):
            discard(full)
            break
        prices, old = exchange_prices(arcs, held, prices, full, never), prices
        discard(old)
        # a supplier's holdings, those first that would be dearest elsewhere, as far as its capacity goes
        bids = _without(arcs, held, held.join(over.select("supplier_id"), "supplier_id", "left_semi"), prices, never).withColumn("bid", F.col("other") - F.col("unit_cost"))
        judged = running(bids.join(over.select("supplier_id", "room"), "supplier_id"), ["supplier_id"], [F.desc("bid"), "product_id", "unit_cost"], {"before": "units"})
        judged = materialise(judged.withColumn("kept", F.least(F.greatest(F.col("room") - F.col("before"), F.lit(0.0)), F.col("units"))))
        given_up = judged.where(F.col("units") - F.col("kept") > _NONE)
        raised = given_up.groupBy("supplier_id").agg((F.max("bid") + epsilon).alias("price"))
        prices, old = materialise(prices.union(raised).groupBy("supplier_id").agg(F.max("price").alias("price"))), prices
        asked = materialise(given_up.groupBy("product_id").agg(F.sum(F.col("units") - F.col("kept")).alias("unserved")))
        if rounds is not None:
            rounds.append(given_up.count())
        held, before = materialise(held.join(over.select("supplier_id"), "supplier_id", "left_anti").unionByName(judged.where(F.col("kept") > _NONE).select(*_ARC, F.col("kept").alias("units")))), held
        discard(old, before, judged, full)
    return held.where(F.col("units") > _NONE).select("product_id", "supplier_id", "unit_cost", "units")


def _open(arcs: DataFrame, held: DataFrame, prices: DataFrame) -> DataFrame:
    """Options with what is free of them and their value: cost plus the supplier's price."""
    rows = arcs.join(held, _ARC, "left").na.fill(0.0, ["units"]).join(prices, "supplier_id", "left")
    return rows.select(*_ARC, (F.col("capacity") - F.col("units")).alias("free"), (F.col("unit_cost") + F.coalesce("price", F.lit(0.0))).alias("value")).where(F.col("free") > _NONE)


def _taken(arcs: DataFrame, held: DataFrame, prices: DataFrame, asked: DataFrame, never: float) -> DataFrame:
    """What products with unserved demand take of their cheapest open options."""
    mine = arcs.join(asked.select("product_id"), "product_id", "left_semi")
    rows = running(_open(mine, held, prices).where(F.col("value") <= never).join(asked, "product_id"), ["product_id"], ["value", "supplier_id", "unit_cost"], {"before": "free"})
    return rows.withColumn("units", F.least(F.greatest(F.col("unserved") - F.col("before"), F.lit(0.0)), F.col("free"))).where(F.col("units") > 0).select(*_ARC, "units")


def _without(arcs: DataFrame, held: DataFrame, some: DataFrame, prices: DataFrame, never: float) -> DataFrame:
    """``some`` of the holdings with ``other``: the least value at which the product could have a unit from another supplier, or go without it."""
    open_ = _open(arcs.join(some.select("product_id").distinct(), "product_id", "left_semi"), held, prices)
    by_supplier = materialise(open_.groupBy("product_id", "supplier_id").agg(F.min("value").alias("value")))
    first = by_supplier.groupBy("product_id").agg(F.min(F.struct("value", "supplier_id")).alias("first"))
    second = by_supplier.join(first, "product_id").where(F.col("supplier_id") != F.col("first.supplier_id")).groupBy("product_id").agg(F.min("value").alias("second"))
    rows = some.join(first, "product_id", "left").join(second, "product_id", "left")
    other = F.when(F.col("first.supplier_id") == F.col("supplier_id"), F.col("second")).otherwise(F.col("first.value"))
    return rows.select(*some.columns, F.least(F.coalesce(other, F.lit(never)), F.lit(never)).alias("other"))


def exchange_prices(arcs: DataFrame, held: DataFrame, prices: DataFrame, full: DataFrame, never: float) -> DataFrame:
    """The prices, raised where ``full`` suppliers' units are dearer to free: shortest chains of exchanges that end at a supplier with room.

    An exchange moves a unit from a held option to an open one of the same product. Distances shrink from ``never``, and each round reads only the holdings whose product could move to a supplier
    that came nearer in the round before; so there are as many rounds as the longest of the shortest chains has exchanges.
    """
    mine = materialise(held.join(full.select("supplier_id"), "supplier_id", "left_semi"))
    near = materialise(full.select("supplier_id", F.lit(never).alias("price")))
    moved: DataFrame | None = None
    while True:
        some = mine
        if moved is not None:
            some = mine.join(arcs.join(moved, "supplier_id", "left_semi").select("product_id").distinct(), "product_id", "left_semi")
        reached = _without(arcs, held, some, near, never).groupBy("supplier_id").agg(F.greatest(F.min(F.col("other") - F.col("unit_cost")), F.lit(0.0)).alias("new"))
        new = materialise(near.join(reached, "supplier_id", "left").select("supplier_id", F.least("price", F.coalesce("new", "price")).alias("price"), (F.coalesce("new", "price") < F.col("price") - _NONE).alias("moved")))
        if moved is not None:
            discard(moved)
        moved = materialise(new.where("moved").select("supplier_id"))
        discard(near)
        near = new.drop("moved")
        near._table = new._table
        if not moved.head(1):
            break
    out = materialise(prices.union(near).groupBy("supplier_id").agg(F.max("price").alias("price")))
    discard(near, moved, mine)
    return out


def flow_lines(allocation: DataFrame, options: DataFrame) -> DataFrame:
    """product_id, product_name, supplier_id, supplier, units, unit_cost, line_cost of an allocation."""
    names = options.groupBy(F.col("product_id").cast("string").alias("product_id"), F.col("supplier_id").cast("string").alias("supplier_id")).agg(F.min("product_name").alias("product_name"), F.min("supplier").alias("supplier"))
    keyed = allocation.withColumn("product_id", F.col("product_id").cast("string")).withColumn("supplier_id", F.col("supplier_id").cast("string"))
    return keyed.join(names, ["product_id", "supplier_id"], "left").select("product_id", "product_name", "supplier_id", "supplier", "units", "unit_cost", (F.col("units") * F.col("unit_cost")).alias("line_cost"))


def flow_unmet(allocation: DataFrame, demand: DataFrame) -> DataFrame:
    """product_id, requested, served, shortfall of the products that are not served whole."""
    asked = demand.groupBy(F.col("product_id").cast("string").alias("product_id")).agg(F.sum("quantity").alias("requested"))
    got = allocation.groupBy(F.col("product_id").cast("string").alias("product_id")).agg(F.sum("units").alias("served"))
    rows = asked.join(got, "product_id", "left").na.fill(0.0, ["served"])
    return rows.where("served < requested - 1e-9").select("product_id", "requested", "served", (F.col("requested") - F.col("served")).alias("shortfall"))


def flow_totals(allocation: DataFrame, demand: DataFrame) -> DataFrame:
    """One row: demand_units, served_units, total_cost, suppliers_used, unmet_products."""
    served = allocation.agg(F.coalesce(F.sum("units"), F.lit(0.0)).alias("served_units"), F.coalesce(F.round(F.sum(F.col("units") * F.col("unit_cost")), 2), F.lit(0.0)).alias("total_cost"), F.countDistinct("supplier_id").alias("suppliers_used"))
    asked = demand.agg(F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("demand_units"))
    missing = flow_unmet(allocation, demand).agg(F.count(F.lit(1)).alias("unmet_products"))
    return served.crossJoin(asked).crossJoin(missing).select("demand_units", "served_units", "total_cost", "suppliers_used", "unmet_products")  # one row each


def flow_network(allocation: DataFrame, options: DataFrame, demand: DataFrame) -> DataFrame:
    """source, target, capacity, unit_cost, flow of every edge from SOURCE over products and suppliers to SINK, used or not."""
    product, supplier = F.concat(F.lit("P:"), F.col("product_id").cast("string")), F.concat(F.lit("S:"), F.col("supplier_id").cast("string"))
    asked = demand.groupBy(product.alias("p")).agg(F.sum("quantity").cast("double").alias("capacity"))
    flow = allocation.groupBy(product.alias("p"), supplier.alias("s"), "unit_cost").agg(F.sum("units").alias("flow"))
    own = options.where("unit_cost > 0 and capacity_units > 0").select(product.alias("p"), supplier.alias("s"), "unit_cost", "capacity_units", "supplier_capacity").join(asked.select("p"), "p", "left_semi")
    offers = own.groupBy("p", "s", "unit_cost").agg(F.sum("capacity_units").alias("capacity")).join(flow, ["p", "s", "unit_cost"], "left")
    into = asked.join(flow.groupBy("p").agg(F.sum("flow").alias("flow")), "p", "left").select(F.lit("SOURCE").alias("source"), F.col("p").alias("target"), "capacity", F.lit(0.0).alias("unit_cost"), "flow")
    out = own.groupBy("s").agg(F.max("supplier_capacity").alias("capacity")).join(flow.groupBy("s").agg(F.sum("flow").alias("flow")), "s", "left").select("s", F.lit("SINK"), "capacity", F.lit(0.0), "flow")
    return into.union(offers.select("p", "s", "capacity", "unit_cost", "flow")).union(out).na.fill(0.0, ["flow"])


def flow_steps(allocation: DataFrame, demand: DataFrame) -> DataFrame:
    """step, product_id, supplier_id, delta_units, unit_cost, step_cost, cumulative_cost, demand_remaining: the order in which cheapest paths serve a demand
    where no supplier binds, which is by unit cost."""
    asked = demand.groupBy("product_id").agg(F.sum("quantity").alias("wanted"))
    own = Window.partitionBy("product_id").orderBy("unit_cost", "supplier_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = allocation.join(asked, "product_id").select("product_id", "supplier_id", F.col("units").alias("delta_units"), "unit_cost", (F.col("units") * F.col("unit_cost")).alias("cost"), (F.col("wanted") - F.sum("units").over(own)).alias("demand_remaining"))
    placed = materialise(numbered(rows, "step", "unit_cost", "product_id", "supplier_id"))
    # running sums within runs of steps, behind the sums of the runs before
    run = F.floor(F.col("step") / RUN)
    before = placed.groupBy(run.alias("run")).agg(F.sum("cost").alias("c")).select("run", (F.sum("c").over(Window.orderBy("run")) - F.col("c")).alias("before"))
    inside = F.sum("cost").over(Window.partitionBy("run").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    summed = placed.withColumn("run", run).withColumn("inside", inside).join(before, "run")
    return summed.select("step", "product_id", "supplier_id", "delta_units", "unit_cost", F.col("cost").alias("step_cost"), (F.col("before") + F.col("inside")).alias("cumulative_cost"), "demand_remaining")


def budget_lots(options: DataFrame, items: DataFrame, budget: float, sale_prices: DataFrame) -> DataFrame:
    """At most MAX_LOTS indivisible lots for a 0/1 budget: the two cheapest offers of each requested product.

    ``items`` has product_id and quantity, ``sale_prices`` product_id, product_name and unit_price_sale. A product with one offer
    gets a second at 1.09 times its cost; one without offers two at 0.65 of its price (or 1.0) and 1.08 times that.
    """
    text = F.col("product_id").cast("string")
    asked = items.groupBy(text.alias("product_id")).agg(F.max(F.floor(F.greatest("quantity", F.lit(0)))).alias("quantity"))
    known = sale_prices.select(text.alias("product_id"), "product_name", F.coalesce("unit_price_sale", F.lit(0.0)).alias("price"))
    asked = asked.join(known, "product_id", "left").withColumn("price", F.coalesce("price", F.lit(0.0))).withColumn("product_name", F.coalesce("product_name", "product_id"))
    had = F.greatest(F.floor("capacity_units"), F.lit(1)).cast("long")
    real = options.where("unit_cost > 0 and capacity_units > 0").select(text.alias("product_id"), "supplier", "unit_cost", had.alias("had")).join(asked.select("product_id"), "product_id", "left_semi")
    real = real.select("product_id", supplier_name(F.col("product_id"), F.col("supplier"), F.col("unit_cost")).alias("supplier"), "unit_cost", "had")
    w = Window.partitionBy("product_id")
    counted = real.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy("unit_cost", "supplier")))
    second = counted.where("n = 1").select("product_id", supplier_name(F.col("product_id"), F.lit("Cotizacion alternativa"), F.col("unit_cost"), F.col("supplier")).alias("supplier"), (F.col("unit_cost") * 1.09).alias("unit_cost"), "had")
    none = asked.join(real.select("product_id").distinct(), "product_id", "left_anti").withColumn("base", F.when(F.col("price") > 0, F.col("price") * 0.65).otherwise(1.0))
    first_name = supplier_name(F.col("product_id"), F.lit(""), F.lit("fallback-a"))
    made = none.select("product_id", F.explode(F.array(
        F.struct(first_name.alias("supplier"), F.col("base").alias("unit_cost")), F.struct(supplier_name(F.col("product_id"), F.lit(""), F.lit("fallback-b"), first_name).alias("supplier"), (F.col("base") * 1.08).alias("unit_cost")),
    )).alias("x")).select("product_id", "x.supplier", "x.unit_cost", F.lit(1000).cast("long").alias("had"))
    offers = counted.where("_r <= 2").select("product_id", "supplier", "unit_cost", "had").union(second).union(made).join(asked, "product_id")
    profile = F.pmod(stable_int(F.col("product_id"), F.col("supplier"), F.lit("knapsack_lot")), F.lit(6))
    margin = stable_int(F.col("product_id"), F.col("supplier"), F.lit("margin"))
    if budget >= SCALED_BUDGET:
        offers = offers.withColumn("margin", _pick(MARGINS, profile) + (margin % 7) / 100)
        scaled = F.bround(F.greatest(F.lit(450.0), F.lit(float(budget)) * _pick(BUDGET_SHARES, profile)) / F.greatest("unit_cost", F.lit(0.01)), 0).cast("long")
        own = F.greatest(F.lit(1).cast("long"), scaled)
    else:
        offers = offers.withColumn("margin", 0.18 + (margin % 24) / 100)
        own = F.col("had")
    lots = offers.withColumn("units", F.when(F.col("quantity") > 0, F.col("quantity").cast("long")).otherwise(own)).withColumn("cost", F.col("unit_cost") * F.col("units"))
    lots = lots.withColumn("value", F.col("cost") * F.col("margin")).where("cost > 0 and value > 0").orderBy("cost", F.desc("value"), "supplier", "product_id").limit(MAX_LOTS)
    return lots.select(
        F.row_number().over(Window.orderBy("cost", F.desc("value"), "supplier", "product_id")).alias("lot"), "product_id", "product_name", "supplier", "units", package_label(F.col("units")).alias("package_label"), "unit_cost",
        "cost", (F.col("cost") + F.col("value")).alias("revenue"), "value",
    )


def best_subset(lots: DataFrame, budget: float) -> DataFrame:
    """Lots with ``selected``: the subset of most value within the budget, in cents; the smallest mask of equals.

    Twelve lots have 4096 subsets, so all are weighed in one aggregation.
    """
    cents = F.bround(F.col("cost") * 100, 0).cast("long")
    masks = lots.sparkSession.range(1 << MAX_LOTS).withColumnRenamed("id", "mask")
    chosen = lots.select((F.col("lot") - 1).alias("bit"), cents.alias("cents"), "value")
    pairs = masks.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(MAX_LOTS - 1)))).where("getbit(mask, bit) = 1").join(F.broadcast(chosen), "bit")
    weighed = pairs.groupBy("mask").agg(F.sum("cents").alias("cents"), F.sum("value").alias("value")).where(F.col("cents") <= round(max(budget, 0) * 100))
    best = weighed.agg(F.max_by("mask", F.struct(F.round("value", 6), -F.col("mask"))).alias("mask"))
    return lots.join(F.broadcast(best), F.lit(True), "left").withColumn("selected", F.coalesce(F.expr("getbit(mask, lot - 1) = 1"), F.lit(False))).drop("mask")  # one row


#: Kinds of units that are weighed first, those whose worth for their cost is nearest to the break.
NEAR_KINDS = 128


def _bundles(kinds: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind, cents and value of bundles of 1, 2, 4, ... units, most worth for their cost first."""
    ranked = kinds.reset_index(drop=True).assign(_d=lambda k: -k["value"] / k["cents"]).sort_values(["_d", "cents"])
    out = []
    for i, r in zip(ranked.index, ranked.itertuples(), strict=True):
        left, size = int(r.n), 1
        while left > 0:
            take = min(left, size)
            out.append((i, int(r.cents) * take, r.value * take))
            left, size = left - take, size * 2
    kind, cents, value = zip(*out, strict=True) if out else ((), (), ())
    return np.array(kind, np.int64), np.array(cents, np.int64), np.array(value, float)


def best_bundles(cents: np.ndarray, value: np.ndarray, room: int, floor: float = 0.0) -> np.ndarray:
    """Which bundles (most worth for their cost first) have most value within ``room``, at the least cost of equals; exact if that value is ``floor`` or more.

    Sums that cost no less and are worth no more than others are dropped, as are those which can't reach ``floor`` even if the rest were divisible. Only
    the sums of one step are held, at most ``room`` + 1; what was taken is found by halving: a sum remembers its cost and value at the middle bundle, and both halves
    are done again for these.
    """
    picked = np.zeros(len(cents), bool)
    open_parts = [(0, len(cents), int(room), float(floor))]
    while open_parts:
        a, b, room, floor = open_parts.pop()
        slack = 1e-9 * max(1.0, abs(floor))
        ahead_cost, ahead_value = np.concatenate(([0], np.cumsum(cents[a:b]))), np.concatenate(([0.0], np.cumsum(value[a:b])))
        middle = (a + b) // 2
        cost, worth = np.zeros(1, np.int64), np.zeros(1)
        half = np.zeros((1, 2))
        for k in range(a, b):
            if k == middle:
                half = np.stack((cost, worth), 1).astype(float)
            more = cost + cents[k] <= room
            if more.any():
                cost, worth, half = np.concatenate((cost, cost[more] + cents[k])), np.concatenate((worth, worth[more] + value[k])), np.concatenate((half, half[more]))
                order = np.lexsort((-worth, cost))
                cost, worth, half = cost[order], worth[order], half[order]
            # what the bundles behind this one are worth if the last one may be cut
            left = room - cost + ahead_cost[k + 1 - a]
            j = np.searchsorted(ahead_cost, left, "right") - 1
            whole = np.minimum(j, b - a)
            rest = np.where(whole < b - a, (left - ahead_cost[whole]) * value[np.minimum(a + whole, b - 1)] / cents[np.minimum(a + whole, b - 1)], 0.0)
            keep = worth > np.concatenate(([-1.0], np.maximum.accumulate(worth)[:-1])) + slack
            keep &= worth + ahead_value[whole] - ahead_value[k + 1 - a] + rest >= floor - slack
            cost, worth, half = cost[keep], worth[keep], half[keep]
        if not len(cost):
            raise ValueError("no choice is worth the given floor")
        if b - a == 1:
            picked[a] = cost[-1] > 0
        elif b > a:
            at, had = int(half[-1][0]), float(half[-1][1])
            open_parts += [(a, middle, at, had), (middle, b, int(cost[-1]) - at, float(worth[-1]) - had)]
    return picked


def _taken_of_core(kinds: DataFrame, room: int, floor: float) -> DataFrame:
    """cents, value, take of the kinds of a core, which one task weighs."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kind, cents, value = _bundles(rows)
        picked = best_bundles(cents, value, room, floor)
        size = np.rint(cents / rows["cents"].to_numpy()[kind]).astype(np.int64) if len(kind) else kind
        take = np.bincount(kind[picked], size[picked], len(rows)).astype(np.int64)
        return pd.DataFrame({"cents": rows["cents"].to_numpy(), "value": rows["value"].to_numpy(), "take": take})

    return kinds.select("cents", "value", "n", F.lit(0).alias("_core")).groupBy("_core").applyInPandas(run, "cents long, value double, take long")


def best_kinds(kinds: DataFrame, room: int, near: int = NEAR_KINDS) -> DataFrame:
    """cents, value, take: how many of the ``n`` units of each kind (cents, value, both positive) have most value within ``room`` cents.

    Kinds are sorted by worth for their cost, by ranges; units are taken up to the break, where they no longer fit. With a divisible unit there, that is the upper bound. A kind whose
    units' worth is off the break's rate by more than the bound exceeds a known choice, divided by the units changed, can't be changed by so many units (the bound test), so nearly all kinds are
    fixed where they are. The known choice is the best one that changes only the ``near`` kinds nearest to the break; mostly it meets the bound or proves that no other kind matters. Else what the
    bound test leaves, the core, is weighed exactly, with memory for the core's sums.
    """
    worth = F.col("value") / F.col("cents")
    rows = materialise(running(kinds.withColumn("_all", F.lit(0)), ["_all"], [worth.desc(), "cents", "value"], {"cost": F.col("n") * F.col("cents"), "worth": F.col("n") * F.col("value")}).drop("_all"))
    first = rows.where(F.col("cost") + F.col("n") * F.col("cents") > room).orderBy("cost").limit(1).collect()
    if not first:
        return rows.select("cents", "value", F.col("n").alias("take"))
    at = first[0]
    rate = at["value"] / at["cents"]
    bound = at["worth"] + (room - at["cost"]) * rate
    slack = 1e-9 * max(1.0, bound)
    before = F.col("cost") < at["cost"]
    off = F.abs(F.col("value") - F.col("cents") * rate)
    rows = rows.withColumns({"inside": before, "off": off})

    def solved(core: DataFrame, floor: float) -> tuple[DataFrame, float]:
        """All kinds with what is taken if only ``core`` (kinds with n and ``free`` units that may change) is weighed, and its value."""
        core = materialise(core)
        base = core.agg(F.sum(F.when(F.col("inside"), F.col("free") * F.col("cents"))).alias("c"), F.sum(F.when(F.col("inside"), F.col("free") * F.col("value"))).alias("v")).first()
        left, fixed = room - at["cost"] + (base["c"] or 0), at["worth"] - (base["v"] or 0.0)
        took = materialise(_taken_of_core(core.select("cents", "value", F.col("free").alias("n")), left, floor - fixed - slack))
        out = rows.join(core.select("cents", "value", "free"), ["cents", "value"], "left").join(took, ["cents", "value"], "left").na.fill(0, ["free", "take"])
        out = materialise(out.select("cents", "value", (F.when(F.col("inside"), F.col("n") - F.col("free")).otherwise(0) + F.col("take")).alias("take")))
        got = took.agg(F.sum(F.col("take") * F.col("value"))).first()[0] or 0.0
        discard(core, took)
        return out, fixed + got

    nearest = materialise(rows.orderBy("off", "cents", "value").limit(near).withColumn("free", F.col("n")))
    # greedy: whole units of the break's kind behind all before it
    known = at["worth"] + ((room - at["cost"]) // at["cents"]) * at["value"]
    chosen, value = solved(nearest, known)
    gap = max(bound - value, 0.0) + slack
    if gap > 2 * slack:
        free = F.when(F.col("off") * F.col("n") <= gap, F.col("n")).otherwise(F.floor(gap / F.col("off")))
        core = materialise(rows.withColumn("free", free.cast("long")).where("free > 0"))
        if core.join(nearest.select("cents", "value"), ["cents", "value"], "left_anti").head(1):
            chosen, value = solved(core, value)
    return chosen.where("take > 0")


def catalog_budget(products: DataFrame, items: DataFrame, budget: float) -> DataFrame:
    """product_id, units, cost, value within a budget, from catalogue prices alone (1.0 where there is none).

    The most value that the budget buys, at the least cost of equals; of units with equal cents and value the smaller product ids are taken. Requests may be of any size, and
    so may the budget: see best_kinds().

    Defined edge cases: a quantity below one is one; a product without a value is worth its quantity; rows worth nothing or less are never taken; repeated rows
    of a product are rows of their own, each within the stock; what costs no cents is taken whole; a budget below zero is zero.
    """
    text = F.col("product_id").cast("string")
    known = products.select(text.alias("product_id"), "stock", "unit_cost_purchase").dropDuplicates(["product_id"])
    quantity = F.floor(F.greatest(F.coalesce("quantity", F.lit(1.0)), F.lit(1.0)))
    rows = items.select(text.alias("product_id"), quantity.alias("quantity"), F.coalesce(F.nullif("value", F.lit(0.0)), quantity.cast("double")).alias("value")).join(known, "product_id", "left")
    catalog = F.coalesce("unit_cost_purchase", F.lit(0.0))
    stock = F.floor(F.greatest(F.coalesce(F.nullif("stock", F.lit(0.0)), F.col("quantity").cast("double")), F.lit(1.0)))
    rows = materialise(rows.select("product_id", F.least("quantity", stock).alias("n"), (F.col("value") / F.col("quantity")).alias("value"), catalog.alias("catalog_cost"), F.when(catalog > 0, catalog).otherwise(1.0).alias("unit_cost")))
    scale = 100 if rows.where("catalog_cost > 0").head(1) else 1
    room = int(max(budget, 0) * scale)
    units = rows.withColumn("cents", F.bround(F.col("unit_cost") * scale, 0).cast("long")).where((F.col("value") > 0) & (F.col("cents") <= room)).select("product_id", "unit_cost", "cents", "value", "n")
    units = materialise(units)
    kinds = units.where("cents > 0").groupBy("cents", "value").agg(F.sum("n").alias("n"))
    chosen = best_kinds(kinds, room)
    placed = running(units.join(chosen, ["cents", "value"]), ["cents", "value"], ["product_id", "unit_cost"], {"before": "n"})
    taken = placed.withColumn("n", F.least(F.greatest(F.col("take") - F.col("before"), F.lit(0)), F.col("n"))).select("product_id", "unit_cost", "value", "n")
    taken = taken.union(units.where("cents = 0").select("product_id", "unit_cost", "value", "n")).where("n > 0")
    return taken.groupBy("product_id").agg(F.sum("n").alias("units"), F.sum(F.col("n") * F.col("unit_cost")).alias("cost"), F.sum(F.col("n") * F.col("value")).alias("value"))


def optimise_budget(options: DataFrame | None, products: DataFrame, items: DataFrame, budget: float) -> DataFrame:
    """Lots where there are supply options, catalogue units otherwise."""
    if options is None:
        return catalog_budget(products, items, budget)
    return best_subset(budget_lots(options, items, budget, products), budget)
