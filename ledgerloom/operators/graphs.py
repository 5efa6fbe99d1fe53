"""Property graphs as node and edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.geo import haversine_km
from ..functions.text import attr_node_id, format_g, split_values
from ..plans.tables import BROADCAST_ROWS, materialise, numbered

MIN_ATTRIBUTE_CONFIDENCE = 0.75
#: Suppliers of one product in a row of numbers, and most suppliers of a block.
PROJECTED, BLOCK = 1000, 256
#: layer -> (node type, column, confidence key)
LAYERS = {
    "product_type": ("TYPE", "product_type"), "subtype": ("SUBTYPE", "subtype"), "accessory": ("ACCESSORY", "accessory"), "shape": ("SHAPE", "shape"), "feature": ("FEATURE", "feature"),
    "material": ("MATERIAL", "material"), "color": ("COLOR", "color"), "capacity": ("CAPACITY", "capacity_text"), "mouth_size": ("MOUTH_SIZE", "mouth_size_text"),
}


def semantic_graph(attributes: DataFrame, sold: DataFrame, min_confidence: float = MIN_ATTRIBUTE_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) between products and the values of their attributes; several values of one are split.

    ``sold`` has product_id and sold_units.
    """
    texts = attributes.withColumn("capacity_text", F.concat(format_g(F.col("capacity_value")), F.upper("capacity_unit"))).withColumn("mouth_size_text", F.concat(format_g(F.col("mouth_size_mm")), F.lit("MM")))
    layers = F.array(*(
        F.struct(F.lit(kind).alias("node_type"), F.lit(f"has_{name}").alias("edge_type"), F.col(column).cast("string").alias("value"), F.coalesce(F.try_element_at("attribute_confidence", F.lit(name)), F.col("confidence")).alias("weight"))
        for name, (kind, column) in LAYERS.items()
    ))
    cut = texts.select(F.concat(F.lit("PRODUCT:"), F.col("product_id").cast("string")).alias("source"), F.explode(F.filter(layers, lambda x: x["value"].isNotNull() & (x["weight"] >= min_confidence))).alias("l"))
    edges = cut.select("source", "l.node_type", "l.edge_type", F.round("l.weight", 4).alias("weight"), F.explode(split_values(F.col("l.value"))).alias("label"))
    edges = edges.withColumn("target", attr_node_id(F.col("node_type"), F.col("label")))
    product_nodes = attributes.join(sold, "product_id", "left").select(F.concat(F.lit("PRODUCT:"), F.col("product_id").cast("string")).alias("node_id"), F.lit("PRODUCT").alias("node_type"), F.col("product_name").alias("label"), F.coalesce("sold_units", F.lit(0.0)).alias("units_sold"))
    values = edges.groupBy(F.col("target").alias("node_id"), "node_type").agg(F.min("label").alias("label")).withColumn("units_sold", F.lit(0.0))
    return product_nodes.union(values), edges.select("source", "target", "edge_type", "weight")


def transaction_graph(lines: DataFrame, entity_type: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): entity to product for each line, and where a document is known entity to document to product."""
    keyed = lines.select(
        F.concat(F.lit(f"{entity_type}:"), F.col("entity_norm")).alias("e"), F.concat(F.lit("PRODUCT:"), F.col("product_id").cast("string")).alias("p"),
        F.when(F.trim(F.col("document").cast("string")) != "", F.concat(F.lit("DOC:"), F.col("document").cast("string"))).alias("d"),
        F.col("entity_name").alias("e_label"), F.col("product_name").alias("p_label"), F.col("document").cast("string").alias("d_label"), F.col("quantity").alias("weight"), F.col("total").alias("amount"),
    )
    edge = lambda s, t, kind: F.struct(F.col(s).alias("source"), F.col(t).alias("target"), F.lit(kind).alias("edge_type"), F.col("weight"), F.col("amount"))
    edges = keyed.select(F.explode(F.array(edge("e", "p", name), edge("e", "d", f"{name}_document"), edge("d", "p", f"{name}_line"))).alias("x")).select("x.*").where("source is not null and target is not null")
    node = lambda i, kind, label: F.struct(F.col(i).alias("node_id"), F.lit(kind).alias("node_type"), F.col(label).alias("label"))
    nodes = keyed.select(F.explode(F.array(node("e", entity_type, "e_label"), node("p", "PRODUCT", "p_label"), node("d", "DOCUMENT", "d_label"))).alias("x")).select("x.*").where("node_id is not null")
    return nodes.groupBy("node_id", "node_type").agg(F.max("label").alias("label")), edges


def transaction_kinds(lines: DataFrame, entity_type: str) -> tuple[dict[str, DataFrame], dict[tuple[str, str], DataFrame]]:
    """The same graph by kinds: ({node type: nodes}, {(source type, target type): edges}), edges with source, target and amount.

    Each kind reads its own columns of the lines, which should be a table, so a search leaves out kinds that it doesn't ask for, and makes the id of a node only of rows that it has found.
    """
    text = {entity_type: F.col("entity_norm"), "PRODUCT": F.col("product_id").cast("string"), "DOCUMENT": F.col("document").cast("string")}
    label = {entity_type: F.col("entity_name"), "PRODUCT": F.col("product_name"), "DOCUMENT": text["DOCUMENT"]}
    known = {k: F.trim(v) != "" if k == "DOCUMENT" else v.isNotNull() for k, v in text.items()}
    # without nulls, so that no plan tests the text that is put together
    ident = {k: F.coalesce(F.concat(F.lit("DOC:" if k == "DOCUMENT" else f"{k}:"), v), F.lit("")) for k, v in text.items()}
    named = {k: lines.where(known[k]).select(ident[k].alias("node_id"), label[k].alias("label")).distinct() for k in text}  # few rows are left to be sorted for the greatest label
    nodes = {k: n.groupBy("node_id").agg(F.max("label").alias("label")).select("node_id", F.lit(k).alias("node_type"), "label") for k, n in named.items()}
    ways = ((entity_type, "PRODUCT"), (entity_type, "DOCUMENT"), ("DOCUMENT", "PRODUCT"))
    return nodes, {(a, b): lines.where(known[a] & known[b]).select(ident[a].alias("source"), ident[b].alias("target"), F.col("total").alias("amount")) for a, b in ways}


def transaction_links(lines: DataFrame, entity_type: str) -> DataFrame:
    """(source, target) of edges that hang a transaction graph together as all its edges do: a line's document and product meet in its entity, where that is known."""
    whole, unnamed = transaction_kinds(lines, entity_type)[1], transaction_kinds(lines.where("entity_norm is null"), entity_type)[1]
    rows = [whole[entity_type, "PRODUCT"], whole[entity_type, "DOCUMENT"], unnamed["DOCUMENT", "PRODUCT"]]
    return reduce(DataFrame.union, [r.select("source", "target") for r in rows])


def kind_of(node) -> Column:
    """The type of a node of a transaction graph, with which its id begins."""
    kind = F.substring_index(node, ":", 1)
    return F.when(kind == "DOC", "DOCUMENT").otherwise(kind)


def business_graph(sale: tuple[DataFrame, DataFrame], purchase: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Both transaction graphs in one; where both know a node, the sales' label stays."""
    nodes = sale[0].withColumn("_r", F.lit(0)).union(purchase[0].withColumn("_r", F.lit(1)))
    first = nodes.groupBy("node_id").agg(F.min_by(F.struct("node_type", "label"), "_r").alias("x")).select("node_id", "x.*")
    return first, sale[1].union(purchase[1])


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct (source, target) both ways."""
    one = edges.select("source", "target")
    return one.union(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).where("source <> target").distinct()


def linked_pairs(edges: DataFrame) -> DataFrame:
    """Distinct (source, target), the smaller node first: what the size of a graph needs of its edges."""
    return edges.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct()


def graph_metrics(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """metric, n: nodes, distinct undirected edges, and nodes by type."""
    pairs = linked_pairs(edges)
    return (
        nodes.groupBy(F.concat(F.lit("nodes_"), "node_type").alias("metric")).agg(F.count(F.lit(1)).alias("n"))
        .union(nodes.agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes"), "n")).union(pairs.agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges"), "n"))
        .select(F.lit(name).alias("graph"), "metric", "n")
    )


def supplier_projection(purchases: DataFrame, min_similarity: float = 0.05, min_shared: int = 2) -> DataFrame:
    """Pairs of suppliers by Jaccard similarity of the sets of products that they sold to us.

    Only pairs that share a product are formed, and none of them before the shuffle: suppliers are numbered in their order, and a block of these gets a product's suppliers once, as
    one row of numbers, however many of them are in the block. The suppliers of a product with more than PROJECTED are dealt out to several rows, so none grows with them.
    """
    sold = purchases.select(F.col("entity_norm").alias("s"), "product_id").where("s is not null and product_id is not null").distinct()
    sold = materialise(sold)
    names = materialise(numbered(sold.groupBy("s").agg(F.count(F.lit(1)).alias("n")), "i", "s").select("s", "n", F.col("i").cast("int").alias("i")))
    suppliers = names.count()
    few = F.broadcast if suppliers <= BROADCAST_ROWS else lambda df: df
    block = max(1, min(BLOCK, suppliers // int(purchases.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = materialise(sold.join(few(names.select("s", "i")), "s").select("product_id", "i"))
    parts = rows.groupBy("product_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("product_id", F.ceil(F.col("n") / PROJECTED).cast("int").alias("parts"))
    dealt = rows.join(parts, "product_id")
    own = dealt.groupBy("product_id", (F.col("i") / block).cast("int").alias("block")).agg(F.collect_list("i").alias("sources"), F.first("parts").alias("parts"))
    own = own.select("product_id", "block", "sources", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    other = dealt.groupBy("product_id", F.pmod(F.xxhash64("i"), F.col("parts")).cast("int").alias("part")).agg(F.sort_array(F.collect_list("i")).alias("targets"))
    sent = own.join(other, ["product_id", "part"]).select("block", "sources", F.expr("filter(targets, t -> t > array_min(sources))").alias("targets")).where("size(targets) > 0")
    pairs = sent.repartition("block").select("block", F.explode("sources").alias("a"), "targets").select("block", "a", F.explode("targets").alias("b")).where("a < b")
    shared = pairs.groupBy("block", "a", "b").agg(F.count(F.lit(1)).alias("shared_products")).where(F.col("shared_products") >= min_shared)
    ends = [few(names.select(F.col("i").alias(k), F.col("s").alias(end), F.col("n").alias(f"{end}_product_count"))) for k, end in (("a", "source"), ("b", "target"))]
    out = shared.join(ends[0], "a").join(ends[1], "b").select("target", "source", "shared_products", "source_product_count", "target_product_count")
    similarity = F.col("shared_products") / (F.col("source_product_count") + F.col("target_product_count") - F.col("shared_products"))
    out = out.withColumn("source_coverage", F.col("shared_products") / F.col("source_product_count")).withColumn("target_coverage", F.col("shared_products") / F.col("target_product_count"))
    return out.withColumn("similarity", similarity).where(F.col("similarity") >= min_similarity)


def cap_by_degree(nodes: DataFrame, edges: DataFrame, cap: int = 200) -> tuple[DataFrame, DataFrame]:
    """The ``cap`` nodes with most neighbours (the drawing limit) and the edges between them."""
    top = undirected(edges).groupBy(F.col("source").alias("node_id")).agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "node_id").limit(cap)
    ids = F.broadcast(top.select("node_id"))  # cap rows
    inside = edges.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi")
    return nodes.join(F.broadcast(top), "node_id"), inside


def flow_view(options: DataFrame, top_products: int = 50, top_suppliers: int = 20) -> DataFrame:
    """Options between the products and the suppliers with most capacity (the drawing limits)."""
    def top(column: str, n: int) -> DataFrame:
        return F.broadcast(options.groupBy(column).agg(F.sum("capacity_units").alias("c")).orderBy(F.desc("c"), column).limit(n).select(column))

    return options.join(top("product_id", top_products), "product_id", "left_semi").join(top("supplier_id", top_suppliers), "supplier_id", "left_semi")


#: The road network's named places (id, label, lat, lon, type, zone) and roads (from, to, factor, name, type).
PLACES = [
    ("HUB:PUCALLPA", "Hub Pucallpa", -8.379, -74.553, "HUB", "selva"), ("RUTA:BOQUERON", "Boqueron del Padre Abad", -9.048, -75.505, "ROUTE", "selva"),
    ("RUTA:TINGO_MARIA", "Tingo Maria", -9.295, -76.010, "ROUTE", "selva"), ("RUTA:HUANUCO", "Huanuco", -9.930, -76.240, "ROUTE", "sierra"),
    ("RUTA:CERRO_PASCO", "Cerro de Pasco", -10.683, -76.256, "ROUTE", "sierra"), ("RUTA:LA_OROYA", "La Oroya", -11.521, -75.900, "ROUTE", "sierra"),
    ("HUB:ATE", "Hub Ate / Carretera Central", -12.030, -76.920, "HUB", "lima"), ("HUB:CENTRO", "Centro de distribucion Lima", -12.046, -77.043, "HUB", "lima"),
    ("HUB:CALLAO", "Puerto Callao", -12.056, -77.118, "HUB", "lima"), ("HUB:MIRAFLORES", "Hub Miraflores", -12.121, -77.030, "HUB", "lima"),
    ("HUB:SUR", "Hub Sur", -12.150, -76.990, "HUB", "lima"), ("HUB:NORTE", "Hub Norte", -11.980, -77.070, "HUB", "lima"), ("HUB:SJL", "Hub SJL", -11.980, -76.990, "HUB", "lima"),
]
ROADS = [
    ("HUB:PUCALLPA", "RUTA:BOQUERON", 1.02, "Federico Basadre", "highway"), ("RUTA:BOQUERON", "RUTA:TINGO_MARIA", 1.08, "Federico Basadre", "highway"),
    ("RUTA:TINGO_MARIA", "RUTA:HUANUCO", 1.10, "Carretera Central", "highway"), ("RUTA:HUANUCO", "RUTA:CERRO_PASCO", 1.12, "Carretera Central", "mountain"),
    ("RUTA:CERRO_PASCO", "RUTA:LA_OROYA", 1.14, "Carretera Central", "mountain"), ("RUTA:LA_OROYA", "HUB:ATE", 1.18, "Carretera Central", "mountain"),
    ("HUB:ATE", "HUB:CENTRO", 1.35, "Via Evitamiento", "urban"), ("HUB:CENTRO", "HUB:CALLAO", 1.35, "Av. Argentina", "urban"), ("HUB:CENTRO", "HUB:MIRAFLORES", 1.30, "Via Expresa", "urban"),
    ("HUB:CENTRO", "HUB:NORTE", 1.35, "Panamericana Norte", "urban"), ("HUB:ATE", "HUB:SJL", 1.30, "Anillo Este", "urban"), ("HUB:ATE", "HUB:SUR", 1.35, "Panamericana Sur", "urban"),
    ("HUB:SUR", "HUB:MIRAFLORES", 1.25, "Circuito Sur", "urban"), ("HUB:NORTE", "HUB:CALLAO", 1.25, "Nestor Gambetta", "urban"),
]
BRANCHES = 36


def places(spark: SparkSession) -> DataFrame:
    """node_id, label, lat, lon, node_type, zone of the named places and the branch points around Pucallpa."""
    named = spark.createDataFrame(PLACES, "node_id string, label string, lat double, lon double, node_type string, zone string")
    i, number = F.col("id"), F.lpad(F.col("id").cast("string"), 2, "0")
    ring, spoke = 1 + i % 6, i % 12
    branches = spark.range(1, BRANCHES + 1).select(
        F.concat(F.lit("RUTA:SELVA_RAMAL_"), number), F.concat(F.lit("Ramal logistico selva "), number), F.round(-7.95 + 0.055 * ring + 0.018 * (spoke % 4), 6),
        F.round(-73.75 + 0.085 * ring + 0.022 * F.floor(spoke / 4), 6), F.lit("ROUTE"), F.lit("desvio"),
    )
    return named.union(branches)


def roads(spark: SparkSession) -> DataFrame:
    """source, target, factor, road_name, edge_type of the fixed roads."""
    number = lambda c: F.concat(F.lit("RUTA:SELVA_RAMAL_"), F.lpad(c.cast("string"), 2, "0"))
    fixed = spark.createDataFrame(ROADS, "source string, target string, factor double, road_name string, edge_type string")
    spurs = spark.range(1, BRANCHES + 1).select(F.lit("HUB:PUCALLPA"), number(F.col("id")), F.lit(1.2), F.lit("Ramal sin salida"), F.lit("detour"))
    # every third branch point hangs together; the first of them is Pucallpa's spur already
    trail = spark.range(6, BRANCHES + 1, 3).select(number(F.col("id") - 3), number(F.col("id")), F.lit(1.15), F.lit("Trocha secundaria"), F.lit("detour"))
    return fixed.union(spurs).union(trail)


def logistics(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the road network with an access road for each entity that has coordinates.

    ``entities`` has node_id, node_type, label, lat and lon.
    """
    spark = entities.sparkSession
    where = places(spark)
    a, b = (where.select(F.col("node_id").alias(s), F.col("label").alias(f"{s}_name"), F.col("lat").alias(f"{s}_lat"), F.col("lon").alias(f"{s}_lon")) for s in ("source", "target"))
    straight = haversine_km(F.col("source_lat"), F.col("source_lon"), F.col("target_lat"), F.col("target_lon"))
    fixed = roads(spark).join(F.broadcast(a), "source").join(F.broadcast(b), "target").select("source", "target", "source_name", "target_name", F.round(F.greatest(straight * F.col("factor"), straight), 4).alias("km"), "edge_type", "road_name")
    hubs = where.where("node_type = 'HUB'")
    access = nearest_hub(entities, hubs).join(entities.select("node_id", "label"), "node_id").join(F.broadcast(hubs.select(F.col("node_id").alias("hub"), F.col("label").alias("hub_label"))), "hub").select(
        F.col("node_id").alias("source"), F.col("hub").alias("target"), F.col("label").alias("source_name"), F.col("hub_label").alias("target_name"), F.round("km", 4).alias("km"), F.lit("access").alias("edge_type"),
        F.when(F.col("hub") == "HUB:PUCALLPA", "Acceso Ucayali").otherwise("Acceso urbano").alias("road_name"),
    )
    own = entities.where("lat is not null").select("node_id", "node_type", "label", "lat", "lon", F.lit("").alias("zone"))
    return where.select("node_id", "node_type", "label", "lat", "lon", "zone").union(own), fixed.union(access)


def nearest_hub(entities: DataFrame, hubs: DataFrame, north: float = -10.0) -> DataFrame:
    """node_id, node_type, hub, km of the access road of each entity (columns node_id, node_type, lat, lon).

    North of ``north`` the hub is Pucallpa, else the nearest of the others. The road is a quarter longer than the straight
    line, and at least 5 km to Pucallpa, 100 km for a client and 60 km for a supplier elsewhere. ``hubs`` is a constant of
    a few rows.
    """
    h = F.broadcast(hubs.select(F.col("node_id").alias("hub"), F.col("lat").alias("hub_lat"), F.col("lon").alias("hub_lon")))
    pairs = entities.where("lat is not null").join(h, (F.col("lat") > north) == (F.col("hub") == "HUB:PUCALLPA"))
    pairs = pairs.withColumn("straight", haversine_km(F.col("lat"), F.col("lon"), F.col("hub_lat"), F.col("hub_lon")))
    best = pairs.groupBy("node_id", "node_type").agg(F.min(F.struct("straight", "hub")).alias("b"))
    floor = F.when(F.col("b.hub") == "HUB:PUCALLPA", 5.0).when(F.col("node_type") == "CLIENT", 100.0).otherwise(60.0)
    return best.select("node_id", "node_type", F.col("b.hub").alias("hub"), F.greatest(F.col("b.straight") * 1.25, floor).alias("km"))
