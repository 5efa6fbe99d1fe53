"""Joins and groupings over clean products, sales and purchases."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.tables import materialise, running

#: Rows of one group whose median one buffer may find.
MOST_VALUES = 100_000


def product_matches(products: DataFrame, sales: DataFrame, purchases: DataFrame) -> DataFrame:
    """Every product id that is sold or bought, with a name, and whether the catalogue has it."""
    seen = sales.select("product_id", "product_name").union(purchases.select("product_id", "product_name")).groupBy("product_id").agg(F.min("product_name").alias("product_name"))
    known = products.select("product_id", F.lit(True).alias("in_catalog")).distinct()
    out = seen.join(known, "product_id", "left").withColumn("in_catalog", F.coalesce("in_catalog", F.lit(False)))
    return out.withColumn("status", F.when(F.col("in_catalog"), "accepted").otherwise("unmatched"))


def product_activity(sales: DataFrame, purchases: DataFrame) -> DataFrame:
    """Units and amounts sold and bought of each product."""
    sold = sales.groupBy("product_id").agg(F.sum("quantity").alias("sold_units"), F.sum("total").alias("sales_amount"))
    bought = purchases.groupBy("product_id").agg(F.sum("quantity").alias("purchased_units"), F.sum("total").alias("purchase_amount"))
    return sold.join(bought, "product_id", "full_outer").na.fill(0.0, ["sold_units", "sales_amount", "purchased_units", "purchase_amount"])


def transaction_flags(sales: DataFrame, purchases: DataFrame) -> DataFrame:
    out = [
        df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("quantity") <= 0).alias("n_no_quantity"), F.count_if(F.col("total") <= 0).alias("n_no_total")).select(F.lit(name).alias("table_name"), "*")
        for name, df in (("sales", sales), ("purchases", purchases))
    ]
    return out[0].union(out[1])


def grouped_median(rows: DataFrame, keys: list[str], value: str, name: str = "median", most: int | None = None) -> DataFrame:
    """keys and the exact median of ``value`` (nulls left out) of each group, null keys being groups too.

    Groups are counted. Those of at most ``most`` rows are found by Spark's median, which holds a group's values in one buffer. The values of larger ones
    are sorted by ranges, and the one or two in the middle are read off by their place, so a group of any size is divided.
    """
    most = MOST_VALUES if most is None else most
    key = F.to_json(F.struct(*(F.col(k).cast("string").alias(k) for k in keys)), {"ignoreNullFields": "false"}).alias("_key")
    large = rows.groupBy(*keys).agg(F.count(value).alias("_n")).where(F.col("_n") > most).select(*keys, key)
    if not large.head(1):
        return rows.groupBy(*keys).agg(F.median(value).alias(name))
    large = materialise(large)
    keyed = rows.select("*", key)
    small = keyed.join(large.select("_key"), "_key", "left_anti").groupBy(*keys).agg(F.median(value).alias(name))
    placed = running(keyed.where(F.col(value).isNotNull()).select("_key", value).join(large.select("_key"), "_key", "left_semi"), ["_key"], [value], {"_place": F.lit(1)}, few=most)
    low, high = F.floor((F.col("_place_total") - 1) / 2), F.floor(F.col("_place_total") / 2)
    middle = placed.where((F.col("_place") == low) | (F.col("_place") == high)).groupBy("_key").agg(F.avg(value).alias(name))
    return small.unionByName(large.join(middle, "_key").drop("_key"))


def supply_options(purchases: DataFrame, most: int | None = None) -> DataFrame:
    """Median cost, quantity, lines and last date by product and supplier, and each supplier's whole quantity."""
    cost = F.when(F.col("unit_value") > 0, F.col("unit_value")).otherwise(F.col("total") / F.col("quantity"))
    lines = purchases.where("quantity > 0").withColumn("cost", cost).withColumnsRenamed({"entity_norm": "supplier_id", "entity_name": "supplier"})
    keys = ["product_id", "product_name", "supplier_id", "supplier"]
    sums = [F.sum("quantity").alias("capacity_units"), F.count(F.lit(1)).alias("purchase_lines"), F.max("date").alias("last_purchase")]
    most = MOST_VALUES if most is None else most
    if lines.groupBy("product_id", "supplier_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).head(1):
        # a group too large for one buffer: its sums are added up by task, its median is found by ranges
        medians = grouped_median(lines, keys, "cost", "unit_cost", most).withColumnsRenamed({k: f"_{k}" for k in keys})
        grouped = lines.groupBy(*keys).agg(*sums)
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        grouped = grouped.join(medians, same).select(*keys, "unit_cost", "capacity_units", "purchase_lines", "last_purchase")
    else:
        grouped = lines.groupBy(*keys).agg(F.median("cost").alias("unit_cost"), *sums)
    whole = grouped.groupBy("supplier_id").agg(F.sum("capacity_units").alias("supplier_capacity"))
    return grouped.join(whole, "supplier_id")


def best_savings(options: DataFrame) -> DataFrame:
    """Each product's cheapest option against the median of its options: the shortest path of a two-level graph.

    Groupings and a join by product, so that no task sorts the options of a product that a third of all suppliers sell.
    """
    reference = grouped_median(options, ["product_id"], "unit_cost", "reference_cost").where("product_id is not null")
    rows = options.join(reference, "product_id").withColumn("edge_weight", F.col("unit_cost") - F.col("reference_cost"))
    first = F.min(F.struct("edge_weight", "supplier_id", "product_name", "supplier", "unit_cost", "reference_cost")).alias("x")
    best = rows.groupBy("product_id").agg(first, F.count_if(F.col("edge_weight") < 0).alias("negative_edges"))
    return best.select(
        "product_id", "x.product_name", "x.supplier_id", "x.supplier", "x.unit_cost", "x.reference_cost", "x.edge_weight", (-F.col("x.edge_weight")).alias("savings"),
        F.try_divide(-F.col("x.edge_weight"), "x.reference_cost").alias("savings_pct"), "negative_edges",
    )
