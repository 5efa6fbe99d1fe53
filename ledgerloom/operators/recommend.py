"""Cross-sell, market basket, and substitutes for suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import may_reach, normalize_text, normalize_value, similarity
from ..plans.tables import BROADCAST_ROWS, materialise

RESOLVE_THRESHOLD, CONTAINED = 0.5, 0.92


def cross_sell(sales: DataFrame, product_id, limit: int = 10) -> DataFrame:
    """Products that the buyers of one product also buy: shared_clients, and their share of the buyers."""
    bought = sales.select("entity_norm", "product_id").distinct()
    buyers = bought.where(F.col("product_id") == product_id).select("entity_norm")
    n = buyers.agg(F.count(F.lit(1)).cast("double").alias("buyers"))
    top = (
        bought.where(F.col("product_id") != product_id).join(buyers, "entity_norm", "left_semi").groupBy("product_id").agg(F.count(F.lit(1)).alias("shared_clients"))
        .orderBy(F.desc("shared_clients"), "product_id").limit(limit)
    )
    return top.join(F.broadcast(n)).select("product_id", "shared_clients", F.round(F.col("shared_clients") * 100.0 / F.col("buyers"), 1).alias("affinity_pct"))  # one row


def co_occurrence(lines: DataFrame, product_id, limit: int = 15) -> DataFrame:
    """Other products on the documents of one product, by number of lines."""
    docs = lines.where(F.col("product_id") == product_id).select("document").distinct()
    return (
        lines.where((F.col("product_id") != product_id) & F.col("document").isNotNull()).join(docs, "document", "left_semi").groupBy("product_id")
        .agg(F.count(F.lit(1)).alias("frequency"), F.sum("quantity").alias("total_quantity"), F.sum("total").alias("total_amount"), F.avg("quantity").alias("avg_quantity"))
        .orderBy(F.desc("frequency"), F.desc("total_amount"), "product_id").limit(limit)
    )


def resolve_supplier(suppliers: DataFrame, text: str) -> DataFrame:
    """supplier_id, supplier, score: exact 1.0, contained 0.92, else the better of the similarities of id and name."""
    value = normalize_value(text)
    key, sid, name = F.lit(value), F.col("sid"), F.col("name")
    rows = suppliers.select("supplier_id", "supplier").distinct().withColumn("sid", normalize_text(F.col("supplier_id").cast("string"))).withColumn("name", normalize_text(F.col("supplier")))
    contained = sid.contains(key) | name.contains(key)
    exact = F.when((sid == key) | (name == key), 1.0).when(contained, CONTAINED)
    sure = rows.where(contained & F.lit(bool(value))).withColumn("score", exact)
    able = rows.where(~contained & (may_reach(value, sid, RESOLVE_THRESHOLD) | may_reach(value, name, RESOLVE_THRESHOLD)))
    rest = able.withColumn("score", F.greatest(similarity(key, sid), similarity(key, name)))
    both = sure.union(rest).where(F.col("score") >= RESOLVE_THRESHOLD)
    return both.orderBy(F.desc("score"), "supplier_id").limit(5).select("supplier_id", "supplier", F.round("score", 4).alias("score"))


def supplier_substitutes(projection: DataFrame, supplier, limit: int = 20) -> DataFrame:
    """Suppliers of the same products; ``coverage`` is seen from the given supplier, ``coverage_of_candidate`` from the other one."""
    def side(own: str, other: str) -> DataFrame:
        return projection.where(F.col(own) == supplier).select(
            F.col(other).alias("supplier_id"), "similarity", "shared_products", F.col(f"{own}_coverage").alias("coverage"), F.col(f"{other}_coverage").alias("coverage_of_candidate")
        )

    return side("source", "target").union(side("target", "source")).orderBy(F.desc("similarity"), F.desc("shared_products"), "supplier_id").limit(limit)


def substitutes_for(suppliers: DataFrame, projection: DataFrame, families: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Substitutes of the supplier that a text names best, each with its name, and with the matched supplier, its score and its family.

    ``suppliers`` has supplier_id and supplier; only suppliers of a family or of the projection are candidates. Nothing is
    returned where no supplier is near enough (suggestions() names some) or the one found is in no family.
    """
    families, projection = materialise(families), materialise(projection)
    known = families.select("supplier_id").union(projection.select("source")).union(projection.select("target")).distinct()
    best = resolve_supplier(suppliers.join(known, "supplier_id", "left_semi"), text).limit(1)
    matched = best.join(families, "supplier_id").select(F.col("supplier_id").alias("matched_id"), F.col("supplier").alias("matched_name"), F.col("score").alias("match_score"), "family_id", "family_size")
    one = matched.head(1)
    found = supplier_substitutes(projection, one[0]["matched_id"] if one else None, limit)
    names = suppliers.groupBy("supplier_id").agg(F.min("supplier").alias("supplier_name"))
    return found.join(names, "supplier_id", "left").join(F.broadcast(matched))  # one row


def suggestions(suppliers: DataFrame, text: str, limit: int = 5) -> DataFrame:
    """supplier, score of the suppliers whose id or name is most similar to a text, however little."""
    value = normalize_value(text)
    score = F.greatest(similarity(F.lit(value), normalize_text(F.col("supplier_id").cast("string"))), similarity(F.lit(value), normalize_text(F.col("supplier"))))
    return suppliers.select("supplier_id", "supplier").distinct().withColumn("score", score).orderBy(F.desc("score"), "supplier_id").limit(limit).select("supplier", "score")


def with_names(rows: DataFrame, products: DataFrame) -> DataFrame:
    """``rows`` (a top list) with the product_name of their product_id; of ``products``, only the lines of these ids are grouped."""
    rows = materialise(rows)
    ids = rows.select("product_id").distinct()
    some = products.select("product_id", "product_name").join(F.broadcast(ids) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids, "product_id", "left_semi")
    return rows.join(some.groupBy("product_id").agg(F.min("product_name").alias("product_name")), "product_id", "left")
