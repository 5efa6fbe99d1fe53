"""Concept search on the semantic graph, and text search behind it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from ..functions.text import may_reach, normalize_text, normalize_value, similarity, tokens

#: Weight by distance from the query's concepts; a finalist's other attributes are two steps away.
NEAR, FAR, COVERED = 5, 3, 21
TEXT_THRESHOLD = 0.35


def _singular(token: str) -> str:
    if len(token) > 4 and token.endswith("ES"):
        return token[:-2]
    return token[:-1] if len(token) > 3 and token.endswith("S") else token


def exact_filters(text: str) -> dict[str, str]:
    """group key -> node id of capacities and mouth sizes in a normalised query."""
    out = {}
    if m := re.search(r"\b(\d+(?:[.,]\d+)?)\s*(ML|CC|L|LT|LTR|GR|G|KG|MG|W|V)\b", text):
        unit = {"LT": "L", "LTR": "L", "G": "GR"}.get(m[2], m[2])
        value = f"{float(m[1].replace(',', '.')):g}{unit}"
        out[f"capacity:{value}"] = f"CAPACITY:{value}"
    if m := re.search(r"\b[BTN]\s*([0-9]{2,3})\s*(?:MM)?\b", text):
        out[f"mouth_size:{float(m[1]):g}MM"] = f"MOUTH_SIZE:{float(m[1]):g}MM"
    return out


def seed_groups(nodes: DataFrame, query: str) -> tuple[DataFrame, int, list[str]]:
    """((group_key, node_id), number of groups, exact filters that no node answers).

    A word is the nodes labelled with it or its singular; words that no node answers are ignored, and groups with the same
    nodes count once. Only the vocabulary that the query names is read.
    """
    text = normalize_value(query)
    wanted = exact_filters(text)
    words = list(dict.fromkeys(text.split()))
    forms = sorted({f for w in words for f in (w, _singular(w))})
    label = normalize_text(F.col("label"))
    met = nodes.where((F.col("node_type") != "PRODUCT") & (F.col("node_id").isin(*wanted.values(), "") | label.isin(*forms, ""))).select("node_id", label.alias("label")).distinct().collect()
    groups: dict[str, frozenset] = {k: frozenset(r["node_id"] for r in met if r["node_id"] == v) for k, v in wanted.items()}
    for w in words:
        groups[f"term:{w}"] = frozenset(r["node_id"] for r in met if r["label"] in (w, _singular(w)))
    unresolved = [k for k in wanted if not groups[k]]
    kept: dict[frozenset, str] = {}
    for k, found in groups.items():
        if found:
            kept.setdefault(found, k)
    rows = [(k, n) for found, k in kept.items() for n in sorted(found)]
    return nodes.sparkSession.createDataFrame(rows, "group_key string, node_id string"), len(kept) + len(unresolved), unresolved


def search(nodes: DataFrame, edges: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """product, label, relevance, units_sold, seed_coverage, total_seeds of products that meet every concept of the query.

    Best sold first, relevance breaks ties. A finalist touches a concept, so all its attributes are at most two steps
    from the query and its relevance is a sum over its own edges: no traversal is needed.
    """
    seeds, total, unresolved = seed_groups(nodes, query)
    seeds = F.broadcast(seeds)  # the literal query's words
    touching = edges.join(seeds, edges["target"] == seeds["node_id"]).groupBy("source").agg(F.countDistinct("group_key").alias("seed_coverage")).where(F.lit(not unresolved) & (F.col("seed_coverage") == total))
    near = seeds.select("node_id").distinct()
    scored = (
        edges.join(touching, "source").join(F.broadcast(near.withColumn("near", F.lit(True))), F.col("target") == F.col("node_id"), "left")
        .groupBy("source", "seed_coverage").agg((F.sum(F.coalesce(F.col("weight").try_cast("double"), F.lit(1.0)) * F.when(F.col("near"), NEAR).otherwise(FAR)) * COVERED).alias("score"))
    )
    products = nodes.where("node_type = 'PRODUCT'").select(F.col("node_id").alias("source"), "label", F.coalesce(F.col("units_sold").try_cast("double"), F.lit(0.0)).alias("units_sold"))
    return (
        scored.join(products, "source").orderBy(F.desc("units_sold"), F.desc("score"), "source").limit(limit)
        .select(F.col("source").alias("product"), "label", F.round("score", 2).alias("relevance"), F.round("units_sold", 2).alias("units_sold"), "seed_coverage", F.lit(total).cast("long").alias("total_seeds"))
    )


def name_index(products: DataFrame) -> DataFrame:
    """(word, product_id, product_name, n): a row for each different word of a name and its normalised form n, sorted by word.

    Kept as a dataset's artifact: a search for a word is a filter that files' and row groups' ranges answer, so names without it are never read.
    """
    rows = products.select("product_id", "product_name", normalize_text(F.col("product_name")).alias("n"))
    return rows.withColumn("word", F.explode(F.array_distinct(tokens(F.col("n"))))).repartitionByRange("word", "product_id").sortWithinPartitions("word", "product_id").select("word", "product_id", "product_name", "n")


def text_search(products: DataFrame, query: str, limit: int = 10, index: DataFrame | None = None) -> DataFrame:
    """product_id, product_name, score of the most similar names; with several words all must be there.

    With a name_index() a query of several words reads the entries of one of its words alone: a name that has all of them is as similar as can be (1.0). So is a name that has the one word
    of a query, and all that has not is less similar; so only where fewer than ``limit`` names have it, all names are compared.
    """
    text = normalize_value(query)
    words = text.split()
    if index is not None and words:
        met = index.where(F.col("word") == max(words, key=len))
        if len(words) > 1:
            met = met.where(F.forall(F.array(*(F.lit(w) for w in words)), lambda w: F.array_contains(tokens(F.col("n")), w)))
        if len(words) > 1 or met.limit(limit).count() == limit:
            return met.select("product_id", "product_name", F.lit(1.0).alias("score")).orderBy("product_id").limit(limit)
    name = normalize_text(F.col("product_name"))
    rows = products.select("product_id", "product_name", name.alias("n"))
    if len(words) > 1:
        rows = rows.where(F.forall(F.array(*(F.lit(w) for w in words)), lambda w: F.array_contains(tokens(F.col("n")), w)))
    rows = rows.where(F.col("n").contains(text) | may_reach(text, F.col("n"), TEXT_THRESHOLD))
    score = F.when(F.col("n").contains(text), F.greatest(similarity(F.lit(text), F.col("n")), F.lit(0.98))).otherwise(similarity(F.lit(text), F.col("n")))
    return rows.withColumn("score", score).where(F.col("score") >= TEXT_THRESHOLD).orderBy(F.desc("score"), "product_id").limit(limit).select("product_id", "product_name", "score")


def search_products(nodes: DataFrame, edges: DataFrame, products: DataFrame, query: str, limit: int = 10, index: DataFrame | None = None) -> DataFrame:
    """Concept search; where the graph knows no word of the query, text search."""
    if seed_groups(nodes, query)[1]:
        return search(nodes, edges, query, limit)
    return text_search(products, query, limit, index)


def find_node(nodes: DataFrame, text: str, node_type: str | None = None) -> str | None:
    """First node (by id) whose id or label contains the text."""
    key = normalize_value(text)
    rows = nodes if node_type is None else nodes.where(F.col("node_type") == node_type)
    hit = rows.where(F.upper("node_id").contains(key) | normalize_text(F.col("label")).contains(key)).orderBy("node_id").select("node_id").head(1)
    return hit[0][0] if hit else None
