"""From raw tables with any headers to clean products, sales and purchases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geo import parse_lat_lon
from ..functions.text import clean_description, compound_document, normalize_column, normalize_text, normalize_value, parse_date, to_float, token_set_ratio

MATCH_THRESHOLD = 0.62

_SHARED = {
    "date": ["fecha de emision", "fecha", "fec emision"], "doc_type": ["tipo"], "doc_serie": ["serie"], "document": ["numero", "número"],
    "product_id": ["codigo", "cod producto", "sku"], "product_name": ["descripcion", "producto", "articulo"], "quantity": ["cantidad", "cant"],
    "subtotal": ["subtotal"], "total": ["total"],
}
#: Header names that stand for each field.
ALIASES: dict[str, dict[str, list[str]]] = {
    "products": {
        "product_id": ["codigo interno", "codigo", "cod producto", "sku"],
        "product_name": ["descripcion", "producto", "nombre", "articulo"],
        "stock": ["stock actual disponible", "stock", "existencia"],
        "category": ["descripcion de categoria", "categoria"],
        "unit": ["codigo unidad de medida", "unidad de medida", "unidad"],
        "unit_cost_purchase": ["precio compra unitario con igv", "precio compra unitario"],
        "unit_price_sale": ["valor venta unitario sin igv", "valor venta unitario"],
    },
    "sales": _SHARED | {
        "entity_id": ["doc entidad numero", "ruc cliente", "documento cliente"], "entity": ["denominacion entidad", "cliente", "razon social"],
        "price": ["precio unitario", "valor unitario"], "voided": ["anulado"],
        "lat": ["latitud", "lat", "latitud cliente"], "lon": ["longitud", "lon", "lng", "longitud cliente"],
    },
    "purchases": _SHARED | {
        "entity_id": ["doc entidad numero", "ruc proveedor", "documento proveedor"], "entity": ["denominacion entidad", "proveedor", "razon social"],
        "price": ["precio unitario", "valor unitario", "costo unitario"],
        "lat": ["latitud", "lat", "latitud proveedor"], "lon": ["longitud", "lon", "lng", "longitud proveedor"],
    },
}


def detect_schema(columns: list[str], kind: str, first_column_wins: bool = False) -> dict[str, tuple[str | None, float]]:
    """field -> (column, confidence), from header strings alone.

    An exact match comes first, aliases in order; else the most similar header from MATCH_THRESHOLD on. With
    ``first_column_wins`` exact and similar headers compete, and the first column that reaches the best score
    has it.
    """
    out = {}
    names = {c: normalize_column(c) for c in columns}
    for field, aliases in ALIASES[kind].items():
        wanted = [normalize_column(a) for a in aliases]
        exact = [c for a in wanted for c in columns if names[c] == a]
        if exact and not first_column_wins:
            out[field] = (exact[0], 1.0)
            continue
        best, score = None, 0.0
        for c in columns:
            s = max(1.0 if names[c] == w else token_set_ratio(normalize_value(a), normalize_value(c)) for a, w in zip(aliases, wanted, strict=True))
            if s > score:
                best, score = c, s
        out[field] = (best if score >= MATCH_THRESHOLD else None, round(score, 4))
    return out


def _field(mapping: dict, name: str) -> Column:
    column = (mapping.get(name) or (None,))[0]
    return F.col(f"`{column}`").cast("string") if column else F.lit(None).cast("string")


def _text(c: Column) -> Column:
    """Trimmed text; null, blank and 'nan' are empty."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.lower(t) == "nan", F.lit("")).otherwise(t)


def normalize_products(raw: DataFrame, mapping: dict) -> DataFrame:
    """One row per product id, the first in source order."""
    name = _field(mapping, "product_name")
    rows = raw.select(
        "_ord", _text(_field(mapping, "product_id")).alias("product_id"), clean_description(name).alias("product_name"), normalize_text(name).alias("product_name_norm"),
        to_float(_field(mapping, "stock")).alias("stock"), _text(_field(mapping, "category")).alias("category"), _text(_field(mapping, "unit")).alias("unit"),
        to_float(_field(mapping, "unit_cost_purchase")).alias("unit_cost_purchase"), to_float(_field(mapping, "unit_price_sale")).alias("unit_price_sale"),
    ).where("product_id <> '' or product_name <> ''")
    kept = [c for c in rows.columns if c not in ("_ord", "product_id")]
    # partially aggregated: an id that a large share of the rows has (a blank one, say) is a row for each task
    return rows.groupBy("product_id").agg(F.min_by(F.struct(*kept), "_ord").alias("x")).select("product_id", "x.*")


def normalize_transactions(raw: DataFrame, mapping: dict, kind: str) -> DataFrame:
    """Sale or purchase lines; voided sales are left out."""
    name, entity = _field(mapping, "product_name"), _text(_field(mapping, "entity"))
    quantity, price, subtotal, total = (to_float(_field(mapping, f)) for f in ("quantity", "price", "subtotal", "total"))
    derived = F.when((price <= 0) & (quantity > 0), F.coalesce(F.nullif(subtotal, F.lit(0.0)), total) / quantity).otherwise(price)
    coordinates = parse_lat_lon(_field(mapping, "lat"), _field(mapping, "lon"))
    entity = F.when(entity == "", F.lit("SIN ENTIDAD")).otherwise(entity)
    rows = raw if kind == "purchase" else raw.where(~normalize_text(_field(mapping, "voided")).isin("SI", "YES", "ANULADO"))
    return rows.select(
        "_ord", parse_date(_field(mapping, "date")).alias("date"), compound_document(*(_field(mapping, f) for f in ("doc_type", "doc_serie", "document"))).alias("document"),
        _text(_field(mapping, "entity_id")).alias("entity_id"), entity.alias("entity_name"), normalize_text(entity).alias("entity_norm"),
        _text(_field(mapping, "product_id")).alias("product_id"), clean_description(name).alias("product_name"), normalize_text(name).alias("product_name_norm"),
        quantity.alias("quantity"), derived.alias("unit_value"), subtotal.alias("subtotal"), total.alias("total"),
        coordinates["lat"].alias("lat"), coordinates["lon"].alias("lon"), F.lit(kind).alias("transaction_type"),
    ).where("product_id <> '' or product_name <> ''")


def entity_coordinates(sales: DataFrame, purchases: DataFrame) -> DataFrame:
    """node_id, lat, lon: first valid coordinates of each client and supplier."""
    def first(df: DataFrame, prefix: str) -> DataFrame:
        return (
            df.where("lat is not null").groupBy("entity_norm").agg(F.min_by(F.struct("lat", "lon"), "_ord").alias("c"))
            .select(F.concat(F.lit(prefix), "entity_norm").alias("node_id"), "c.lat", "c.lon")
        )

    return first(sales, "CLIENT:").union(first(purchases, "SUPPLIER:"))


def profile(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, n_rows, n_columns, n_nulls."""
    out = None
    for name, df in tables.items():
        columns = [c for c in df.columns if c != "_ord"]
        nulls = sum((F.col(f"`{c}`").isNull().cast("int") for c in columns), F.lit(0))
        one = df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(nulls), F.lit(0)).alias("n_nulls")).select(F.lit(name).alias("table_name"), "n_rows", F.lit(len(columns)).cast("long").alias("n_columns"), "n_nulls")
        out = one if out is None else out.union(one)
    return out


def quality_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, n_rows, n_products, n_entities, n_blank_ids; tables without entities have 0 of them."""
    out = None
    for name, df in tables.items():
        entities = F.countDistinct("entity_norm") if "entity_norm" in df.columns else F.lit(0).cast("long")
        blank = F.count_if(F.coalesce(F.col("product_id").cast("string"), F.lit("")) == "")
        one = df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("product_id").alias("n_products"), entities.alias("n_entities"), blank.alias("n_blank_ids")).select(F.lit(name).alias("table_name"), "*")
        out = one if out is None else out.union(one)
    return out
