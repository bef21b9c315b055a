"""Insert-or-replace by key, and embed-once by content."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwise import constants as K
from cartwise.functions import text as X


def with_catalog_defaults(products: DataFrame) -> DataFrame:
    """Fill missing or null catalogue fields and cast them to their types."""
    kinds = {"rating": "double", "popularity": "double", "discount": "double", "stock": "boolean", "brand": "string"}
    have = set(products.columns)
    out = {}
    for name, default in K.CATALOG_DEFAULTS.items():
        value = F.col(name).cast(kinds[name]) if name in have else F.lit(None).cast(kinds[name])
        out[name] = F.coalesce(value, F.lit(default))
    return products.withColumns(out)


def with_metadata_defaults(products: DataFrame) -> DataFrame:
    """Defaults of an index entry: like the catalogue's, but empty texts and price 0."""
    texts = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in products.columns else F.lit("")
             for c in ("name", "desc", "category", "brand")}
    price = F.coalesce(F.col("price").cast("double"), F.lit(0.0)) if "price" in products.columns else F.lit(0.0)
    return with_catalog_defaults(products.withColumns({**texts, "price": price}))


def latest(rows: DataFrame, key: str, *version: str) -> DataFrame:
    """Newest row per key. The rank limit runs before the shuffle, so a key rewritten without end
    sends one row per task."""
    order = Window.partitionBy(key).orderBy(*[F.desc(v) for v in version])
    return rows.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def upsert(existing: DataFrame, updates: DataFrame, key: str, *version: str) -> DataFrame:
    return latest(existing.unionByName(updates, allowMissingColumns=True), key, *version)


def index_status(entries: DataFrame, key: str, version: str) -> DataFrame:
    return entries.agg(F.count(key).alias("indexed_products"), F.max(version).alias("max_version"))


def content_groups(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per distinct text: its hash, first key, text and number of copies."""
    return docs.groupBy(X.content_hash(F.col(text)).alias("text_hash")).agg(
        F.min(key).alias("first_key"), F.count("*").alias("copies"), F.first(text).alias(text)
    )


def not_embedded(groups: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct texts without a stored vector."""
    return groups.join(stored.select("text_hash"), "text_hash", "left_anti")


def embed_copies(docs: DataFrame, key: str, text: str, embedded: DataFrame) -> DataFrame:
    """Hand the vector of every distinct text to all documents with this text."""
    return docs.select(key, X.content_hash(F.col(text)).alias("text_hash")).join(embedded, "text_hash")
