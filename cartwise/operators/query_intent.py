"""Intent and slots of search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.functions import text as X


def query_intent(df: DataFrame, query: str = "query") -> DataFrame:
    """Add intent_label and intent_confidence."""
    hits = df.withColumn("_hits", X.hit_counts(X.normalized_query(F.col(query))))
    label, confidence = X.label_and_confidence(F.col("_hits"))
    return hits.withColumns({"intent_label": label, "intent_confidence": confidence}).drop("_hits")


def query_slots(df: DataFrame, query: str = "query") -> DataFrame:
    """Add slot_max_price (as written), slot_brand and slot_category; null where not named."""
    q = X.normalized_query(F.col(query))
    return df.withColumns({
        "slot_max_price": X.price_ceiling(q),
        "slot_brand": X.brand_slot(q),
        "slot_category": X.category_slot(q),
    })


def slots_map(df: DataFrame) -> DataFrame:
    """The three slots as one map without the missing ones."""
    names = ["max_price", "brand", "category"]
    full = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(f"slot_{n}") for n in names]))
    return df.withColumn("slots", F.map_filter(full, lambda k, v: v.isNotNull()))
