"""Search of many requests over one index, from query text to ranked products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise import constants as K
from cartwise.operators.index import SearchIndex
from cartwise.operators.joins import fan_out
from cartwise.operators.query_intent import query_intent, query_slots
from cartwise.operators.rerank import rerank, slot_filters
from cartwise.operators.retrieval import retrieve_vectors


def with_request_defaults(requests: DataFrame) -> DataFrame:
    """Fill churn_score, top_k and weights where missing."""
    defaults = {
        "churn_score": F.lit(K.DEFAULT_CHURN),
        "top_k": F.lit(K.DEFAULT_TOP_K),
        "weights": F.lit(None).cast("map<string,double>"),
    }
    return requests.withColumns({
        c: F.coalesce(F.col(c), d) if c in requests.columns else d for c, d in defaults.items()
    })


def candidates(requests: DataFrame, index: SearchIndex, products: DataFrame) -> DataFrame:
    """Retrieved rows with product metadata and the understanding of their query.

    Product columns are added to the lists of distinct query vectors, before every request gets its list.
    """
    asked, retrieved = retrieve_vectors(with_request_defaults(requests), index)
    understood = query_slots(query_intent(asked)).drop("query")
    meta = products.select("product_id", "name", "category", "brand", "price", "rating", "popularity", "stock", "discount")
    return fan_out(understood, retrieved.join(meta, "product_id"), "qkey", "query_id")


def search(requests: DataFrame, index: SearchIndex, products: DataFrame) -> DataFrame:
    """Ranked products per request. ``requests``: query_id, query and optionally churn_score, top_k,
    weights. ``products``: the catalogue the index was built from."""
    return rerank(slot_filters(candidates(requests, index, products)))
