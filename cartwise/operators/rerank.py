"""Slot filters, scoring and ranking of retrieved candidates.

A query has at most the retrieval depth of candidates here, so windows per query are small. All of
them share one partitioning by query, or by the ``PLACE`` of a query where candidates have one (``joins.fan_out``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwise import constants as K
from cartwise.functions import ranking as R
from cartwise.functions import text as X
from cartwise.operators.joins import PLACE


def _per_query(df: DataFrame):
    return Window.partitionBy(*[c for c in (PLACE, "query_id") if c in df.columns])


def _keep_if_any(df: DataFrame, match: Column) -> DataFrame:
    """Keep matching rows of a query; all of them if none matches. A null match means no filter."""
    marked = df.withColumn("_match", match)
    some = F.coalesce(F.bool_or("_match").over(_per_query(df)), F.lit(False))
    return marked.withColumn("_some", some).filter("_match OR NOT _some").drop("_match", "_some")


def slot_filters(candidates: DataFrame) -> DataFrame:
    """Narrow to the category named in the query, then to its price ceiling, never to nothing."""
    in_category = F.when(
        F.col("slot_category").isNotNull(), F.coalesce(F.col("category") == F.col("slot_category"), F.lit(False))
    )
    narrowed = _keep_if_any(candidates, in_category)
    ceiling = F.col("slot_max_price").try_cast("double")
    affordable = F.coalesce("price", F.lit(K.MISSING_PRICE)) <= ceiling
    return _keep_if_any(narrowed, affordable)


def rerank(candidates: DataFrame) -> DataFrame:
    """Score and rank candidates of every query.

    Takes query_id, product_id, retrieval_rank, dense_sim, sparse_score, the catalogue columns,
    intent_label, intent_confidence, churn_score, weights and top_k. Signals are normalised over the
    candidates given, so filters belong before this step.
    """
    label, confidence = F.col("intent_label"), F.col("intent_confidence")
    per_query = _per_query(candidates)
    in_stock = candidates.withColumns({
        "price": F.coalesce("price", F.lit(0.0)).cast("double"),
        "discount": F.coalesce("discount", F.lit(0.0)).cast("double"),
        "rating": F.coalesce("rating", F.lit(3.5)).cast("double"),
        "popularity": F.coalesce("popularity", F.lit(0.5)).cast("double"),
        # maxima are taken over all candidates, prices over those in stock
        "_dense_max": F.max("dense_sim").over(per_query),
        "_sparse_max": F.max("sparse_score").over(per_query),
        "total_candidates": F.count("*").over(per_query),
    }).filter(F.coalesce("stock", F.lit(True)))

    def share(value: str, top: str) -> Column:
        return F.when(F.col(top) == 0, F.col(value)).otherwise(F.try_divide(value, top))

    low, high = F.min("price").over(per_query), F.max("price").over(per_query)
    normed = in_stock.withColumns({"_low": low, "_high": high}).withColumns({
        "_dense": share("dense_sim", "_dense_max"),
        "_sparse": share("sparse_score", "_sparse_max"),
        "_price": F.coalesce(F.try_divide(F.col("price") - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0)),
    })
    vector = normed.withColumn("_vector", K.W_DENSE * F.col("_dense") + K.W_SPARSE * F.col("_sparse"))
    v, np = F.col("_vector"), F.col("_price")
    fit = vector.withColumns({
        "_intent": R.penalised(R.intent_fit(label, np, F.col("discount"), F.col("rating"), F.col("popularity"), v, confidence), v),
        "_pricing": R.penalised(R.pricing_fit(label, np, F.col("discount"), F.col("rating"), F.col("popularity"), F.col("churn_score")), v),
    })
    parts = {"vector": v, "intent": F.col("_intent"), "pricing": F.col("_pricing")}
    final = sum((R.weight(n, F.col("weights"), label) * c for n, c in parts.items()), F.lit(0.0))
    scored = fit.withColumn("_final", final).withColumns({
        "final_score": F.round("_final", 4),
        "vector_score": F.round("_vector", 4),
        "dense_sim": F.round("_dense", 4),
        "sparse_score": F.round("_sparse", 4),
        "intent_score": F.round("_intent", 4),
        "pricing_score": F.round("_pricing", 4),
        "intent_confidence": F.round("intent_confidence", 4),
    })
    order = per_query.orderBy(F.desc("final_score"), "retrieval_rank")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.col("top_k"))
    reason = X.explanation(label, F.col("price"), F.col("discount"), F.col("rating"), F.col("_final"))
    return ranked.withColumn("rank_explanation", reason).select(
        "query_id", "rank", "product_id", "name", "category", "brand", "price", "discount", "rating",
        "final_score", "vector_score", "dense_sim", "sparse_score", "intent_score", "pricing_score",
        "intent_label", "intent_confidence", "rank_explanation", "total_candidates",
    )
