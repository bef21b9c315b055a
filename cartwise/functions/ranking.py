"""Score expressions of the search reranker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartwise import constants as K


def _clip(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def pricing_fit(label: Column, norm_price: Column, discount: Column, rating: Column,
                popularity: Column, churn: Column) -> Column:
    cheap = (1 - norm_price + discount * K.DISCOUNT_LIFT) * (1 + K.CHURN_LIFT * churn)
    stars = rating / 5
    return _clip(
        F.when(label == "price_sensitive", cheap)
        .when(label == "premium", 0.50 * norm_price + 0.50 * stars)
        .when(label == "urgent_buy", 0.60 * popularity + 0.40 * (1 - norm_price * 0.40))
        .when(
            label == "gift",
            0.40 * stars + 0.30 * (1 - F.abs(norm_price - 0.50)) + 0.30 * popularity,
        )
        .otherwise(0.50 + 0.20 * (popularity - 0.50))
    )


def intent_fit(label: Column, norm_price: Column, discount: Column, rating: Column,
               popularity: Column, vector_score: Column, confidence: Column) -> Column:
    stars = rating / 5
    return confidence * _clip(
        F.when(label == "price_sensitive", 1 - norm_price + discount * K.DISCOUNT_LIFT)
        .when(label == "premium", 0.60 * stars + 0.40 * norm_price)
        .when(label == "gift", 0.50 * stars + 0.50 * popularity)
        .when(label == "urgent_buy", popularity)
        .otherwise(vector_score)
    )


def weight(name: str, override: Column, label: Column) -> Column:
    """Weight of one signal: the request's own map if it has entries, else the label's table."""
    base = K.BASE_WEIGHTS[name]
    table = F
    for known, weights in K.LABEL_WEIGHTS.items():
        table = table.when(label == known, F.lit(weights[name]))
    own = F.coalesce(F.try_element_at(override, F.lit(name)), F.lit(base))
    return F.when(F.size(override) > 0, own).otherwise(table.otherwise(F.lit(base)))


def penalised(score: Column, vector_score: Column) -> Column:
    """Soft relevance floor: weakly matching items keep 30% of the score."""
    return F.when(vector_score < K.RELEVANCE_FLOOR, score * K.RELEVANCE_PENALTY).otherwise(score)
