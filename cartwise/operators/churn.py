"""Churn probability, tier and action per customer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.functions import scores
from cartwise.operators.rfm import FEATURES


def _inputs() -> list[Column]:
    return [F.col(c) for c in FEATURES]


def _usable() -> Column:
    return reduce(lambda a, b: a & b, [c.try_cast("double").isNotNull() for c in _inputs()])


def churn_response(df: DataFrame, ml_probability: Column | None = None,
                   model_type: str | None = None) -> DataFrame:
    """Add the response columns to a frame with the three RFM features.

    The larger of model and formula probability decides; without a model the formula alone. Rows
    with a missing or non-numeric feature get the error response instead of failing the job.
    """
    days, orders, value = _inputs()
    formula = scores.calibrated_risk(days, orders, value)
    p = formula if ml_probability is None else F.greatest(scores.number(ml_probability), formula)
    ok = _usable()
    names = ["recency_score", "frequency_score", "monetary_score"]
    parts = [F.when(ok, F.round(s, 4)).otherwise(F.lit(0.0)).alias(n)
             for n, s in zip(names, scores.rfm_scores(days, orders, value))]
    staged = df.withColumn("_p", F.when(ok, p))
    p = F.col("_p")
    known = p.isNotNull()
    return staged.withColumns({
        "churn_probability": F.coalesce(F.round(p, 4), F.lit(0.0)),
        "churn_risk_level": F.when(known, scores.risk_level(p)).otherwise(F.lit("error")),
        "rfm_breakdown": F.struct(*parts),
        "recommended_action": F.when(known, scores.risk_action(p)).otherwise(F.lit("none")),
        "model_type": F.when(known, F.lit(model_type).cast("string")),
    }).drop("_p")


def risk_distribution(responses: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Customers and probability range per tier, overall or per segment."""
    return responses.groupBy(*(by or []), "churn_risk_level").agg(
        F.count("*").alias("customers"),
        F.min("churn_probability").alias("min_probability"),
        F.max("churn_probability").alias("max_probability"),
        F.avg("churn_probability").alias("mean_probability"),
    )
