"""Recency, frequency and monetary features per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise import constants as K
from cartwise.functions import scores
from cartwise.operators.quantiles import exact_quantiles
from cartwise.session import stage

FEATURES = ["days_since_last_purchase", "total_order_count", "avg_order_value"]


def customer_totals(clean: DataFrame) -> DataFrame:
    """Last purchase, distinct invoices and spend per customer.

    Summed per invoice first, then per customer: a customer holding a large share of all lines is
    spread over the invoices and combined before the second shuffle.
    """
    per_invoice = clean.groupBy("customer_id", "invoice").agg(
        F.max("invoice_ts").alias("last_ts"), F.sum("amount").alias("spend")
    )
    return per_invoice.groupBy("customer_id").agg(
        F.max("last_ts").alias("last_ts"), F.count("invoice").alias("orders"), F.sum("spend").alias("spend")
    )


def rfm_features(clean: DataFrame, as_of=None) -> DataFrame:
    """One row per customer. Recency counts whole days up to ``as_of`` (a column or value); without
    it up to the latest purchase, for which the per-customer table is staged once."""
    totals = customer_totals(clean)
    if as_of is None:
        totals = stage(totals, "customer-totals")
        as_of = totals.agg(F.max("last_ts")).scalar()
    elif not hasattr(as_of, "alias"):
        as_of = F.lit(as_of)
    return totals.select(
        "customer_id",
        F.timestamp_diff("DAY", F.col("last_ts"), as_of).alias("days_since_last_purchase"),
        F.col("orders").alias("total_order_count"),
        (F.col("spend") / F.col("orders")).alias("avg_order_value"),
    )


def rfm_profile(rfm: DataFrame) -> DataFrame:
    """Minimum, maximum and median of the three features."""
    q = exact_quantiles(rfm, FEATURES, [0.0, 0.5, 1.0])
    at = {name: F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name)
          for name, p in (("min_value", 0.0), ("max_value", 1.0), ("median_value", 0.5))}
    return q.groupBy("feature").agg(*at.values())


def label_churn(rfm: DataFrame, threshold_days: int = K.CHURN_LABEL_DAYS) -> DataFrame:
    return rfm.withColumn("churn", scores.churn_label(F.col("days_since_last_purchase"), threshold_days))


def churn_rate(labelled: DataFrame) -> DataFrame:
    return labelled.agg(
        F.sum("churn").alias("churned"),
        F.sum(1 - F.col("churn")).alias("retained"),
        (F.avg("churn") * 100).alias("churn_pct"),
    )


def quantile_transform(df: DataFrame, refs: DataFrame, columns: list[str], n: int = 100) -> DataFrame:
    """Replace every column by its position among the reference quantiles of ``quantile_refs``."""
    held = {c: f"_refs_{c}" for c in columns}
    one_row = refs.agg(*[F.max(F.when(F.col("feature") == c, F.col("refs"))).alias(h) for c, h in held.items()])
    with_refs = df.join(F.broadcast(one_row))
    return with_refs.withColumns({
        c: scores.quantile_score(F.col(c).cast("double"), F.col(h), n) for c, h in held.items()
    }).drop(*held.values())
