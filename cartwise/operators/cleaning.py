"""Cleaning of retail transaction lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwise.operators.quantiles import exact_quantile, quantiles_of_staged, value_counts
from cartwise.session import stage

KEY = ["invoice", "stock_code", "customer_id"]
OUTLIER_PROB = 0.99


def _has_fields() -> Column:
    price_known = F.col("price").isNotNull() & ~F.isnan("price")
    return (
        F.col("customer_id").isNotNull() & F.col("invoice_ts").isNotNull()
        & F.col("quantity").isNotNull() & price_known
    )


def _is_sale() -> Column:
    return (F.col("quantity") > 0) & (F.col("price") > 0)


def valid_sales(tx: DataFrame) -> DataFrame:
    return tx.filter(_has_fields()).filter(_is_sale())


def first_lines(tx: DataFrame) -> DataFrame:
    """First line per invoice, product and customer, in file order (``line_no``).

    The order is completed by every column used later, so that equal line numbers still give one
    answer, in the price branch and in the main branch of a job. The rank
    limit runs before the shuffle too: a key that repeats without end sends one row per task. The key
    is one column, lest a partitioning by invoice be taken over: a single invoice may be very large.
    """
    slim = tx.select(F.struct(*KEY).alias("_key"), "line_no", "quantity", "price", "invoice_ts")
    order = Window.partitionBy("_key").orderBy("line_no", "quantity", "price", "invoice_ts")
    first = slim.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1")
    return first.select("_key.*", "line_no", "quantity", "price", "invoice_ts")


def clean_transactions(tx: DataFrame) -> DataFrame:
    """Complete sales, one line per invoice and product, without the dearest one percent.

    The lines are staged: the ceiling needs all of them before the first is let through.
    """
    lines = stage(first_lines(valid_sales(tx)), "first-lines")
    ceiling = exact_quantile(lines, "price", OUTLIER_PROB)
    return lines.filter(F.col("price") <= ceiling).withColumn("amount", F.col("quantity") * F.col("price"))


def cleaning_funnel(tx: DataFrame) -> DataFrame:
    """Rows left after every cleaning stage, and rows removed by it."""
    scan = tx.agg(
        F.count("*").alias("initial"),
        F.count_if(_has_fields()).alias("complete"),
        F.count_if(_has_fields() & _is_sale()).alias("positive"),
    )
    prices = stage(value_counts(first_lines(valid_sales(tx)), ["price"]), "price-counts")
    ceiling = quantiles_of_staged(prices, [OUTLIER_PROB]).select("value").scalar()
    tail = prices.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("unique"),
        F.coalesce(F.sum(F.when(F.col("value") <= ceiling, F.col("n"))), F.lit(0)).alias("final"),
    )

    def stages(df: DataFrame, first: int) -> DataFrame:
        return df.select(F.inline(F.array(*[
            F.struct(F.lit(first + i).alias("step"), F.lit(c).alias("stage"), F.col(c).cast("long").alias("n_rows"))
            for i, c in enumerate(df.columns)
        ])))

    five = stages(scan, 1).unionByName(stages(tail, 4))
    earlier = F.lag("n_rows").over(Window.orderBy("step"))  # five rows
    return five.withColumn("removed", F.coalesce(earlier - F.col("n_rows"), F.lit(0)))


def transaction_summary(clean: DataFrame) -> DataFrame:
    """Size, customers and date range of cleaned transactions."""
    per_customer = clean.groupBy("customer_id").agg(
        F.count("*").alias("n"), F.min("invoice_ts").alias("first"), F.max("invoice_ts").alias("last")
    )
    return per_customer.agg(
        F.sum("n").alias("transactions"), F.count("*").alias("customers"),
        F.min("first").alias("first_ts"), F.max("last").alias("last_ts"),
    )
