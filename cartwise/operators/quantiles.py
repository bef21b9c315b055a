"""Exact quantiles without gathering the values in one task.

``percentile`` merges every distinct value of a column in one reducer, which a column of 10^10
distinct prices does not survive. Here equal values are counted first (combined before the shuffle).
The distinct values of a column are cut at approximate quantiles of their own into ``CUTS`` parts of
about equal size, whatever their distribution; only parts in which a wanted rank falls are looked at
again, and cut again, until a part has at most ``PART`` distinct values. Such a part is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwise.session import stage

CUTS = 64
PART = 100_000


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (feature, value, n) for all non-null, non-NaN values of ``columns``."""
    if len(columns) == 1:
        long = df.select(F.lit(columns[0]).alias("feature"), F.col(columns[0]).cast("double").alias("value"))
    else:
        pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]
        long = df.select(F.inline(F.array(*pairs)))
    kept = long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return kept.groupBy("feature", "value").agg(F.count("*").alias("n"))


def _inside(counts: DataFrame, parts: DataFrame) -> DataFrame:
    """Values with the part they lie in: above ``low`` and up to ``high``, null for no bound.

    There are at most two parts per feature and probability, a bound of the arguments, not of the data.
    """
    p = parts.select(F.col("feature").alias("_feature"), "low", "high", "base")
    within = (F.col("feature") == F.col("_feature")) & (F.col("low").isNull() | (F.col("value") > F.col("low"))) & (
        F.col("high").isNull() | (F.col("value") <= F.col("high")))
    return counts.join(F.broadcast(p), within).drop("_feature")


def _nth(rows: DataFrame, bounds: str, value: str) -> DataFrame:
    """Add ``nth``: how many of the ascending ``bounds``, fewer than ``CUTS``, are below ``value``, by halving."""
    out, step = rows.withColumn("nth", F.lit(0)), 1 << (CUTS - 1).bit_length()
    while step := step // 2:
        below = F.coalesce(F.get(bounds, F.col("nth") + (step - 1)) < F.col(value), F.lit(False))
        out = out.withColumn("nth", F.col("nth") + F.when(below, step).otherwise(0))
    return out


def _cut(counts: DataFrame, parts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Parts cut into smaller ones, as far as a wanted rank (feature, rank) lies in them."""
    key = ["feature", "low"]
    inside = _inside(counts, parts)
    steps = [i / CUTS for i in range(1, CUTS)]
    bounds = inside.groupBy("feature", "low").agg(F.array_distinct(F.percentile_approx("value", steps, 10_000)).alias("bounds"))
    bounds = stage(bounds.select(F.col("feature").alias("_feature"), F.col("low").alias("_low"), "bounds"), "bounds")
    own = (F.col("feature") == F.col("_feature")) & F.col("low").eqNullSafe(F.col("_low"))
    placed = _nth(inside.join(F.broadcast(bounds), own), "bounds", "value")
    # the array is joined again, as a key it would be hashed with every value
    sums = placed.groupBy(*key, "high", "base", "nth").agg(F.sum("n").alias("n")).join(F.broadcast(bounds), own)
    before = Window.partitionBy("feature", "low").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    fresh = sums.select(
        "feature", F.when(F.col("nth") == 0, F.col("low")).otherwise(F.get("bounds", F.col("nth") - 1)).alias("low"),
        F.coalesce(F.get("bounds", F.col("nth")), "high").alias("high"), (F.col("base") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("base"), "n")
    holds = (F.col("rank") >= F.col("base")) & (F.col("rank") < F.col("base") + F.col("n"))
    return fresh.join(F.broadcast(wanted), "feature").filter(holds).select("feature", "low", "high", "base").distinct()


def quantiles_of_counts(counts: DataFrame, probs: list[float]) -> DataFrame:
    """Linearly interpolated quantiles of a ``value_counts`` frame: (feature, prob, value)."""
    return quantiles_of_staged(stage(counts, "value-counts"), probs)


def quantiles_of_staged(counts: DataFrame, probs: list[float]) -> DataFrame:
    """``quantiles_of_counts`` of a frame that is a table already; it is read several times."""
    grid = F.array(*[F.lit(float(p)) for p in probs])
    total = counts.groupBy("feature").agg(F.sum("n").alias("total"))
    lower = F.transform(grid, lambda p: F.floor(p * (F.col("total") - 1)))
    upper = F.transform(lower, lambda r: F.least(r + 1, F.col("total") - 1))
    wanted = stage(total.select("feature", "total", F.explode(F.array_union(lower, upper)).alias("rank")), "ranks")
    none = F.lit(None).cast("double")
    parts = total.select("feature", none.alias("low"), none.alias("high"), F.lit(0).cast("long").alias("base"))
    largest = None
    while True:
        size = _inside(counts, parts).groupBy("feature", "low").count().agg(F.max("count")).first()[0] or 0
        if size <= PART or size == largest:  # one value cannot be cut, and is counted once
            break
        largest, parts = size, stage(_cut(counts, parts, wanted), "parts")
    inside = Window.partitionBy("feature", "low").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = _inside(counts, parts).withColumn("start", F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    holds = (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("n"))
    by_rank = placed.join(F.broadcast(wanted), "feature").filter(holds).groupBy("feature").agg(
        F.first("total").alias("total"),
        F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"),
    )
    asked = by_rank.select("feature", "total", "at", F.explode(grid).alias("prob")).withColumn(
        "h", F.col("prob") * (F.col("total") - 1)
    )
    low = F.element_at("at", F.floor("h"))
    high = F.element_at("at", F.least(F.floor("h") + 1, F.col("total") - 1))
    return asked.select("feature", "prob", (low + (F.col("h") - F.floor("h")) * (high - low)).alias("value"))


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    return quantiles_of_counts(value_counts(df, columns), probs)


def exact_quantile(df: DataFrame, column: str, prob: float) -> Column:
    """One quantile as a scalar column, usable in any expression over ``df`` or another frame."""
    return exact_quantiles(df, [column], [prob]).select("value").scalar()


def quantile_refs(df: DataFrame, columns: list[str], n: int = 100) -> DataFrame:
    """Per feature the ascending array of ``n`` evenly spaced quantiles."""
    grid = exact_quantiles(df, columns, [i / (n - 1) for i in range(n)])
    ordered = F.array_sort(F.collect_list(F.struct("prob", "value")))
    return grid.groupBy("feature").agg(F.transform(ordered, lambda s: s["value"]).alias("refs"))
