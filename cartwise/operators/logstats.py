"""Traffic, latency and error statistics of request and step logs.

Every function takes a batch or a streaming frame; for a stream set the watermark before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise import constants as K

WINDOW = "1 hour"
WINDOW_SECONDS = 3600


def status_family(status: Column) -> Column:
    out = F
    for low, name in ((200, "2xx"), (300, "3xx"), (400, "4xx"), (500, "5xx")):
        out = out.when((status >= low) & (status < low + 100), F.lit(name))
    return out.otherwise(F.lit("other"))


def _windowed(log: DataFrame, by: list[str]):
    return log.groupBy(F.window("ts", WINDOW).alias("w"), *by)


def _head(by: list[str]) -> list:
    return [F.col("w.start").alias("window_start"), *by]


def traffic_rate(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Requests per second and window, in total or per label."""
    by = by or []
    counts = _windowed(log, by).agg(F.count("*").alias("requests"))
    return counts.select(*_head(by), "requests", (F.col("requests") / WINDOW_SECONDS).alias("per_second"))


def mean_duration(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    sums = _windowed(log, by).agg(F.sum("duration_s").alias("s"), F.count("duration_s").alias("n"))
    return sums.select(*_head(by), F.try_divide("s", "n").alias("mean_duration_s"))


def ratios(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of 2xx, and of 4xx or 5xx."""
    by = by or []
    family = status_family(F.col("status"))
    counts = _windowed(log, by).agg(
        F.count("*").alias("n"), F.count_if(family == "2xx").alias("ok"),
        F.count_if(family.isin("4xx", "5xx")).alias("bad"),
    )
    return counts.select(*_head(by), (F.col("ok") / F.col("n")).alias("success_ratio"),
                         (F.col("bad") / F.col("n")).alias("error_ratio"))


def label_rates(counters: DataFrame, by: list[str]) -> DataFrame:
    """Increments per second of labelled counters (columns ts and increment)."""
    sums = _windowed(counters, by).agg(F.sum("increment").alias("increments"))
    return sums.select(*_head(by), "increments", (F.col("increments") / WINDOW_SECONDS).alias("per_second"))


def histogram_quantile(log: DataFrame, q: float, bounds: list[float], by: list[str] | None = None) -> DataFrame:
    """Quantile of durations from cumulative bucket counts, linear inside the bucket.

    Only one count per bucket is kept per window and label. Beyond the last bound the last bound is
    returned.
    """
    by = by or []
    counts = _windowed(log, by).agg(
        F.count("duration_s").alias("n"),
        *[F.count_if(F.col("duration_s") <= b).alias(f"le_{i}") for i, b in enumerate(bounds)],
    )
    rank = F.col("n") * F.lit(q)
    value = F
    for i, bound in enumerate(bounds):
        below = F.col(f"le_{i - 1}") if i else F.lit(0)
        low = bounds[i - 1] if i else 0.0
        inside = F.try_divide(rank - below, F.col(f"le_{i}") - below)
        value = value.when(F.col(f"le_{i}") >= rank, low + (bound - low) * inside)
    value = F.when(F.col("n") > 0, value.otherwise(F.lit(bounds[-1])))
    return counts.select(*_head(by), "n", value.alias("quantile_s"))


def http_p95(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    return histogram_quantile(log, 0.95, K.HTTP_BUCKETS, by)


def step_p95(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    return histogram_quantile(log, 0.95, K.STEP_BUCKETS, by or ["endpoint", "step"])


def problem_lines(log: DataFrame, service: str) -> DataFrame:
    """Lines of one service that mention ERROR or WARNING."""
    line = F.col("line")
    return log.filter((F.col("service") == service) & (line.contains("ERROR") | line.contains("WARNING")))
