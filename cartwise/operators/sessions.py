"""Sessions of user events and their purchase-intent score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwise import constants as K
from cartwise.functions import scores

GAP_MINUTES = 30


def _event_sums(view_seconds: float = 1.0) -> dict[str, Column]:
    """Sums that can be added up over parts of a session. ``view_seconds`` on the page per unit of a view's value."""
    view, click, buy = (F.col("event_type") == t for t in ("view", "click", "purchase"))
    value = F.col("value")
    return {
        "views": F.count_if(view),
        "view_seconds": F.sum(F.when(view, value * view_seconds).otherwise(F.lit(0.0))),
        "clicks": F.count_if(click),
        "value_sum": F.sum(value),
        "value_n": F.count(value),
        "buy_sum": F.sum(F.when(buy, value)),
        "buy_n": F.count(F.when(buy, value)),
    }


def _signals(as_of: Column, value_scale: float = 1.0) -> list[Column]:
    """Raw session features from the summed columns and ``last_ts``. ``value_scale`` is a full scroll or spend."""
    hours = F.timestamp_diff("MICROSECOND", F.col("last_ts"), as_of) / 3.6e9
    zero = F.lit(0.0)
    return [
        F.col("views").cast("double").alias("product_visit_count"),
        F.col("view_seconds").alias("time_on_product_page"),
        F.col("clicks").cast("double").alias("cart_add_events"),
        F.coalesce(F.try_divide("value_sum", "value_n") / value_scale, zero).alias("scroll_depth"),
        F.coalesce(F.try_divide("buy_sum", "buy_n") / value_scale, zero).alias("avg_spend_score"),
        hours.alias("session_recency"),
    ]


def session_sums(events: DataFrame, gap_minutes: int = GAP_MINUTES, view_seconds: float = 1.0) -> DataFrame:
    """Sums of each session: events of a user at most ``gap_minutes`` apart; first and last time.

    Events are first summed per user and time slot as long as the gap. Two events of one slot always
    belong together, so this loses nothing, combines before the shuffle, and leaves even the busiest
    user with one row per slot. Only these rows are ordered per user to find the gaps.
    """
    gap_us = gap_minutes * 60_000_000
    ts = F.col("ts").cast("timestamp_ntz")
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)
    slots = (
        events.withColumn("ts", ts)
        .groupBy("user_id", (us - F.pmod(us, F.lit(gap_us))).alias("slot"))
        .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
             *[c.alias(n) for n, c in _event_sums(view_seconds).items()])
    )
    by_user = Window.partitionBy("user_id").orderBy("slot")
    idle = F.timestamp_diff("MICROSECOND", F.lag("last_ts").over(by_user), F.col("first_ts"))
    marked = slots.withColumn("opens", F.when(idle <= gap_us, 0).otherwise(1)).withColumn(
        "session_no", F.sum("opens").over(by_user)
    )
    return marked.groupBy("user_id", "session_no").agg(
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        *[F.sum(n).alias(n) for n in _event_sums()],
    )


def features_of_sums(sums: DataFrame, as_of: Column, value_scale: float = 1.0) -> DataFrame:
    return sums.select("user_id", F.col("first_ts").alias("session_start"),
                       F.col("last_ts").alias("session_end"), *_signals(as_of, value_scale))


def session_features(events: DataFrame, as_of: Column | None = None, gap_minutes: int = GAP_MINUTES,
                     view_seconds: float = 1.0, value_scale: float = 1.0) -> DataFrame:
    """One row per session. Recency is measured at ``as_of``, by default the last event of all."""
    if as_of is None:
        as_of = events.agg(F.max("ts").cast("timestamp_ntz")).scalar()
    return features_of_sums(session_sums(events, gap_minutes, view_seconds), as_of, value_scale)


def normalize_signals(df: DataFrame) -> DataFrame:
    """Raw session features to 0..1; a missing feature column counts as 0."""
    raw = {n: F.col(n) if n in df.columns else F.lit(0.0) for n in scores.SIGNALS}
    return df.withColumns({n: f(raw[n]) for n, f in scores.SIGNALS.items()})


def intent_score(df: DataFrame) -> DataFrame:
    """Add score, bucket, dominant signal and contributions to raw session features."""
    signals = {n: f(F.col(n) if n in df.columns else F.lit(0.0)) for n, f in scores.SIGNALS.items()}
    return df.withColumns(scores.intent_columns(signals))


def bucket_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("score_bucket").agg(
        F.count("*").alias("sessions"), F.avg("intent_score").alias("mean_score")
    )


def contribution_columns(scored: DataFrame) -> list[Column]:
    """Contributions map as one column per signal."""
    return [F.element_at("contributions", F.lit(n)).alias(f"c_{n}") for n in K.INTENT_WEIGHTS]
