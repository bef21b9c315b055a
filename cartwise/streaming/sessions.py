"""Live session intent from an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.operators.sessions import GAP_MINUTES, _event_sums, _signals, intent_score


def live_sessions(events: DataFrame, lateness: str = "1 hour", gap_minutes: int = GAP_MINUTES,
                  view_seconds: float = 1.0, value_scale: float = 1.0) -> DataFrame:
    """Score every session once the watermark has passed its end (append mode).

    Recency is measured at the end of the session window. Sessions still open when a stream stops
    are not emitted; a finite one needs a closing row (``sources.finite``). ``events.ts`` has to be a timestamp with time zone semantics.
    """
    # sessions of a user are merged where they were read first, so a busy user sends few rows
    events.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    sessions = (
        events.withWatermark("ts", lateness)
        .groupBy("user_id", F.session_window("ts", f"{gap_minutes} minutes").alias("w"))
        .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
             *[c.alias(n) for n, c in _event_sums(view_seconds).items()])
    )
    features = sessions.select("user_id", F.col("first_ts").alias("session_start"),
                               F.col("last_ts").alias("session_end"), *_signals(F.col("w.end"), value_scale))
    return intent_score(features)
