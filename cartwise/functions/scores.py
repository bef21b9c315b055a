"""Numeric scores per row: session intent, RFM and churn."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartwise import constants as K


def _f(x: float) -> Column:
    return F.lit(float(x))


def number(col: Column) -> Column:
    """Any input as double; null, NaN and text that is no number become 0."""
    x = col.try_cast("double")
    return F.when(x.isNull() | F.isnan(x), _f(0)).otherwise(x)


def clamp01(col: Column) -> Column:
    return F.greatest(_f(0), F.least(_f(1), number(col)))


def _share(col: Column, cap: float) -> Column:
    """Linear share of ``cap``; nothing at or below zero counts."""
    return clamp01(number(col) / _f(cap))


# --- session signals ------------------------------------------------------------

def visit_signal(col: Column, cap: int = 20) -> Column:
    x = number(col)
    return F.when(x <= 0, _f(0)).otherwise(clamp01(F.log1p(x) / F.log1p(_f(cap))))


def time_signal(col: Column, cap_seconds: int = 120) -> Column:
    return _share(col, cap_seconds)


def cart_signal(col: Column, cap: int = 5) -> Column:
    return _share(col, cap)


def spend_signal(col: Column) -> Column:
    """Shares pass through; anything above one is read as a percentage."""
    x = number(col)
    return clamp01(F.when(x > 1, x / 100).otherwise(x))


def recency_signal(col: Column, decay_days: int = 7) -> Column:
    """Values in 0..1 pass through; others are hours and decay exponentially."""
    x = number(col)
    return F.when(x.between(0, 1), x).otherwise(clamp01(F.exp(-(x / 24) / _f(decay_days))))


SIGNALS = {
    "time_on_product_page": time_signal,
    "product_visit_count": visit_signal,
    "cart_add_events": cart_signal,
    "scroll_depth": clamp01,
    "avg_spend_score": spend_signal,
    "session_recency": recency_signal,
}


def _first_at_least(score: Column, steps: list[tuple], floor, pick: int) -> Column:
    """Value of the first step whose threshold ``score`` reaches."""
    out = F
    for step in steps:
        out = out.when(score >= step[0], F.lit(step[pick]))
    return out.otherwise(F.lit(floor))


def intent_columns(signals: dict[str, Column]) -> dict[str, Column]:
    """Score, bucket, strongest signal and rounded contributions of normalised signals."""
    parts = {name: clamp01(signals[name]) * _f(w) for name, w in K.INTENT_WEIGHTS.items()}
    raw = F.greatest(_f(0), F.least(_f(100), reduce(lambda a, b: a + b, parts.values()) * 100))
    names = F.array(*[F.lit(n) for n in parts])
    rounded = F.array(*[F.round(c, 4) for c in parts.values()])
    # array_position finds the first maximum, so ties go to the earlier signal
    dominant = F.element_at(names, F.array_position(rounded, F.array_max(rounded)).cast("int"))
    return {
        "intent_score": F.round(raw, 2),
        "score_bucket": _first_at_least(raw, K.INTENT_BUCKETS, K.INTENT_BUCKET_FLOOR, 1),
        "dominant_signal": dominant,
        "contributions": F.map_from_arrays(names, rounded),
    }


# --- RFM and churn ----------------------------------------------------------------

def rfm_scores(days: Column, orders: Column, value: Column) -> tuple[Column, Column, Column]:
    """Recency, frequency and monetary scores in 0..1, higher is better."""
    return (
        clamp01(1 - number(days) / _f(365)),
        clamp01(number(orders) / _f(50)),
        clamp01(number(value) / _f(500)),
    )


def rfm_risk(days: Column, orders: Column, value: Column,
             max_days: float, max_orders: float, max_value: float) -> Column:
    """Risk in 0..0.8 from RFM on 1..5 scales with the given caps."""
    def scale(x: Column, cap: float) -> Column:
        return F.greatest(_f(1), F.least(_f(5), 1 + number(x) / _f(cap) * 4))

    recency = F.greatest(_f(1), 5 * (1 - F.least(number(days), _f(max_days)) / _f(max_days)))
    w = K.RFM_WEIGHTS
    composite = (
        recency * _f(w["recency"])
        + scale(orders, max_orders) * _f(w["frequency"])
        + scale(value, max_value) * _f(w["monetary"])
    )
    return clamp01(1 - composite / 5)


def calibrated_risk(days: Column, orders: Column, value: Column) -> Column:
    return rfm_risk(days, orders, value, 90, 20, 200)


def legacy_risk(days: Column, orders: Column, value: Column) -> Column:
    return rfm_risk(days, orders, value, 365, 50, 500)


def risk_level(p: Column) -> Column:
    return _first_at_least(p, K.RISK_TIERS, K.RISK_FLOOR[0], 1)


def risk_action(p: Column) -> Column:
    return _first_at_least(p, K.RISK_TIERS, K.RISK_FLOOR[1], 2)


def pressure_label(days: Column, orders: Column, value: Column) -> Column:
    """1 where the weighted lack of recency, frequency and spend exceeds 1.9."""
    r, f, m = rfm_scores(days, orders, value)
    pressure = _f(1.8) * (1 - r) + _f(1.5) * (1 - f) + _f(1.0) * (1 - m)
    return (pressure > _f(1.9)).cast("int")


def churn_label(days: Column, threshold_days: int = K.CHURN_LABEL_DAYS) -> Column:
    return (days > F.lit(threshold_days)).cast("int")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def quantile_score(v: Column, refs: Column, n: int) -> Column:
    """Position of ``v`` in 0..1 among ``n`` ascending reference quantiles.

    A value inside a run of equal references gets the middle of the run; between two references it
    is interpolated.
    """
    below = F.size(F.filter(refs, lambda r: r < v))
    upto = F.size(F.filter(refs, lambda r: r <= v))
    step = _f(n - 1)
    left, right = F.get(refs, upto - 1), F.get(refs, upto)
    between = (upto - 1 + F.try_divide(v - left, right - left)) / step
    return (
        F.when(v <= F.get(refs, F.lit(0)), _f(0))
        .when(v >= F.get(refs, F.lit(n - 1)), _f(1))
        .when(upto > below, (below + upto - 1) / (2 * step))
        .otherwise(between)
    )
