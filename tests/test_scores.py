import math

import pytest
from pyspark.sql import functions as F

from cartwise.functions import scores
from cartwise.operators import churn, sessions
from cartwise.operators.rfm import FEATURES

SESSION = ["product_visit_count", "time_on_product_page", "cart_add_events", "scroll_depth", "avg_spend_score", "session_recency"]
# visits, time, cart, scroll, spend, recency -> score, bucket, dominant signal, contributions
INTENT = [
    ((0, 0, 0, 0, 0, 0), 0.0, "churn_risk", "time_on_product_page", [0, 0, 0, 0, 0, 0]),
    ((2, 18, 0, .2, .3, 24), 27.92, "churn_risk", "session_recency", [.03, .0541, 0, .02, .045, .13]),
    ((12, 95, 3, .8, .7, 2), 76.79, "interested_hesitant", "time_on_product_page", [.1583, .1264, .15, .08, .105, .1482]),
    ((5, 20, 5, .4, .5, 1), 63.66, "interested_hesitant", "cart_add_events", [.0333, .0883, .25, .04, .075, .15]),
    ((50, 1000, 20, 2.5, 120, -5), 100.0, "hot_buyer", "cart_add_events", [.2, .15, .25, .1, .15, .15]),
]
# days, orders, value -> published probability, calibrated, legacy
CHURN = [
    (2, 12, 120, .2009, .2009, .3670), (20, 5, 75, .4239, .4239, .4439), (60, 2, 40, .9488, .6787, .5186),
    (180, 1, 20, 1.0, .7660, .6637), (1, 30, 150, .0544, .0544, .2531), (0, 1, 50, .4160, .4160, .4544),
    (5, 50, 10, .2122, .2122, .2015), (45, 2, 500, .5545, .4520, .3181), (365, 100, 200, 1.0, .3200, .4400),
    (3, 1, 200, .2793, .2793, .3977), (10, 5, 0, .4544, .4544, .4630), (30, 3, 10000, .3713, .3713, .2961),
    (1, 1, 25, .4454, .4454, .4655), (365, 5, 75, .9955, .6550, .7420), (14, 10, 100, .3022, .3022, .3993),
]


def test_intent_cases(spark):
    df = spark.createDataFrame([(i, *map(float, c[0])) for i, c in enumerate(INTENT)], ["i", *SESSION])
    rows = {r.i: r for r in sessions.intent_score(df).collect()}
    for i, (_, score, bucket, dominant, parts) in enumerate(INTENT):
        assert (rows[i].intent_score, rows[i].score_bucket, rows[i].dominant_signal) == (score, bucket, dominant)
        assert [rows[i].contributions[n] for n in scores.SIGNALS] == pytest.approx(parts, abs=1e-9)


def test_signal_edges(spark):
    cases = [None, math.nan, -3.0, 0.0, 0.5, 1.0, 1.5, 120.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(cases)], "i int, v double")
    v = F.col("v")
    out = {r.i: r for r in df.select(
        "i", scores.recency_signal(v).alias("recency"), scores.spend_signal(v).alias("spend"),
        scores.visit_signal(v).alias("visit"), scores.clamp01(v).alias("clamp")).collect()}
    assert [out[i].recency for i in (0, 1, 3, 4, 5)] == [0, 0, 0, .5, 1]
    assert out[2].recency == 1.0 and out[7].recency == pytest.approx(math.exp(-5 / 7))
    assert out[6].spend == pytest.approx(.015) and out[5].spend == 1.0
    assert [out[i].visit for i in (0, 1, 2, 3)] == [0, 0, 0, 0]
    assert [out[i].clamp for i in range(8)] == [0, 0, 0, 0, .5, 1, 1, 1]


def test_text_is_zero(spark):
    df = spark.createDataFrame([("abc",), ("0.25",)], "v string")
    assert [r[0] for r in df.select(scores.clamp01(F.col("v"))).collect()] == [0.0, 0.25]


def test_missing_feature_column_is_zero(spark):
    df = spark.createDataFrame([(5.0,)], "cart_add_events double")
    row = sessions.intent_score(df).first()
    assert row.intent_score == 25.0 and row.dominant_signal == "cart_add_events"
    assert sessions.normalize_signals(df).first().scroll_depth == 0.0


def test_churn_cases(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CHURN)], ["i", *FEATURES, "published", "calibrated", "legacy"])
    p = scores.legacy_risk(*[F.col(c) for c in FEATURES])
    for r in churn.churn_response(df.withColumn("l", F.round(p, 4))).collect():
        assert r.churn_probability == r.calibrated and r.l == r.legacy
        assert r.published >= r.churn_probability
        assert all(0 <= x <= 1 for x in r.rfm_breakdown)


def test_tiers_use_the_unrounded_probability(spark):
    df = spark.createDataFrame([(0.79999,), (0.8,), (0.6,), (0.3,), (0.29999,)], "p double")
    levels = df.select(scores.risk_level(F.col("p")), scores.risk_action(F.col("p"))).collect()
    assert [tuple(r) for r in levels] == [
        ("high", "win_back_pricing"), ("critical", "win_back_pricing"), ("high", "win_back_pricing"),
        ("medium", "retention_offer"), ("low", "none")]


def test_churn_error_row(spark):
    df = spark.createDataFrame([("x", "1", "2"), (None, "1", "2"), ("1", "30", "150")], ", ".join(f"{c} string" for c in FEATURES))
    bad, missing, good = churn.churn_response(df).collect()
    for r in (bad, missing):
        assert (r.churn_probability, r.churn_risk_level, r.recommended_action) == (0.0, "error", "none")
        assert tuple(r.rfm_breakdown) == (0.0, 0.0, 0.0)
    assert good.churn_probability == 0.0544


def test_monotone_in_recency_and_frequency(spark):
    df = spark.range(0, 120).selectExpr("id AS d", "id AS o")
    by_days = [r[0] for r in df.orderBy("d").select(scores.calibrated_risk(F.col("d"), F.lit(5), F.lit(50.0))).collect()]
    by_orders = [r[0] for r in df.orderBy("o").select(scores.calibrated_risk(F.lit(30), F.col("o"), F.lit(50.0))).collect()]
    assert by_days == sorted(by_days) and by_orders == sorted(by_orders, reverse=True)
