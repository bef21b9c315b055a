import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwise.operators import cleaning, quantiles, rfm

TX = "invoice string, stock_code string, customer_id string, line_no int, quantity int, price double, invoice_ts timestamp_ntz"
T0 = dt.datetime(2024, 1, 1, 23, 0)


@pytest.fixture(scope="module")
def tx(spark):
    rows = [("i%d" % (i // 4), "s%d" % i, "c%d" % (i % 3), i, 1 + i % 3, 1.0 + i, T0 + dt.timedelta(hours=i)) for i in range(40)]
    rows += [
        ("i0", "s0", "c0", 99, 50, 1.0, T0),             # repeats the first line, later in the file
        ("i1", "s9", None, 100, 1, 1.0, T0), ("i1", "s9", "c1", 101, None, 1.0, T0), ("i1", "s9", "c1", 102, 1, None, T0),
        ("i1", "s9", "c1", 103, 1, float("nan"), T0), ("i1", "s9", "c1", 104, 1, 1.0, None),
        ("i1", "s9", "c1", 105, -1, 1.0, T0), ("i1", "s9", "c1", 106, 1, 0.0, T0),
    ]
    return spark.createDataFrame(rows, TX).repartition(5)


def test_funnel_and_clean(tx):
    f = {r.stage: (r.n_rows, r.removed) for r in cleaning.cleaning_funnel(tx).collect()}
    assert f == {"initial": (48, 0), "complete": (43, 5), "positive": (41, 2), "unique": (40, 1), "final": (39, 1)}
    clean = cleaning.clean_transactions(tx)
    assert clean.count() == 39 and clean.filter("stock_code = 's0'").first().quantity == 1
    s = cleaning.transaction_summary(clean).first()
    assert (s.transactions, s.customers, s.first_ts, s.last_ts) == (39, 3, T0, T0 + dt.timedelta(hours=38))


def test_clean_does_not_depend_on_partitions(tx):
    a = {tuple(r) for r in cleaning.clean_transactions(tx).collect()}
    b = {tuple(r) for r in cleaning.clean_transactions(tx.repartition(13, "price")).collect()}
    assert a == b


def test_rfm_counts_whole_days(spark):
    rows = [("a", "i1", T0, 10.0), ("a", "i1", T0, 5.0), ("a", "i2", T0, 5.0), ("b", "i3", T0 + dt.timedelta(hours=2), 7.0),
            ("c", "i4", T0 - dt.timedelta(hours=23), 1.0)]
    clean = spark.createDataFrame(rows, "customer_id string, invoice string, invoice_ts timestamp_ntz, amount double")
    out = {r.customer_id: tuple(r)[1:] for r in rfm.rfm_features(clean).collect()}
    assert out == {"a": (0, 2, 10.0), "b": (0, 1, 7.0), "c": (1, 1, 1.0)}
    later = {r.customer_id: r.days_since_last_purchase for r in rfm.rfm_features(clean, T0 + dt.timedelta(days=9)).collect()}
    assert later == {"a": 9, "b": 8, "c": 9}


def test_label_and_rate(spark):
    df = spark.createDataFrame([(45,), (46,), (91,)], "days_since_last_purchase int")
    assert [r.churn for r in rfm.label_churn(df, 45).collect()] == [0, 1, 1]
    assert tuple(rfm.churn_rate(rfm.label_churn(df)).first()) == (1, 2, pytest.approx(100 / 3))


@pytest.mark.parametrize("values", [
    [3.0], [1.0, 2.0], [5.0] * 7 + [9.0], list(np.random.default_rng(1).normal(0, 1e6, 500)),
    list(np.random.default_rng(2).integers(0, 5, 300).astype(float)), [1e-9, 2e-9, 3e-9, 1e12, -1e12, 0.0],
    [float(x) for x in np.random.default_rng(3).uniform(0, 1e-4, 900)], [0.0] * 400 + [float(i) for i in range(300)]])
@pytest.mark.parametrize("cuts,part", [(64, 100_000), (4, 20)])
def test_exact_quantiles(spark, monkeypatch, values, cuts, part):
    monkeypatch.setattr(quantiles, "CUTS", cuts)
    monkeypatch.setattr(quantiles, "PART", part)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double").repartition(4)
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]
    got = {r.prob: r.value for r in quantiles.exact_quantiles(df, ["x"], probs).collect()}
    assert [got[p] for p in probs] == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)


def test_quantile_transform_with_ties(spark):
    values = [0.0] * 50 + [1.0] * 50 + [2.0 + i for i in range(40)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    refs = quantiles.quantile_refs(df, ["x"])
    want_refs = np.quantile(values, np.linspace(0, 1, 100))
    grid = np.linspace(0, 1, 100)
    asked = [-1.0, 0.0, 0.5, 1.0, 1.5, 10.25, 41.0, 99.0]
    out = rfm.quantile_transform(spark.createDataFrame([(v,) for v in asked], "x double").coalesce(1), refs, ["x"])
    # mean of interpolating forward and backward, ends clipped
    both = [0.5 * (np.interp(v, want_refs, grid) - np.interp(-v, -want_refs[::-1], -grid[::-1])) for v in asked]
    both = [0.0 if v <= 0 else 1.0 if v >= 41 else b for v, b in zip(asked, both)]
    assert [r.x for r in out.collect()] == pytest.approx(both, abs=1e-12)


def test_profile(spark):
    df = spark.createDataFrame([(1, 2, 3.0), (5, 2, 4.0), (9, 8, 10.0)], ["days_since_last_purchase", "total_order_count", "avg_order_value"])
    got = {r.feature: (r.min_value, r.max_value, r.median_value) for r in rfm.rfm_profile(df).collect()}
    assert got == {"days_since_last_purchase": (1, 9, 5), "total_order_count": (2, 8, 2), "avg_order_value": (3, 10, 4)}


def test_one_key_with_most_rows_is_limited_before_the_shuffle(tx):
    plan = cleaning.first_lines(tx)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit", plan.index("WindowGroupLimit") + 1) > plan.index("Exchange")
