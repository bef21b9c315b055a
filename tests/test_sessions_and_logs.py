import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cartwise.operators import logstats as L, sessions as S, validate as W
from cartwise.streaming import product_vectors as PV, sessions as live, sources
from cartwise.plans import embedding
from cartwise.session import shared_path

T0 = dt.datetime(2024, 1, 1)
KINDS = ["view", "click", "purchase", "signup", "error"]


@pytest.fixture(scope="module")
def events(spark):
    rng, rows = random.Random(5), []
    for user in range(6):
        t = T0
        for _ in range(200 if user else 600):
            t += dt.timedelta(minutes=rng.choice([0, 1, 5, 29, 30, 31, 90]), microseconds=rng.choice([0, 1]))
            rows.append((user, t, rng.choice(KINDS), float(rng.randint(0, 300))))
    return spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_type string, value double").repartition(7)


def test_sessions_equal_session_window(events):
    got = S.session_features(events, F.lit(T0).cast("timestamp_ntz"))
    want = events.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(
        F.min("ts").alias("a"), F.max("ts").alias("b"), F.count_if(F.col("event_type") == "view").alias("v"),
        F.count_if(F.col("event_type") == "click").alias("c"))
    a = sorted((r.user_id, r.session_start, r.session_end, r.product_visit_count, r.cart_add_events) for r in got.collect())
    b = sorted((r.user_id, r.a, r.b, r.v, r.c) for r in want.collect())
    assert a == b


def test_recency_counts_from_the_last_event_of_all(events):
    last = events.agg(F.max("ts")).first()[0]
    for r in S.session_features(events).limit(20).collect():
        assert r.session_recency == pytest.approx((last - r.session_end).total_seconds() / 3600)


def test_live_sessions_equal_closed_batch_sessions(spark, sf):
    stream = sources.run_to_table(live.live_sessions(sources.stream_table(spark, sf, "events")), "live")
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = S.session_features(events)
    got = {(r.user_id, r.session_start): (r.product_visit_count, r.cart_add_events, round(r.scroll_depth, 9)) for r in stream.collect()}
    want = {(r.user_id, r.session_start): (r.product_visit_count, r.cart_add_events, round(r.scroll_depth, 9)) for r in batch.collect()}
    open_ones = set(want) - set(got)
    assert got == {k: v for k, v in want.items() if k not in open_ones}
    last = max(k[1] for k in want)
    assert all(last - k[1] < dt.timedelta(hours=6) for k in open_ones)


def test_vector_stream_keeps_newest_and_survives_a_repeat(spark, tmp_path):
    schema = "product_id string, name string, version long"
    vocab = embedding.fit_products(spark.createDataFrame([("x", "red shoe"), ("y", "blue hat")], "product_id string, name string"))
    src, table, check = str(tmp_path / "in"), shared_path(spark, "vt"), shared_path(spark, "vc")

    def push(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        PV.upsert_stream(spark.readStream.schema(schema).parquet(src), vocab, table, check).awaitTermination()

    push([("a", "red", 1), ("a", "shoe", 2), ("b", "hat", 1)])
    push([("b", "blue", 5), ("c", "none", 1)])
    now = {r.product_id: r for r in PV.current_vectors(spark, table).collect()}
    assert (now["a"].version, now["b"].version, now["c"].entries) == (2, 5, [])
    other = shared_path(spark, "vt2")
    PV.compact(spark, table, other)
    assert PV.current_vectors(spark, other).count() == 3


def test_status_families(spark):
    df = spark.createDataFrame([(s,) for s in (200, 299, 301, 404, 422, 500, 599, 600, 100)], "s int")
    got = [r[0] for r in df.select(L.status_family(F.col("s"))).collect()]
    assert got == ["2xx", "2xx", "3xx", "4xx", "4xx", "5xx", "5xx", "other", "other"]


def test_histogram_quantile_and_rates(spark):
    rows = [(T0 + dt.timedelta(minutes=i % 60), "/a" if i % 2 else "/b", 200 if i % 4 else 500, .02 + i / 1000) for i in range(100)]
    rows += [(T0 + dt.timedelta(hours=1), "/a", 404, 99.0)]
    log = spark.createDataFrame(rows, "ts timestamp_ntz, path string, status int, duration_s double")
    first, second = L.http_p95(log).orderBy("window_start").collect()
    assert first.quantile_s == pytest.approx(.1 + .15 * (95 - 81) / (100 - 81)) and second.quantile_s == 10.0
    r = L.ratios(log).orderBy("window_start").collect()
    assert (r[0].success_ratio, r[0].error_ratio, r[1].success_ratio, r[1].error_ratio) == (.75, .25, 0.0, 1.0)
    rate = L.traffic_rate(log, ["path"]).filter("path = '/b'").first()
    assert rate.requests == 50 and rate.per_second == pytest.approx(50 / 3600)
    assert L.mean_duration(log).orderBy("window_start").first().mean_duration_s == pytest.approx(.0695)
    inc = L.label_rates(log.withColumn("increment", F.lit(2)), ["path"]).orderBy(F.desc("increments")).first()
    assert inc.increments == 100


def test_log_filter(spark):
    df = spark.createDataFrame([("s", "x ERROR y"), ("s", "WARNING"), ("s", "error"), ("t", "ERROR")], "service string, line string")
    assert [r.line for r in L.problem_lines(df, "s").collect()] == ["x ERROR y", "WARNING"]


def test_row_contracts(spark):
    rows = [("q", "0.5", "20"), (None, "0.5", "20"), ("q", "1.5", "20"), ("q", "abc", "20"), ("q", None, None), ("q", "0", "0"), ("q", "1", "100")]
    got = W.check(spark.createDataFrame(rows, "query string, churn_score string, top_k string"), W.search_request_rules())
    assert [r.reason for r in got.collect()] == [None, "query:string", "churn_score:0.0..1.0", "churn_score:0.0..1.0", None, "top_k:1..100", None]
    assert W.valid(got).count() == 3 and sum(r.n_rows for r in W.reason_counts(got).collect()) == 4
    parsed = W.parse_json(spark.createDataFrame([('{"k": 3}',), ("nonsense",), ('{"k": "x"}',)], "j string"), "j", "k bigint")
    assert [r.k for r in parsed.collect()] == [3, None, None]
    churn = W.check(spark.createDataFrame([("1", "2", "3"), ("1", "2", "x")], "days_since_last_purchase string, total_order_count string, avg_order_value string"), W.churn_request_rules())
    assert [r.reason for r in churn.collect()] == [None, "avg_order_value:double"]


def test_whole_numbers_and_nested_shapes(spark):
    rows = spark.createDataFrame([(2.0,), (2.5,), (None,)], "days_since_last_purchase double").selectExpr("*", "1 AS total_order_count", "1.5 AS avg_order_value")
    assert [r.reason for r in W.check(rows, W.churn_request_rules()).orderBy("days_since_last_purchase").collect()] == [
        "days_since_last_purchase:bigint", None, "days_since_last_purchase:bigint"]
    shape = ("user_vector array<double>, candidates array<struct<product_id:string,keyword_score:double>>, "
             "search_intent struct<label:string,confidence:double>")
    rows = spark.createDataFrame([([1.0], [("a", .5)], None), (None, [], None), ([], [("a", None)], None), ([], None, None), ([], [], ("x", None))], shape)
    assert [r.reason for r in W.check(rows.coalesce(1), W.rerank_request_rules()).collect()] == [
        None, "user_vector:required", "candidates:product_id,keyword_score", "candidates:product_id,keyword_score", "search_intent:label,confidence"]
