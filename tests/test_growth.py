"""Work that must not grow faster than the input: what is answered once, staged once, and not shuffled."""

import pytest
from pyspark.sql import functions as F

from cartwise.operators import cleaning, index, joins, quantiles, retrieval, tfidf, user_state, vector_store
from cartwise.plans import search as S
from cartwise.session import shared_path, stage
from cartwise.sources import tables as T


@pytest.fixture(scope="module")
def catalogue(spark, sf):
    products = stage(T.products(spark, sf), "growth-products")
    return products, index.build_index(products, stage, 5)


def test_texts_of_equal_known_terms_are_answered_once(spark, catalogue):
    products, ix = catalogue
    texts = ["brand ring", "zzqq brand ring", "brand ring under $912", "brand brand ring", "ring brand", "zzqq", "qqzz 7777", "", None]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
    asked, ranked = retrieval.retrieve_vectors(queries, ix)
    keys = {r.query_id: r.qkey for r in asked.collect()}
    assert keys == {0: 0, 1: 0, 2: 0, 3: 3, 4: 0, 5: 5, 6: 5, 7: 5}
    assert {r.qkey: r["count"] for r in ranked.groupBy("qkey").count().collect()} == {0: 5, 3: 5, 5: 5}
    out = retrieval.hybrid_retrieve(queries, ix).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("retrieval_rank", "product_id"))).alias("xs"))
    got = {r.query_id: r.xs for r in out.collect()}
    assert sorted(got) == list(range(8)) and got[0] == got[1] == got[2] and got[5] == got[6] == got[7]


def test_fan_out_equals_join(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK", 4)
    asked = spark.range(60).selectExpr("id", "IF(id < 40, 0, id % 7) AS key")
    lists = spark.range(30).selectExpr("id % 6 AS key", "id AS item")
    got = joins.fan_out(asked, lists, "key", "id")
    assert got.select(joins.PLACE).distinct().count() > 10
    want = asked.join(lists, "key").select("id", "item")
    assert sorted(map(tuple, got.select("id", "item").collect())) == sorted(map(tuple, want.collect()))


def test_candidates_of_requests_are_not_shuffled_again(spark, sf, catalogue):
    products, ix = catalogue
    out = S.search(T.search_requests(spark, sf), ix, products)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan and "hashpartitioning(_place" in plan


def _staged(monkeypatch, module):
    labels = []
    real = module.stage

    def counted(df, label):
        labels.append(label)
        return real(df, label)

    monkeypatch.setattr(module, "stage", counted)
    return labels


def test_first_lines_are_found_once(spark, sf, monkeypatch):
    labels = _staged(monkeypatch, cleaning)
    clean = cleaning.clean_transactions(T.transactions(spark, sf))
    assert labels == ["first-lines"] and "row_number" not in clean._jdf.queryExecution().executedPlan().toString()
    funnel = cleaning.cleaning_funnel(T.transactions(spark, sf))
    assert labels == ["first-lines", "price-counts"] and "_key" not in funnel._jdf.queryExecution().executedPlan().toString()
    counts = {r.stage: r.n_rows for r in funnel.collect()}
    assert counts["final"] == clean.count()


def test_mean_discount_is_exact(spark, tmp_path):
    """Forty lines with a mean of 0.06075, which is below that in doubles, whether added from the front or from the back."""
    percents = [10, 7, 3, 6, 1, 7, 1, 4, 10, 9, 10, 1, 3, 0, 10, 10, 8, 7, 9, 8, 9, 4, 5, 4, 8, 9, 5, 10, 7, 10, 6, 7, 1, 9, 5, 1, 6, 10, 2, 1]
    part = spark.range(1).selectExpr("id AS p_partkey", "'a' AS p_name", "'SMALL' AS p_type", "'b' AS p_brand", "10.0D AS p_retailprice", "1 AS p_size")
    part.write.parquet(f"{tmp_path}/part.parquet")
    for rows in (percents, percents[::-1]):
        lines = spark.createDataFrame([(0, 1.0, p / 100) for p in rows], "l_partkey long, l_quantity double, l_discount double").coalesce(1)
        lines.write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
        assert T.products(spark, str(tmp_path)).first()["discount"] == 0.0608


def test_training_and_answers_share_the_features(spark, sf, monkeypatch):
    from checks.queries import REGISTRY

    labels = _staged(monkeypatch, cleaning)
    assert REGISTRY["churn_train_predict"](spark, sf).count() > 0
    assert labels == ["first-lines"]


def test_vectors_are_not_shuffled_with_rows(spark, monkeypatch):
    """Two products of one vector are one; entries are added up where a user's weights are, by one shuffle by user."""
    from cartwise.operators import rerank_candidates as RC, user_vectors as UV

    vec = "product_id long, entries array<struct<fid:int,weight:double>>"
    vectors = stage(spark.createDataFrame([(1, [(0, 0.6), (2, 0.8)]), (2, [(0, 0.6), (2, 0.8)]), (3, [(1, 1.0)])], vec), "vectors")
    ids, groups = UV.distinct_vectors(vectors)
    assert {r.product_id: r.vid for r in ids.collect()} == {1: 1, 2: 1, 3: 3} and groups.count() == 2
    items = spark.createDataFrame([(7, 1, 1.0), (7, 2, 2.0), (7, 3, 1.0), (7, 9, 4.0), (8, 9, 1.0)], "user_id long, product_id long, weight double")
    users = UV.user_entries(items, vectors)
    got = {r.user_id: [(e.fid, round(e.weight, 9)) for e in r.entries] for r in users.collect()}
    assert got == {7: [(0, 0.225), (1, 0.125), (2, 0.3)], 8: []}
    assert "hashpartitioning(user_id#" in (plan := users._jdf.queryExecution().executedPlan().toString()) and ", fid#" not in "".join(
        line for line in plan.splitlines() if "hashpartitioning" in line)
    asked = stage(users.selectExpr("user_id AS request_id", "entries", "CAST(NULL AS map<string,double>) AS weights", "CAST(NULL AS string) AS label",
                                   "CAST(NULL AS double) AS confidence"), "asked")
    cand = spark.createDataFrame([(7, 1, 1, .0, None, None), (7, 2, 3, .0, None, None), (7, 3, 9, .0, None, None), (8, 1, 1, .0, None, None), (6, 1, 1, .0, None, None)],
                                 "request_id long, position long, product_id long, keyword_score double, semantic_score double, price double")
    rows = {(r.request_id, r.product_id): round(r.cosine_score, 6) for r in RC.rerank_candidates(asked, cand, vectors).collect()}
    assert rows == {(7, 1): 0.948683, (7, 3): 0.316228, (7, 9): 0.0, (8, 1): 0.0}


def test_running_user_sums_are_placed_by_user_alone(spark):
    store = user_state.create(spark, shared_path(spark, "users"))
    items = spark.createDataFrame([(u, p, float(u + p)) for u in range(4) for p in range(6)], "user_id long, product_id long, weight double")
    vector = lambda ids: spark.createDataFrame([(i, [(i % 3, 1.0 + i), (7, 2.0)]) for i in ids], "product_id long, entries array<struct<fid:int,weight:double>>")
    store.add(items, vector(range(3)))
    store.add(items, vector(range(2, 5)))
    got = {(r.user_id, r.fid, r.weight) for r in store.values().collect()}
    assert got and got == {(r.user_id, e.fid, e.weight) for r in store.entries().collect() for e in r.entries}
    by_vector, groups = user_state._with_ids(items, vector(range(6)), "left", False)
    for frame in (store.values(), user_state._weighed(by_vector, groups)):
        placed = [line for line in plan_of(frame).splitlines() if "Exchange hashpartitioning(user_id" in line]
        assert len(placed) == 1 and "fid" not in placed[0]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_values_are_placed_between_bounds_by_halving(spark):
    bounds = {0: [], 1: [2.0], 2: [-1.0, 0.5, 3.0], 63: [float(i) for i in range(63)]}
    rows = [(k, b, v) for k, b in bounds.items() for v in (float("-inf"), -1.0, 0.0, 0.5, 2.0, 31.0, 31.5, 62.0, 63.0, float("inf"))]
    placed = quantiles._nth(spark.createDataFrame(rows, "k int, bounds array<double>, value double"), "bounds", "value")
    assert "lambda" not in plan_of(placed)
    assert all(r.nth == sum(b < r.value for b in r.bounds) for r in placed.collect()) and placed.count() == 40


def test_terms_are_counted_without_a_row_builder_per_term(spark):
    docs = spark.createDataFrame([("Red red shoe",), ("shoe",), ("",), (None,)], "text string")
    stats = tfidf.term_stats(docs, "text", 1)
    assert {r.term: (r.tf, r.df) for r in stats.collect()} == {"red": (2, 1), "shoe": (2, 2)}
    assert "lambda" not in plan_of(stats)
    pairs = {r.term: (r.tf, r.df) for r in tfidf.term_stats(docs, "text", 2).collect()}
    assert pairs == {"red": (2, 1), "shoe": (2, 2), "red red": (1, 1), "red shoe": (1, 1)}


def test_texts_with_a_stored_vector_are_not_written(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "red shoe"), (2, "red shoe"), (3, "blue")], "id long, text string")
    store = vector_store.create(spark, shared_path(spark, "vectors"), tfidf.fit_vocab(docs, "text", tfidf.DENSE), tfidf.DENSE)
    written = []
    monkeypatch.setattr(vector_store, "stage", lambda df, label: written.append(stage(df, label)) or written[-1])
    assert store.embed(docs, "id", "text")[1] == vector_store.Counts(3, 2, 2, 0)
    assert store.embed(docs, "id", "text")[1] == vector_store.Counts(3, 2, 0, 2)
    assert [df.count() for df in written if "text" in df.columns] == [2, 0]
