import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwise.functions import vectors as V
from cartwise.operators import dense, tfidf, upsert, user_vectors as U
from cartwise.operators.rerank_candidates import rerank_candidates
from cartwise.plans import embedding

ENTRIES = "product_id string, entries array<struct<fid:int,weight:double>>"


def test_cosine_pads_and_guards(spark):
    rows = [([1.0, 2.0], [1.0, 2.0, 2.0]), ([0.0, 0.0], [1.0]), ([1.0], [-1.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([5 / (5 ** .5 * 3), 0.0, -1.0])
    assert [r[0] for r in df.select(V.pad(F.col("b"), 2)).collect()] == [[1.0, 2.0], [1.0, 0.0], [-1.0, 0.0]]


def test_user_vectors(spark):
    vec = spark.createDataFrame([("a", [(0, 1.0)]), ("b", [(0, 0.5), (2, 0.5)]), ("z", [])], ENTRIES)
    req = spark.createDataFrame([
        (1, ["a", "b"], [1.0, 3.0]), (2, ["a", "missing"], None), (3, ["a", "b"], [2.0]), (4, ["a", "b"], [1.0, -1.0]),
        (5, ["missing"], None), (6, ["a", "a"], [1.0, 1.0]), (7, ["z"], None)],
        "user_id long, recent_product_ids array<string>, weights array<double>")
    items = U.recent_products(req)
    got = {r.user_id: r.user_vector for r in U.user_vectors(items, vec, 3).collect()}
    assert got == {1: [.625, 0, .375], 2: [.5, 0, 0], 3: [1, 0, 0], 4: [0, 0, 0], 5: [0, 0, 0], 6: [1, 0, 0], 7: [0, 0, 0]}
    miss = U.missing_vectors(items.withColumn("e", F.lit("x")), vec, ["e"]).first()
    assert (miss.hits, miss.misses) == (9, 2)


def test_embed_new_product_with_fitted_vocab(spark):
    fitted = embedding.fit_products(spark.createDataFrame([("p1", "red shoe"), ("p2", "blue shoe")], "product_id string, name string"))
    new = spark.createDataFrame([("n1", "red shoe", None), ("n2", "unknown", ""), ("n3", "a", "blue thing")],
                                "product_id string, name string, description string")
    got = {r.product_id: r.entries for r in embedding.embed_products(new, fitted).collect()}
    assert len(got["n1"]) == 2 and got["n2"] == [] and [e.weight for e in got["n3"]] == [1.0]
    assert sum(e.weight ** 2 for e in got["n1"]) == pytest.approx(1.0)


def test_mean_pool(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 6.0]), (2, [5.0, 5.0]), (2, [])], "t int, v array<double>")
    assert {r.t: r.pooled for r in dense.mean_pool(df, "t", "v").collect()} == {1: [2.0, 4.0], 2: [5.0, 5.0]}
    nested = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0]],), ([],)], "v array<array<double>>")
    assert [r.v for r in dense.pool_nested(nested, "v", 2).collect()] == [[2.0, 4.0], [0.0, 0.0]]


@pytest.mark.parametrize("qb,pb", [(1, 1), (2, 5)])
def test_dense_topk(spark, qb, pb):
    rng = np.random.default_rng(3)
    items, asked = rng.normal(size=(60, 8)), rng.normal(size=(7, 8))
    items[10:30] = items[5]      # a third are copies: ties keep catalogue order
    items[40] = 0.0
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], "ordinal long, vector array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, vector array<double>")
    got = {}
    for r in dense.dense_topk(q, p, 12, qb, pb).orderBy("query_id", "retrieval_rank").collect():
        got.setdefault(r.query_id, []).append(r.ordinal)
    n = np.linalg.norm(items, axis=1)
    n[n == 0] = 1
    for i, v in enumerate(asked):
        sims = np.maximum(np.round(items @ v / n / np.linalg.norm(v), 9), 0)
        assert got[i] == sorted(range(60), key=lambda j: (-sims[j], j))[:12]


REQ = "request_id long, entries array<struct<fid:int,weight:double>>, weights map<string,double>, label string, confidence double"
CAND = "request_id long, position int, product_id string, keyword_score double, semantic_score double, price double"


def test_rerank_candidates(spark):
    req = spark.createDataFrame([
        (1, [(0, 1.0)], None, "price_sensitive", .8), (2, [(0, 1.0)], {"vector": 1.0}, None, None),
        (3, [(0, 1.0)], None, "gift", .5), (4, [(0, 1.0)], None, "premium", 1.0)], REQ)
    cand = spark.createDataFrame([
        (1, 0, "a", .5, None, 10.0), (1, 1, "b", .2, None, 30.0), (1, 2, "no", .9, None, None),
        (2, 0, "b", .4, .6, 5.0), (2, 1, "a", .4, .6, 5.0),
        (3, 0, "a", .4, .6, 5.0), (3, 1, "a", .3, None, 9.0), (4, 0, "a", .0, None, 7.0)], CAND)
    vec = spark.createDataFrame([("a", [(0, 2.0)]), ("b", [(1, 1.0)])], ENTRIES)
    rows = rerank_candidates(req, cand, vec).orderBy("request_id", "rank").collect()
    by = {(r.request_id, r.position): r for r in rows}
    a, b, no = (by[1, i] for i in range(3))
    assert (a.cosine_score, a.vector_score, a.pricing_score, a.intent_score) == pytest.approx((1.0, .85, 1.0, .8))
    assert a.final_score == pytest.approx(.45 * .85 + .3 * .8 + .25) and b.pricing_score == 0.0
    assert (no.cosine_score, no.pricing_score, no.intent_score) == pytest.approx((0.0, .5, .4))
    # no intent: alignment counts nothing; equal prices: 0.5; missing weights: base
    assert by[2, 1].intent_score == 0.0 and by[2, 1].final_score == pytest.approx(.82 + .25 * .5)
    assert by[3, 0].intent_score == pytest.approx(.3) and by[3, 1].intent_score == pytest.approx(.15)
    assert by[4, 0].pricing_score == .5 and by[4, 0].intent_score == .5
    assert [r.position for r in rows if r.request_id == 2] == [1, 0]
    assert rerank_candidates(req, cand.limit(0), vec).count() == 0


def test_upsert_last_write_wins(spark):
    old = spark.createDataFrame([("a", "A", 1), ("b", "B", 1)], "product_id string, name string, version int")
    new = spark.createDataFrame([("b", "B2", 2), ("b", "B3", 3), ("c", "C", 2)], "product_id string, name string, version int")
    merged = upsert.upsert(old, new, "product_id", "version")
    assert sorted((r.product_id, r.name) for r in merged.collect()) == [("a", "A"), ("b", "B3"), ("c", "C")]
    assert tuple(upsert.index_status(merged, "product_id", "version").first()) == (3, 3)
    meta = upsert.with_metadata_defaults(merged).filter("product_id = 'a'").first()
    assert (meta.price, meta.rating, meta.popularity, meta.stock, meta.discount) == (0.0, 3.5, 0.5, True, 0.0)


def test_embed_once_by_content(spark):
    docs = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(9)], "id long, text string")
    groups = upsert.content_groups(docs, "id", "text")
    stored = groups.filter("text = 't0'").select("text_hash")
    todo = upsert.not_embedded(groups, stored)
    assert todo.count() == 3 and upsert.embed_copies(docs, "id", "text", todo.drop("text")).count() == 8


def test_sparse_columns(spark):
    df = spark.createDataFrame([("a", [(1, .5), (4, .25)])], ENTRIES)
    i, v = tfidf.sparse_columns(F.col("entries"))
    assert tuple(df.select(i, v).first()) == ([1, 4], [.5, .25])
