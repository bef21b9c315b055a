import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwise.operators import index, joins, retrieval, tfidf
from cartwise.plans import search as S
from cartwise.session import stage
from cartwise.sources import catalog, tables as T


def words(text, ngrams):
    t = re.findall(r"\w\w+", text.lower())
    return t + ([" ".join(p) for p in zip(t, t[1:])] if ngrams == 2 else [])


def fit(texts, size, ngrams):
    docs = [words(t, ngrams) for t in texts]
    tf, df = Counter(w for d in docs for w in d), Counter(w for d in docs for w in set(d))
    top = sorted(tf, key=lambda w: (-tf[w], w))[:size]
    return {w: math.log((1 + len(texts)) / (1 + df[w])) + 1 for w in top}


def vector(text, idf, ngrams):
    raw = {w: (1 + math.log(n)) * idf[w] for w, n in Counter(words(text, ngrams)).items() if w in idf}
    length = math.sqrt(sum(x * x for x in raw.values())) or 1.0
    return {w: x / length for w, x in raw.items()}


def brute_force(products, queries, k):
    """Scores of every pair, by the book."""
    texts = [" ".join(x or "" for x in (p["name"], p["desc"], p["category"], p["brand"])) for p in products]
    spaces = [(fit(texts, 384, 1), 1, .7), (fit(texts, 8000, 2), 2, .3)]
    vecs = [[vector(t, idf, n) for idf, n, _ in spaces] for t in texts]
    out = {}
    for qid, q in queries:
        qv = [vector(q, idf, n) for idf, n, _ in spaces]
        scored = []
        for p, pv in zip(products, vecs):
            if p["stock"]:
                sims = [sum(x * b.get(w, 0) for w, x in a.items()) for a, b in zip(qv, pv)]
                scored.append((-round(.7 * sims[0] + .3 * sims[1], 9), p["ordinal"], p["product_id"]))
        out[qid] = [pid for _, _, pid in sorted(scored)[:k]]
    return out


@pytest.fixture(scope="module")
def products(spark, sf):
    """Test catalogue with a block of copies that makes up a third of it."""
    p = T.products(spark, sf)
    copies = p.limit(1).select("*", F.explode(F.sequence(F.lit(1), F.lit(100))).alias("c")).withColumn(
        "product_id", F.col("c") + 100000).withColumn("ordinal", F.col("c") + 100000).drop("c")
    return stage(p.unionByName(copies), "test-products")


@pytest.fixture(scope="module")
def queries(spark, sf):
    q = T.search_requests(spark, sf).select("query_id", "query")
    more = spark.createDataFrame([(9001, "brand"), (9002, "zzz qqq"), (9003, "brand brand economy small ring"),
                                  (9004, "running_shoes brand"), (9005, "zzz qqq"), (9006, "")], "query_id long, query string")
    return stage(q.unionByName(more), "test-queries")


@pytest.mark.parametrize("k", [1, 5, 20])
def test_retrieval_equals_scoring_every_pair(spark, products, queries, monkeypatch, k):
    monkeypatch.setattr(joins, "BLOCK", 16)
    ix = index.build_index(products, stage, k)
    got = {}
    for r in retrieval.hybrid_retrieve(queries, ix).orderBy("query_id", "retrieval_rank").collect():
        got.setdefault(r.query_id, []).append(r.product_id)
    rows = [r.asDict() for r in products.orderBy("ordinal").collect()]
    want = brute_force(rows, [tuple(r) for r in queries.collect()], k)
    assert got == want


def test_block_join_equals_join(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK", 3)
    a = spark.range(60).selectExpr("id AS l", "IF(id < 40, 0, id % 7) AS key")
    b = spark.range(50).selectExpr("id AS r", "IF(id < 20, 0, id % 9) AS key")
    got = sorted(map(tuple, joins.block_join(a, b, ["key"], "l", "r").select("l", "r", "key").collect()))
    assert got == sorted(map(tuple, a.join(b, "key").select("l", "r", "key").collect()))


def test_vocab_cut_and_order(spark):
    docs = spark.createDataFrame([("bb aa bb",), ("aa cc",), ("dd",)], "text string")
    v = tfidf.fit_vocab(docs, "text", tfidf.Space("x", 3, False, 1)).orderBy("fid").collect()
    assert [(r.term, r.fid, r.tf, r.df) for r in v] == [("aa", 0, 2, 2), ("bb", 1, 2, 1), ("cc", 2, 1, 1)]
    assert v[1].idf == pytest.approx(math.log(4 / 2) + 1)


def test_hybrid_weights_are_both_spaces(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["red shoe", "red red hat", "blue shoe shoe", "hat"])], "id long, text string")
    vocab = stage(tfidf.fit_hybrid_vocab(docs, "text"), "v")
    long = tfidf.tfidf(docs, "id", "text", vocab, 2, True)
    want = {(r.id, r.space): r.s for r in long.groupBy("id", "space").agg(F.sum("weight").alias("s")).collect()}
    both = tfidf.hybrid_tfidf(docs, "id", "text", vocab).groupBy("id").agg(F.sum("dense").alias("d"), F.sum("sparse").alias("s"))
    for r in both.collect():
        assert (r.d, r.s) == (pytest.approx(want[r.id, "dense"]), pytest.approx(want[r.id, "sparse"]))


@pytest.fixture(scope="module")
def seed(spark):
    cat = stage(catalog.load_catalog(spark, "/nowhere/a.json", "/nowhere/b.json", seed=True), "seed")
    return cat, index.build_index(cat, stage)


def test_search_over_seed_catalogue(spark, seed):
    cat, ix = seed
    asked = [(1, "cheap running shoe under $60", .8, 3, None), (2, "nothing known here", .5, 20, None), (3, "garmin watch under 5", .5, 20, None),
             (4, "cheap running shoe under $60", .2, 3, {"vector": 1.0, "intent": 0.0, "pricing": 0.0}), (5, "nike sneaker", .5, 20, {})]
    req = spark.createDataFrame(asked, "query_id long, query string, churn_score double, top_k int, weights map<string,double>")
    rows = S.search(req, ix, cat).orderBy("query_id", "rank").collect()
    by = {q: [r for r in rows if r.query_id == q] for q in range(1, 6)}
    assert all(r.category == "running_shoes" and r.price <= 60 for r in by[1]) and [r.rank for r in by[1]] == [1, 2]
    assert len(by[2]) == 10 and {r.vector_score for r in by[2]} == {0.0}      # padded, nothing matches
    assert len(by[3]) == 10                                                    # nothing under 5: filter dropped
    assert all(r.final_score == r.vector_score for r in by[4])                 # own weights
    assert {r.category for r in by[5]} == {"casual_shoes"} and by[5][0].product_id == "cs-001"
    assert by[1][0].rank_explanation.startswith("budget pick at $")
    for q in by.values():
        assert [r.final_score for r in q] == sorted((r.final_score for r in q), reverse=True)


def test_defaults_of_a_request(spark, seed):
    cat, ix = seed
    out = S.search(spark.createDataFrame([(1, "running")], "query_id long, query string"), ix, cat).collect()
    assert [r.rank for r in sorted(out, key=lambda r: r["rank"])] == list(range(1, 11))


def test_external_candidates(spark):
    df = spark.createDataFrame([(1, i, float(i % 3)) for i in range(9)], "query_id long, product_id long, score double")
    out = retrieval.external_candidates(df, 4).orderBy("retrieval_rank").collect()
    assert [r.product_id for r in out] == [2, 5, 8, 1] and {r.sparse_score for r in out} == {0.0}


def test_updated_index_equals_a_new_one(spark, products, queries):
    now = products
    then = stage(now.filter("ordinal % 4 <> 1").withColumn("name", F.when(F.col("ordinal") % 6 == 0, F.lit("brand ring")).otherwise(F.col("name"))), "then")
    old = index.build_index(then, stage, 7)
    changed = now.filter("ordinal % 4 = 1 or ordinal % 6 = 0").select("product_id")
    updated = index.update_index(old, then, now, changed, stage)
    fresh = index.build_index(now, stage, 7, vocab=old.vocab)
    for name in ("members", "postings", "bounds"):
        a, b = (sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in getattr(ix, name).select(*getattr(fresh, name).columns).collect())
                for ix in (updated, fresh))
        assert a == b, name


def test_frequent_words_are_not_read_whole(spark, products, queries):
    ix = index.build_index(products, stage, 5)
    texts = queries.filter("query <> ''").groupBy("query").agg(F.min("query_id").alias("qkey"))
    plan = stage(retrieval.reading_plan(retrieval.query_vectors(texts, "qkey", "query", ix.vocab), ix), "plan")
    frequent = ix.vocab.filter("term = 'brand'").agg(F.max("fid")).first()[0]
    of_word = plan.filter(F.col("tid") == frequent)
    whole = of_word.agg(F.sum("list_length")).first()[0]
    read = retrieval.blocks_to_read(plan, ix).filter(F.col("tid") == frequent).agg(F.sum("n")).first()[0] or 0
    assert of_word.count() > 50 and read < whole / 10
    groups = ix.members.filter("gid = ordinal").count()
    pairs = retrieval.candidate_pairs(plan, ix).count()
    assert pairs < plan.select("qkey").distinct().count() * groups / 5
