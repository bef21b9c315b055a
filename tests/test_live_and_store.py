"""Live session scores after every batch, vectors embedded once, an index kept by a stream, running sums, counters, responses."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from cartwise.operators import cleaning, metrics, responses, segments, sessions, tfidf, user_state, user_vectors, vector_store
from cartwise.session import shared_path, stage
from cartwise.sources import tables as T, versions
from cartwise.streaming import index_updates, live_scores

T0 = dt.datetime(2024, 1, 1)


def rows(df):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def made_events(seed, users, n):
    rng, out = random.Random(seed), []
    for user in users:
        t = T0
        for _ in range(n):
            t += dt.timedelta(minutes=rng.choice([0, 1, 5, 29, 30, 31, 90]), microseconds=rng.choice([0, 1]))
            out.append((user, t, rng.choice(["view", "click", "purchase", "error"]), float(rng.randint(0, 300))))
    rng.shuffle(out)
    return out


def test_every_batch_equals_all_events_so_far(spark):
    made = made_events(3, [1, 2, None], 80)
    schema = "user_id long, ts timestamp_ntz, event_type string, value double"
    table = live_scores.create(spark, shared_path(spark, "live"))
    columns = ["user_id", "session_start", "session_end", "intent_score", "score_bucket", "dominant_signal"]
    for batch in range(3):  # events are dealt at random, so later batches join sessions
        part = spark.createDataFrame(made[batch::3], schema)
        version = table.apply(part, batch)
        assert table.apply(part, batch) == version  # run again
        seen = [e for b in range(batch + 1) for e in made[b::3]]
        want = sessions.intent_score(sessions.session_features(spark.createDataFrame(seen, schema)))
        assert rows(table.scores().select(*columns)) == rows(want.select(*columns))
    told = table.changes(version)
    assert told.filter("removed").count() > 0 and told.filter("not removed and intent_score is null").count() == 0
    before = rows(table.scores().select(*columns))
    folded = table.fold(None)
    assert len(folded.folders) == 1 and rows(table.scores().select(*columns)) == before == rows(table.scores(version).select(*columns))
    table.vacuum()
    assert rows(table.scores().select(*columns)) == before
    empty = table.apply(spark.createDataFrame([], schema), 3)
    assert empty.batch == 3 and rows(table.scores().select(*columns)) == before


def test_like_sized():
    def n(*sizes, fan=3):
        return versions.like_sized(tuple(versions.Folder(i, str(i), s) for i, s in enumerate(sizes)), fan)

    assert n(100, 1, 1) == 0 and n(100, 1, 1, 1) == 3 and n(100, 3, 1, 1) == 0 and n(9, 3, 3, 3) == 3 and n(100, 1, fan=None) == 2 and n(5, fan=None) == 0


def test_texts_are_embedded_once(spark):
    docs = spark.createDataFrame([(1, "red shoe red"), (2, "blue hat"), (3, "red shoe red"), (4, None), (5, "--"), (6, "hat hat")], "id long, text string")
    vocab = stage(tfidf.fit_vocab(docs, "text", tfidf.DENSE), "vocab")
    store = vector_store.create(spark, shared_path(spark, "vectors"), vocab, tfidf.DENSE)
    _, first = store.embed(docs.filter("id < 4"), "id", "text")
    assert first == vector_store.Counts(3, 2, 2, 0)
    vectors, second = store.embed(docs, "id", "text")
    assert second == vector_store.Counts(5, 4, 2, 2)
    direct = tfidf.vector_rows(tfidf.tfidf(docs, "id", "text", vocab, 1, True), "id")
    assert rows(vectors.filter("size(entries) > 0").select("id", F.col("entries").cast("string"))) == rows(direct.select("id", F.col("entries").cast("string")))
    assert {r.id for r in vectors.collect()} == {1, 2, 3, 5, 6}
    version = store.version()
    _, third = store.embed(docs, "id", "text")
    assert third == vector_store.Counts(5, 4, 0, 4) and store.version() == version
    assert rows(vectors.select("id", "seq")) == [(1, 0), (2, 0), (3, 0), (5, 1), (6, 1)]


def test_index_stream_applies_batches_once(spark, sf):
    products = stage(T.products(spark, sf).limit(60), "products")
    path = shared_path(spark, "stream")
    store = segments.create(products.filter("ordinal % 2 = 0"), f"{path}/index", 5)
    twice = products.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("version")).withColumn(
        "name", F.when(F.col("version") == 1, F.lit("older")).otherwise(F.col("name")))
    twice.filter("ordinal % 2 = 1").repartition(2, "product_id").write.parquet(f"{path}/changes")
    stream = spark.readStream.schema(twice.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/changes")
    index_updates.index_stream(stream, store, f"{path}/checkpoint", fan=9).awaitTermination()
    version = store.version()
    assert version.batch == 1 and len(version.folders) == 3
    assert rows(store.catalogue().select("product_id", "name")) == rows(products.select("product_id", "name"))
    # the same batches again, as from a checkpoint that was lost before it was written
    index_updates.index_stream(stream, store, f"{path}/checkpoint-2", fan=9).awaitTermination()
    assert store.version() == version
    with pytest.raises(ValueError):
        store.version(77)


def vector_rows_of(spark, rows):
    return spark.createDataFrame([(p, e) for p, e in rows], "product_id long, entries array<struct<fid:int,weight:double>>")


def test_running_user_vectors_equal_recomputation(spark):
    rng = random.Random(9)
    store = user_state.create(spark, shared_path(spark, "users"))
    vectors, all_items = {}, []
    for batch in range(3):
        changed = {p: [(f, round(rng.random(), 3)) for f in sorted(rng.sample(range(8), 3))] for p in rng.sample(range(12), 5)}
        if batch == 2:
            changed[next(iter(vectors))] = None  # a product without a vector from now on
        vectors |= changed
        items = [(rng.randrange(5), rng.randrange(14), float(rng.choice([1, 2, -1, 0.5]))) for _ in range(30)]
        all_items += items
        frame = spark.createDataFrame(items, "user_id long, product_id long, weight double")
        version = store.add(frame, vector_rows_of(spark, changed.items()), batch)
        assert store.add(frame, vector_rows_of(spark, changed.items()), batch) == version
        want = user_vectors.user_entries(spark.createDataFrame(all_items, "user_id long, product_id long, weight double"),
                                         vector_rows_of(spark, [(p, e) for p, e in vectors.items() if e]))
        flat = lambda df: {(r.user_id, e.fid): e.weight for r in df.collect() for e in r.entries if abs(e.weight) > 1e-9}
        got, expected = flat(store.entries()), flat(want)
        assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k]) for k in got)
        if batch == 1:
            assert len(store.fold(None).folders) == 1
    later = store.add(spark.createDataFrame([], "user_id long, product_id long, weight double"))
    assert later.number == version.number + 1 and flat(store.entries()).keys() == expected.keys()
    store.vacuum()
    assert flat(store.entries()).keys() == expected.keys()


def test_responses_round_trip(spark):
    rows = [(1, 2, 7, "b", "c", None, 2.0, 0.1, None, 0.5, 'say "x"', 0.1, 0.2, 0.3, 0.4, 0.5, "gift", 0.9, 2),
            (1, 1, 8, "a\nb", "c", "d", 1.5, 0.0, 4.0, 0.75, "é", 0.1, 0.2, 0.3, 0.4, 0.5, "gift", 0.9, 2)]
    names = ("query_id rank product_id name category brand price discount rating final_score rank_explanation vector_score dense_sim sparse_score "
             "intent_score pricing_score intent_label intent_confidence total_candidates").split()
    kinds = "long int long string string string double double double double string double double double double double string double long".split()
    ranked = spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    written = responses.search_responses(ranked)
    [text] = [json.loads(r.response) for r in written.collect()]
    assert [r["product_id"] for r in text["results"]] == [8, 7] and text["returned"] == 2 and text["intent"] == {"label": "gift", "confidence": 0.9}
    assert rows_of(responses.read_responses(written).select(*names)) == rows_of(ranked)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_funnel_counts_with_the_run(spark):
    ts = dt.datetime(2024, 1, 1)
    made = [(i, f"p{i % 9}", i % 4 or None, 1, 2 - (i % 11 == 0) * 3, float(i % 30), ts) for i in range(300)]
    tx = spark.createDataFrame(made + made[:50], "invoice long, stock_code string, customer_id long, line_no int, quantity int, price double, invoice_ts timestamp_ntz")
    run = metrics.CleaningRun(tx)
    kept = run.write()
    assert rows_of(run.funnel()) == rows_of(cleaning.cleaning_funnel(tx))
    assert rows_of(kept.select("invoice", "stock_code", "amount")) == rows_of(cleaning.clean_transactions(tx).select("invoice", "stock_code", "amount"))
