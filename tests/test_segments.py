"""An index of segments: the same answers as a new index, files in proportion to the changes, whole versions only."""

import os

import pytest
from pyspark.sql import functions as F

from cartwise.operators import index, retrieval, segments
from cartwise.session import shared_path, stage
from cartwise.sources import tables as T


@pytest.fixture(scope="module")
def products(spark, sf):
    p = T.products(spark, sf)
    copies = p.limit(1).select("*", F.explode(F.sequence(F.lit(1), F.lit(40))).alias("c")).withColumn(
        "product_id", F.col("c") + 100000).withColumn("ordinal", F.col("c") + 100000).drop("c")
    return stage(p.unionByName(copies), "test-products")


@pytest.fixture(scope="module")
def queries(spark, sf):
    q = T.search_requests(spark, sf).select("query_id", "query")
    return stage(q.unionByName(spark.createDataFrame([(9001, "brand"), (9002, "zzz qqq")], "query_id long, query string")), "test-queries")


def rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def bytes_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files)


def same_as_new(store, products, queries, version=None):
    """Tables and answers of the index are those of a new one with its vocabularies."""
    fresh = index.build_index(products, stage, store.k, vocab=store.vocab())
    opened = store.open(version)
    for name in ("members", "postings"):
        columns = getattr(fresh, name).columns
        assert rows(getattr(opened, name).select(*columns)) == rows(getattr(fresh, name)), name
    a, b = opened.bounds.alias("a"), fresh.bounds.alias("b")
    loose = a.join(b, "tid").filter("a.top_dense < b.top_dense or a.top_sparse < b.top_sparse or a.kth_dense > b.kth_dense or a.kth_sparse > b.kth_sparse")
    assert loose.count() == 0 and fresh.bounds.join(opened.bounds, "tid", "left_anti").count() == 0
    blocks = fresh.blocks.alias("b").join(opened.blocks.alias("a"), ["tid", "bucket"], "left")
    assert blocks.filter("a.n is null or a.n < b.n or a.top_dense < b.top_dense or a.top_sparse < b.top_sparse").count() == 0
    if queries is not None:
        order = ["query_id", "retrieval_rank", "product_id"]
        assert rows(retrieval.hybrid_retrieve(queries, opened).select(*order)) == rows(retrieval.hybrid_retrieve(queries, fresh).select(*order))


def test_updates_folding_and_versions(spark, products, queries):
    path = shared_path(spark, "store")
    store = segments.create(products.filter("ordinal % 10 <> 3"), path, 7)
    base = bytes_of(f"{path}/segments")
    catalogue = {r.product_id: r for r in products.collect() if r.ordinal % 10 != 3}
    old = store.version()
    for step in range(3):
        new = products.filter(F.col("ordinal") % 30 == 3 + 10 * step)
        renamed = products.filter((F.col("ordinal") % 10 != 3) & (F.col("ordinal") % 60 == step + 20)).withColumn("name", F.lit(f"brand ring {step % 2}"))
        dropped = products.filter((F.col("ordinal") % 10 != 3) & (F.col("ordinal") % 60 == step + 40)).select("product_id").withColumn("removed", F.lit(True))
        changes = stage(new.unionByName(renamed).withColumn("removed", F.lit(False)).unionByName(dropped, allowMissingColumns=True), "changes")
        store.apply(changes)
        for r in changes.collect():
            catalogue.pop(r.product_id, None)
            if not r.removed:
                catalogue[r.product_id] = r
    now = stage(spark.createDataFrame([[r[c] for c in products.columns] for r in catalogue.values()], products.schema), "now")
    assert rows(store.catalogue().select(*now.columns)) == rows(now)
    apart = store.version()
    assert len(apart.folders) == 4
    same_as_new(store, now, queries)
    folded = store.fold(fan=3)
    assert len(folded.folders) == 2 and folded.number == apart.number + 1
    same_as_new(store, now, None)
    same_as_new(store, now, None, apart)          # a reader of the version before
    assert rows(store.catalogue().select(*now.columns)) == rows(now) and rows(store.catalogue(old)) == rows(products.filter("ordinal % 10 <> 3"))
    whole = store.fold(None)
    assert len(whole.folders) == 1 and spark.read.parquet(f"{path}/segments/{whole.folders[0].name}/tombstones").count() == 0
    store.vacuum()
    assert len(os.listdir(f"{path.removeprefix('file://')}/segments")) == 1 and bytes_of(f"{path}/segments") < 2 * base
    same_as_new(segments.open_store(spark, path), now, queries)


def test_small_updates_write_little(spark, products):
    path = shared_path(spark, "store")
    plain = products.filter("ordinal < 100000")
    store = segments.create(plain, path, 7)
    whole = store.version().folders[0].size
    one = store.apply(plain.filter("ordinal = 5").withColumn("name", F.lit("a new ring")))
    assert one.folders[-1].size < whole / 20
    again = store.apply(plain.filter("ordinal = 5"))
    assert again.folders[-1].size < whole / 20 and store.version().number == 2
    same_as_new(store, plain, None)


def test_batches_apply_once_and_versions_are_written_once(spark, products):
    path = shared_path(spark, "store")
    store = segments.create(products.filter("ordinal % 2 = 0"), path, 5)
    first = store.apply(products.filter("ordinal % 4 = 1"), batch=0)
    assert store.apply(products.filter("ordinal % 4 = 1"), batch=0) == first == store.version()
    second = store.apply(products.filter("ordinal % 4 = 3"), batch=1)
    assert (second.number, second.batch) == (2, 1) and store.apply(products.limit(3), batch=0) == second
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        store.publish(second)
    same_as_new(store, products, None)


def test_unpublished_segment_is_not_seen(spark, products):
    path = shared_path(spark, "store")
    store = segments.create(products.filter("ordinal % 2 = 0"), path, 5)
    groups = stage(index.copy_groups(index.with_corpus_text(products), 5), "groups")
    store._write_segment(1, products.withColumn("removed", F.lit(False)), groups, groups.select("gid").distinct(), store.vocab())
    same_as_new(store, products.filter("ordinal % 2 = 0"), None)   # as after a crash before the version was written
    store.apply(products.filter("ordinal % 2 = 1"), batch=4)
    same_as_new(store, products, None)
