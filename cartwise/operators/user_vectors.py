"""User vectors from product vectors, and lookups that find no vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.operators.tfidf import dense_array
from cartwise.session import stage

_TOTAL = -1  # pseudo index that carries the sum of weights


def recent_products(requests: DataFrame) -> DataFrame:
    """Rows (user_id, product_id, weight) from arrays recent_product_ids and weights.

    Without weights every product counts 1; the longer of the two arrays is cut to the shorter.
    """
    ids = F.col("recent_product_ids")
    weights = F.coalesce("weights", F.transform(ids, lambda _: F.lit(1.0)))
    n = F.least(F.size(ids), F.size(weights))
    pairs = F.arrays_zip(F.slice(ids, F.lit(1), n).alias("product_id"), F.slice(weights, F.lit(1), n).alias("weight"))
    return requests.select("user_id", F.inline(pairs).alias("product_id", "weight"))


def distinct_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Products with the ``vid`` of their vector, and the vectors (vid, entries), each once: products of equal text have equal ones."""
    groups = stage(vectors.groupBy("entries").agg(F.min("product_id").alias("vid")).select("vid", "entries"), "distinct-vectors")
    return vectors.join(groups, "entries").select("product_id", "vid"), groups


def user_entries(items: DataFrame, vectors: DataFrame) -> DataFrame:
    """Weighted mean of product vectors in long form: (user_id, fid, value), zeros left out.

    ``items``: user_id, product_id, weight; ``vectors``: product_id, entries. A product without
    vector adds its weight but no entries. Weights are summed per user and distinct vector before they are
    placed by user, so a busy user arrives as a row per vector, and entries meet them there and are not shuffled.
    """
    ids, groups = distinct_vectors(vectors)
    weighed = items.join(ids, "product_id", "left").groupBy("user_id", "vid").agg(F.sum("weight").alias("weight"))
    joined = weighed.repartition("user_id").join(groups, "vid", "left")
    own = F.transform("entries", lambda e: F.struct(e["fid"].alias("fid"), (e["weight"] * F.col("weight")).alias("x")))
    total = F.array(F.struct(F.lit(_TOTAL).alias("fid"), F.col("weight").cast("double").alias("x")))
    none = F.array().cast("array<struct<fid:int,x:double>>")
    sums = joined.select("user_id", F.inline(F.concat(total, F.coalesce(own, none)))).groupBy("user_id", "fid").agg(
        F.sum("x").alias("x")
    )
    # one array per user, at most as long as the vocabulary
    rows = sums.groupBy("user_id").agg(
        F.collect_list(F.when(F.col("fid") != _TOTAL, F.struct("fid", "x"))).alias("xs"),
        F.max(F.when(F.col("fid") == _TOTAL, F.col("x"))).alias("total"),
    )
    entries = F.transform("xs", lambda e: F.struct(
        e["fid"].alias("fid"), F.coalesce(F.try_divide(e["x"], F.col("total")), F.lit(0.0)).alias("weight")))
    return rows.select("user_id", F.array_sort(entries).alias("entries"))


def user_vectors(items: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Dense user vectors; all zeros without a known product or with weights that cancel out."""
    return user_entries(items, vectors).select("user_id", dense_array(F.col("entries"), dim).alias("user_vector"))


def missing_vectors(items: DataFrame, vectors: DataFrame, by: list[str]) -> DataFrame:
    """Lookups with and without a vector, per label columns of ``items``."""
    counted = items.groupBy(*by, "product_id").agg(F.count("*").alias("n"))
    known = vectors.select("product_id", F.lit(True).alias("known"))
    looked = counted.join(known, "product_id", "left")
    return looked.groupBy(*by).agg(
        F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("hits"),
        F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)).alias("misses"),
    )
