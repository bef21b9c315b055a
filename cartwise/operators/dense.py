"""Dense vectors: mean pooling and exact nearest products by cosine."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwise.session import stage

BLOCK_ROWS = 4096
SCORE_DIGITS = 9


def mean_pool(tokens: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean of all vectors of a key, combined before the shuffle."""
    rows = tokens.filter(F.size(vector) > 0).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    pooled = rows.groupBy(key).agg(Summarizer.mean(F.col("v")).alias("m"))
    return pooled.select(key, vector_to_array("m").alias("pooled"))


def pool_nested(df: DataFrame, nested: str, dim: int) -> DataFrame:
    """Replace an array of token vectors by their mean, in the row; zeros for none."""
    n = F.size(nested)
    zero = F.array_repeat(F.lit(0.0), dim)
    total = F.aggregate(nested, zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + F.coalesce(b.cast("double"), F.lit(0.0))))
    return df.withColumn(nested, F.when(n > 0, F.transform(total, lambda x: F.try_divide(x, n))).otherwise(zero))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    length[length == 0] = 1.0
    return m / length


def _best_of_block(k: int):
    """Best ``k`` rows of one block of products for every query of one block."""
    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "ordinal": [], "score": []})
        right = right.sort_values("ordinal")
        sims = _unit(_matrix(left["vector"])) @ _unit(_matrix(right["vector"])).T
        sims = np.maximum(np.round(sims, SCORE_DIGITS), 0.0)
        # stable, so equal scores keep catalogue order
        top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({
            "query_id": np.repeat(left["query_id"].to_numpy(), top.shape[1]),
            "ordinal": right["ordinal"].to_numpy()[top].ravel(),
            "score": np.take_along_axis(sims, top, axis=1).ravel(),
        })

    return best


def _blocks(rows: DataFrame) -> int:
    return max(1, -(-rows.count() // BLOCK_ROWS))


def dense_topk(queries: DataFrame, products: DataFrame, k: int, query_blocks: int | None = None,
               product_blocks: int | None = None) -> DataFrame:
    """Exact best ``k`` products per query: (query_id, ordinal, dense_sim, retrieval_rank).

    ``queries``: query_id bigint, vector; ``products``: ordinal bigint, vector. Both sides are cut
    into blocks of about ``BLOCK_ROWS`` by hash, every pair of blocks is multiplied in one task and hands on only ``k`` rows
    per query, so pairs are never materialised. Negative cosines count as 0.
    """
    queries = stage(queries.select("query_id", "vector"), "dense-queries")
    query_blocks = query_blocks or _blocks(queries)
    product_blocks = product_blocks or _blocks(products)
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("query_id", "vector", block("query_id", query_blocks).alias("qb"), every(product_blocks).alias("pb"))
    right = products.select("ordinal", "vector", block("ordinal", product_blocks).alias("pb"), every(query_blocks).alias("qb"))
    parts = left.groupBy("qb", "pb").cogroup(right.groupBy("qb", "pb")).applyInPandas(
        _best_of_block(k), "query_id long, ordinal long, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "ordinal")
    return parts.withColumn("retrieval_rank", F.row_number().over(order)).filter(F.col("retrieval_rank") <= k).select(
        "query_id", "ordinal", F.col("score").alias("dense_sim"), "retrieval_rank"
    )
