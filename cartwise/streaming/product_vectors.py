"""Streamed product additions into a versioned vector table.

Every micro-batch writes its own folder, named by the batch id and replaced if the batch runs again,
so a retry leaves no second copy. Readers take the newest row per product; ``compact`` folds old
batches into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise.operators.upsert import latest
from cartwise.plans.embedding import embed_products


def upsert_stream(products: DataFrame, vocab: DataFrame, table: str, checkpoint: str, version: str = "version"):
    """Start embedding a stream of products (product_id, texts, ``version``) into ``table``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        newest = latest(batch, "product_id", version)
        vectors = embed_products(newest, vocab).join(newest.select("product_id", version), "product_id")
        vectors.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{table}/part={batch_id}")

    return (
        products.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def current_vectors(spark: SparkSession, table: str, version: str = "version") -> DataFrame:
    """Newest vector of every product."""
    rows = spark.read.option("basePath", table).parquet(table)
    return latest(rows, "product_id", version, "batch").drop("part")


def compact(spark: SparkSession, table: str, target: str, version: str = "version") -> None:
    """Write the current state as the first batch of a new table."""
    current_vectors(spark, table, version).write.mode("overwrite").parquet(f"{target}/part=-1")
