"""Joins of two sides that both repeat their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.session import stage

BLOCK = 1024
PAIRS_PER_TASK = BLOCK * BLOCK
ROWS_PER_TASK = 256 * BLOCK  # of whole rows, which later windows sort
PLACE = "_place"


def block_join(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """Inner equi-join whose tasks are sized by the pairs they produce.

    A key with many rows on both sides produces far more than it reads, which neither a hash
    partitioning nor a size in bytes shows. So rows per key are counted first; the rows of a hot key
    are cut into blocks of about ``BLOCK`` on either side, and every pair of blocks becomes a key of
    its own. ``left_id`` and ``right_id`` are the columns that spread the rows of one key.
    """
    counts = left.groupBy(*keys).agg(F.count("*").alias("n_left")).join(
        right.groupBy(*keys).agg(F.count("*").alias("n_right")), keys
    )
    cuts = stage(counts.select(
        *keys,
        F.ceil(F.col("n_left") / BLOCK).cast("int").alias("cut_left"),
        F.ceil(F.col("n_right") / BLOCK).cast("int").alias("cut_right"),
        (F.col("n_left") * F.col("n_right")).alias("pairs"),
    ), "join-cuts")
    pairs = cuts.agg(F.sum("pairs")).first()[0] or 0  # a single number
    tasks = max(left.sparkSession.sparkContext.defaultParallelism, int(-(-pairs // PAIRS_PER_TASK)))
    cuts = cuts.drop("pairs")

    def blocks(side: DataFrame, key: str, own: str, other: str) -> DataFrame:
        placed = side.join(cuts, keys).withColumn(f"b_{own}", F.pmod(F.xxhash64(key), F.col(f"cut_{own}")))
        copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"cut_{other}").cast("long") - 1))
        return placed.withColumn(f"b_{other}", copies).drop("cut_left", "cut_right")

    on = [*keys, "b_left", "b_right"]
    # a number of partitions that is given is not reduced by their size in bytes
    spread = blocks(left, left_id, "left", "right").repartition(tasks, *on)
    return spread.join(blocks(right, right_id, "right", "left"), on).drop("b_left", "b_right")


def fan_out(left: DataFrame, right: DataFrame, key: str, left_id: str) -> DataFrame:
    """Inner equi-join of many rows of a key on the left with a short list of the key on the right.

    The rows of a key are dealt over blocks of about ``BLOCK``, and its list is copied to each. The result is
    partitioned by ``PLACE``, key and block, which it keeps: windows by ``PLACE`` and ``left_id`` find the rows of a
    left row in one task, so that the result, which is much larger than both sides, is not shuffled.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("n_left")).join(right.groupBy(key).agg(F.count("*").alias("n_right")), key)
    cuts = stage(counts.select(key, F.ceil(F.col("n_left") / BLOCK).cast("int").alias("cut"), (F.col("n_left") * F.col("n_right")).alias("rows")), "fan-cuts")
    rows = cuts.agg(F.sum("rows")).first()[0] or 0  # a single number
    tasks = max(left.sparkSession.sparkContext.defaultParallelism, int(-(-rows // ROWS_PER_TASK)))
    cuts = cuts.drop("rows")
    own = F.pmod(F.xxhash64(left_id), F.col("cut")).cast("int").alias("block")
    every = F.explode(F.sequence(F.lit(0), F.col("cut") - 1)).alias("block")
    dealt = left.join(cuts, key).withColumn(PLACE, F.struct(key, own)).drop("cut", key).repartition(tasks, PLACE)
    lists = right.join(cuts, key).select("*", every).withColumn(PLACE, F.struct(key, "block")).drop("cut", "block", key)
    return dealt.join(lists.repartition(tasks, PLACE), PLACE)
