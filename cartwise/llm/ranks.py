"""Gapless numbers in a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartwise.session import stage

_ROW_BITS = 33  # of monotonically_increasing_id, below the number of the partition


def placed(df: DataFrame, order: list[Column], within: list[Column] | None = None, label: str = "placed") -> DataFrame:
    """``df`` as a table sorted by range, with ``_at``: long, ascending in the order, by one from row to row of a partition.

    ``order`` cuts the ranges; ``within`` (by default the same) sorts each of them. The input is read twice.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*(within or order))
    return stage(ranged.withColumn("_at", F.monotonically_increasing_id()), label)


def numbered(df: DataFrame, order: list[Column], label: str = "numbered") -> DataFrame:
    """``df`` with ``_n``, from 0 in the order, and ``_part``, which bounds what shares a range partition."""
    rows = placed(df, order, label=label).withColumn("_part", F.shiftright("_at", _ROW_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    first = rows.groupBy("_part").agg(F.count("*").alias("_size")).select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_first"))
    row = F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)
    return rows.join(F.broadcast(first), "_part").withColumn("_n", F.col("_first") + row).drop("_first", "_at")
