"""Sharding along a Hilbert curve through several metadata dimensions.

Each dimension is quantised to ``2**bits`` bins of about equal row counts; a document's bins are the
coordinates of a cell, and cells are ordered by their place on the Hilbert curve, whose neighbours are
neighbours in every dimension. The order of all documents is then cut into runs of equal length, the
shards, so each shard covers a small box of cells and a filter on any of the dimensions can skip
shards by the least and largest values in ``manifest``.

Law: ``rows``. Shard sizes in documents differ by one at most, and slots count from 0 without gaps.

Ranks are found without one task seeing all rows: rows of a cell are dealt into hashed lots, counted
per lot, and ranked within the lot; sums over lots of a cell and over cells, of which there are at
most ``2**(bits * dimensions)``, give each lot its first rank. A cell with a third of all rows is so
spread over many lots.

Cases: a null in a dimension is in the first bin. Strings are placed as a whole.
Ties within a lot are ordered by the key columns; repeated rows get ranks of their own. With fewer
rows than shards some shards are empty. An empty table gives an empty result. Columns of the input
stay, apart from ``curve``, ``shard`` and ``slot``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cartwise.llm.columns import pack, unpack
from cartwise.session import stage

BITS = 4
LOT_ROWS = 100_000  # rows of an average lot at most
LOTS = 64  # of a cell at least
_ACCURACY = 10_000


def _text_cuts(df: DataFrame, name: str, steps: list[float]) -> list[str]:
    """For each share in ``steps`` the least string that, with those before it, makes up that share of the rows.

    Distinct strings are counted, sorted by range, and summed up within ranges and over them, so no task orders them all.
    """
    values = df.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).agg(F.count("*").alias("n"))
    placed = stage(stage(values, "values").repartitionByRange("v").withColumn("part", F.spark_partition_id()), "values-by-range")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    parts = placed.groupBy("part").agg(F.sum("n").alias("m"))
    total = parts.agg(F.sum("m")).first()[0] or 0
    parts = parts.select("part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("first"))
    upto = F.col("first") + F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    summed = placed.join(F.broadcast(parts), "part").withColumn("upto", upto)
    found = summed.agg(*[F.min(F.when(F.col("upto") >= s * total, F.col("v"))).alias(f"c{i}") for i, s in enumerate(steps)]).first()
    return [c for c in found if c is not None]


def curve_index(df: DataFrame, bins: list[str], bits: int, out: str) -> DataFrame:
    """``df`` with the Hilbert index of the cell whose coordinates are the integer columns ``bins``.

    The usual transposition: from the highest bit down, each axis either inverts or swaps the lower
    bits of the first axis; then a Gray code, and the bits of the axes are interleaved.
    """
    axes = [f"_axis{i}" for i in range(len(bins))]
    df = df.withColumns({a: F.col(b).cast("long") for a, b in zip(axes, bins, strict=True)})
    first = F.col(axes[0])
    for q in range(bits - 1, 0, -1):
        low = (1 << q) - 1
        for a in axes:
            set_bit = F.col(a).bitwiseAND(1 << q) != 0
            swap = first.bitwiseXOR(F.col(a)).bitwiseAND(low)
            new = {axes[0]: F.when(set_bit, first.bitwiseXOR(F.lit(low))).otherwise(first.bitwiseXOR(swap))}
            if a != axes[0]:
                new[a] = F.when(set_bit, F.col(a)).otherwise(F.col(a).bitwiseXOR(swap))
            df = df.withColumns(new)
    for before, a in zip(axes, axes[1:]):
        df = df.withColumn(a, F.col(a).bitwiseXOR(F.col(before)))
    flip = F.lit(0).cast("long")
    for q in range(bits - 1, 0, -1):
        flip = flip.bitwiseXOR(F.when(F.col(axes[-1]).bitwiseAND(1 << q) != 0, (1 << q) - 1).otherwise(0))
    df = df.withColumn("_flip", flip)
    index = F.lit(0).cast("long")
    for q in range(bits - 1, -1, -1):
        for a in axes:
            index = index * 2 + F.shiftright(F.col(a).bitwiseXOR(F.col("_flip")), q).bitwiseAND(1)
    return df.withColumn(out, index).drop("_flip", *axes)


def quantise(df: DataFrame, dims: list[str], bits: int) -> tuple[DataFrame, list[str]]:
    """``df`` with a bin column for each dimension: how many of 2**bits - 1 bounds its value is above.

    Bounds cut all rows into parts of about equal size by percentiles, of strings by whole strings.
    """
    steps = [i / 2**bits for i in range(1, 2**bits)]
    texts = [d for d in dims if isinstance(df.schema[d].dataType, T.StringType)]
    numbers = [d for d in dims if d not in texts]
    cuts: dict[str, list] = {d: _text_cuts(df, d, steps) for d in texts}
    if numbers:
        found = df.agg(*[F.percentile_approx(F.col(d).cast("double"), steps, _ACCURACY).alias(d) for d in numbers]).first()
        cuts |= {d: found[d] or [] for d in numbers}
    bins = {}
    for i, d in enumerate(dims):
        value = F.col(d) if d in texts else F.col(d).cast("double")
        bins[f"_bin{i}"] = F.coalesce(sum([F.when(value > c, 1).otherwise(0) for c in cuts[d]], F.lit(0)), F.lit(0))
    return df.withColumns(bins), list(bins)


def hilbert_shards(docs: DataFrame, dims: list[str], keys: list[str], shards: int, bits: int = BITS) -> DataFrame:
    """``docs`` with ``curve`` (cell on the curve), ``shard`` and ``slot``. ``keys`` name a row and order ties."""
    keyed = [F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)]
    names = [f"_key{i}" for i in range(len(keys))]
    df = docs.select(pack(docs, "curve", "shard", "slot"), *keyed, *[F.col(f"`{d}`").alias(f"_dim{i}") for i, d in enumerate(dims)])
    df = stage(df, "sharded-rows")
    df, bins = quantise(df, [f"_dim{i}" for i in range(len(dims))], bits)
    # as a table, for bins of an empty table or column are constants, which the optimiser would carry through every step
    df = stage(df.select("_row", *names, *bins), "bins")
    df = stage(curve_index(df, bins, bits, "curve").select("_row", *names, "curve"), "curve")
    rows = df.count()
    cuts = [s * rows // shards for s in range(shards)]
    lots = max(LOTS, -(-rows // LOT_ROWS))
    df = df.withColumn("_lot", F.pmod(F.xxhash64(*names), F.lit(lots)))
    counts = stage(df.groupBy("curve", "_lot").agg(F.count("*").alias("n")), "lots")
    cells = counts.groupBy("curve").agg(F.sum("n").alias("m"))
    before = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)  # over cells, of which there are few
    cells = cells.select("curve", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("_cell"))
    within = Window.partitionBy("curve").orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("curve", "_lot", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("_in_cell")).join(cells, "curve")
    first = first.select("curve", "_lot", (F.col("_cell") + F.col("_in_cell")).alias("_first"))
    in_lot = Window.partitionBy("curve", "_lot").orderBy(*names)
    ranked = df.withColumn("_n", F.row_number().over(in_lot)).join(first, ["curve", "_lot"])
    ranked = ranked.withColumn("_rank", F.col("_first") + F.col("_n") - 1)
    shard = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= F.col("_rank"))) - 1
    ranked = ranked.withColumn("shard", shard.cast("int"))
    start = F.array(*[F.lit(c).cast("long") for c in cuts])[F.col("shard")]
    return unpack(ranked, "curve", "shard", (F.col("_rank") - start).cast("long").alias("slot"))


def manifest(sharded: DataFrame, dims: list[str]) -> DataFrame:
    """Per shard its rows, its run of the curve, and the least and largest value of each dimension, for pruning."""
    spans = [f(F.col(f"`{d}`")).alias(f"{name}_{d}") for d in dims for name, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), F.min("curve").alias("first_cell"), F.max("curve").alias("last_cell"), *spans)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Files by shard, rows in curve order, so files and row groups prune as well. A shard is many files."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
