"""Merkle manifest of a dataset: a tree per source, a tree over the sources' roots, and a proof for every row.

H is the lowercase hex SHA-256 of its inputs in a row, digests as hex text. A row's leaf is H of its
fields; leaves of a source ascend by key. While a tree has several nodes, every ``FAN`` consecutive ones
(fewer at the end, even one) become their H; what remains is the source's subroot, and the subroots,
by source, form a tree of the same kind, whose last node is the root.

``build`` numbers leaves by a global sort, so that no task sees a source whole, and stores the levels as
parent-linked node rows. A node row holds a block of ``FAN ** RUNG`` neighbours, the levels above them up
to the one node they become, and the row and slot where that node goes on; so a stored row is some two
kilobytes, whatever the tree, and a climb takes a third of the steps that single levels would.

``climb`` is a Spark recursive query. Its first rows are the leaves with the digests that a copy of the
data claims for them; a step joins each leaf's row with the node row it stands below, appends the siblings
on the way through that block and folds the claimed digest up. The rows of a leaf, one a step, are put
together at the end; equality of the fold with the root proves the leaf. Every leaf climbs by itself, so a
step moves about a hundred bytes a leaf, and the proofs, which are long, are shuffled once.

Cases: a null field is ``-``, an empty one ``0:``. Null keys come first. Rows equal in key and source are
leaves of their own, by digest. A null source is a tree of its own, before the others. A lone leaf is its
subroot, a lone subroot the root, without hashing. An empty table has no rows and no root. Other columns,
whatever their names, take no part. A text is hashed whole within its row.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartwise.llm.columns import let
from cartwise.llm.ranks import numbered
from cartwise.session import stage

FAN = 3
RUNG = 3
BLOCK = FAN**RUNG
_LEVEL = 1 << 53  # node rows of a level are numbered by the first leaf they cover
_TOP = 100  # levels of the tree over sources begin here
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


class Manifest(NamedTuple):
    """``leaves``: leaf_no, key, leaf, node, slot. ``nodes``: node, levels, parent, parent_slot, enters. ``root``: hex, or None."""

    leaves: DataFrame
    nodes: DataFrame
    root: str | None


def hashed(parts: Column) -> Column:
    """Digest (32 bytes) of the hex text of some digests put together."""
    return F.unhex(F.sha2(F.lower(F.hex(parts)).cast("binary"), 256))


def leaf_digest(*fields: Column) -> Column:
    """Digest of a row: each field as ``-`` if null, else its bytes of UTF-8, a colon, the value."""
    def shown(c: Column) -> Column:
        return let(c.cast("string"), lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")))

    return F.unhex(F.sha2(F.concat(*map(shown, fields)).cast("binary"), 256))


def _lifted(nodes: Column) -> Column:
    """The next level above an array of neighbouring digests."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    joined = lambda run: F.aggregate(run, F.lit("").cast("binary"), lambda a, x: F.concat(a, x))
    return F.transform(runs, lambda i: hashed(joined(F.slice(nodes, i * FAN + 1, FAN))))


def _node(level: int, tree: Column, block: Column) -> Column:
    return F.lit(level * _LEVEL) + tree + block * F.lit(BLOCK ** (level % _TOP + 1))


def _block_rows(base: DataFrame, level: int) -> DataFrame:
    """Node rows over ``base`` (tree, size, pos, digest), the nodes at the foot of a rung; ``left`` nodes are in the tree there."""
    left = F.ceil(F.col("size") / F.lit(float(BLOCK ** (level % _TOP))))
    lifts = sum([F.when(left > FAN**k, 1).otherwise(0) for k in range(RUNG)], F.lit(0))
    rows = base.groupBy("tree", "size", F.floor(F.col("pos") / BLOCK).alias("block")).agg(  # BLOCK rows a group at most
        F.sort_array(F.collect_list(F.struct((F.col("pos") % BLOCK).alias("slot"), "digest"))).alias("foot"))
    climbed = F.aggregate(F.slice(F.array(*map(F.lit, range(RUNG))), F.lit(1), lifts), F.array(F.col("foot.digest")),
                          lambda levels, _: F.concat(levels, F.array(_lifted(F.element_at(levels, -1)))))
    rows = rows.withColumn("all", climbed)
    return rows.select("tree", "size", "block", (left <= BLOCK).alias("last"), _node(level, F.col("tree"), F.col("block")).alias("node"),
                       F.col("all").alias("levels"), F.element_at("all", -1)[0].alias("apex"))


def _tree_rows(base: DataFrame, most: int, level: int) -> list[DataFrame]:
    """Staged node rows of all rungs of some trees, of which the largest has ``most`` leaves."""
    rungs = []
    while True:
        rungs.append(stage(_block_rows(base, level), f"nodes-{level}"))
        if most <= BLOCK:
            return rungs
        most, level = -(-most // BLOCK), level + 1
        base = rungs[-1].filter(~F.col("last")).select("tree", "size", F.col("block").alias("pos"), F.col("apex").alias("digest"))


def build(rows: DataFrame, key: str, source: str, leaf: str) -> Manifest:
    """Manifest of ``rows``, a table with a key, a source and a ``leaf_digest``; its leaves have all columns of ``rows``."""
    in_order = [F.col(source).asc_nulls_first(), F.col(key).asc_nulls_first(), F.col(leaf)]
    leaves = numbered(rows, in_order, "leaves")
    spans = leaves.groupBy("_part", source).agg(F.min("_n").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy(source)  # a row per range partition
    spans = stage(spans.select(F.col("_part").alias("_p"), F.col(source).alias("_s"), F.min("first").over(whole).alias("tree"),
                               F.sum("n").over(whole).alias("size")), "spans")
    here = (F.col("_part") == F.col("_p")) & F.col(source).eqNullSafe(F.col("_s"))
    leaves = leaves.join(spans, here).drop("_p", "_s", "_part").withColumn("pos", F.col("_n") - F.col("tree"))
    leaves = stage(leaves.withColumnRenamed("_n", "leaf_no"), "leaves-of-trees")
    trees = stage(numbered(spans.select("tree", "size").distinct(), [F.col("tree")], "trees").select("tree", "size", F.col("_n").alias("rank")), "ranks")
    count, most = trees.agg(F.count("*"), F.max("size")).first()
    base = leaves.select("tree", "size", "pos", F.col(leaf).alias("digest"))
    rungs = _tree_rows(base, most or 0, 0)
    links = []
    for level, rung in enumerate(rungs):
        inner = rung.filter(~F.col("last")).select("node", "levels", _node(level + 1, F.col("tree"), F.floor(F.col("block") / BLOCK)).alias("parent"),
                                                   (F.col("block") % BLOCK).alias("parent_slot"))
        ends = rung.filter("last").join(trees.select("tree", "rank"), "tree").select(
            "node", "levels", _node(_TOP, F.lit(0), F.floor(F.col("rank") / BLOCK)).alias("parent"), (F.col("rank") % BLOCK).alias("parent_slot"))
        links += [inner, ends]
    apexes = [rung.filter("last").select("tree", "apex") for rung in rungs]
    subroots = apexes[0]
    for more in apexes[1:]:
        subroots = subroots.union(more)
    subroots = subroots.join(trees.select("tree", "rank"), "tree").select(
        F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("size"), F.col("rank").alias("pos"), F.col("apex").alias("digest"))
    above = _tree_rows(subroots, count, _TOP)
    for level, rung in enumerate(above, _TOP):
        up = F.when(~F.col("last"), _node(level + 1, F.col("tree"), F.floor(F.col("block") / BLOCK)))
        links.append(rung.select("node", "levels", up.alias("parent"), (F.col("block") % BLOCK).alias("parent_slot")))
    nodes = links[0].withColumn("enters", F.lit(False))
    for i, more in enumerate(links[1:], 1):
        nodes = nodes.union(more.withColumn("enters", F.lit(i == 2 * len(rungs))))
    nodes = stage(nodes.withColumn("parent_slot", F.col("parent_slot").cast("int")), "nodes")
    last = above[-1].select(F.lower(F.hex("apex"))).first()
    at = leaves.withColumn("node", _node(0, F.col("tree"), F.floor(F.col("pos") / BLOCK))).withColumn("slot", (F.col("pos") % BLOCK).cast("int"))
    return Manifest(at.drop("tree", "size", "pos"), nodes, last[0] if last else None)


@contextmanager
def _no_row_limit(spark: SparkSession) -> Iterator[None]:
    """Recursive queries may return any number of rows meanwhile; the caller's setting is put back."""
    before = spark.conf.get(_ROW_LIMIT, None)
    spark.conf.set(_ROW_LIMIT, "-1")
    try:
        yield
    finally:
        spark.conf.set(_ROW_LIMIT, before) if before is not None else spark.conf.unset(_ROW_LIMIT)


#: All but the apex of ``levels`` is climbed: f, the fold; p, the siblings; i, the place in the level.
_CLIMB = f"""
WITH RECURSIVE climb(leaf_no, key, node, slot, step, folded, siblings, stored) AS (
  SELECT leaf_no, key, node, slot, 0, claimed, CAST('' AS BINARY), leaf FROM {{leaves}}
  UNION ALL
  SELECT leaf_no, key, parent, parent_slot, step + 1, up.f, up.p, stored FROM (
    SELECT c.leaf_no, c.key, n.parent, n.parent_slot, c.step, CASE WHEN n.enters THEN n.levels[0][c.slot] END AS stored,
      aggregate(slice(n.levels, 1, size(n.levels) - 1), named_struct('f', c.folded, 'p', unhex(''), 'i', c.slot), (a, level) ->
        named_struct(
          'f', unhex(sha2(CAST(lower(hex(concat(
             aggregate(slice(level, a.i - a.i % {FAN} + 1, a.i % {FAN}), CAST('' AS BINARY), (x, y) -> concat(x, y)), a.f,
             aggregate(slice(level, a.i + 2, {FAN} - 1 - a.i % {FAN}), CAST('' AS BINARY), (x, y) -> concat(x, y))))) AS BINARY), 256)),
          'p', concat(a.p,
             aggregate(slice(level, a.i - a.i % {FAN} + 1, a.i % {FAN}), CAST('' AS BINARY), (x, y) -> concat(x, y)),
             aggregate(slice(level, a.i + 2, {FAN} - 1 - a.i % {FAN}), CAST('' AS BINARY), (x, y) -> concat(x, y))),
          'i', CAST(a.i div {FAN} AS INT))) AS up
    FROM climb c JOIN {{nodes}} n ON c.node = n.node))
SELECT leaf_no, key, step, siblings, stored, CASE WHEN node IS NULL THEN folded END AS top FROM climb
"""


def climb(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, leaf, subroot, folded_root (hex) and proof (siblings as one binary), a row per leaf.

    ``leaves``: leaf_no, key, node, slot, leaf and claimed, the digest that is to be proved; ``nodes`` as of a Manifest.
    """
    spark = leaves.sparkSession
    with _no_row_limit(spark):
        steps = spark.sql(_CLIMB, leaves=leaves, nodes=nodes)
        proofs = steps.groupBy("leaf_no").agg(
            F.first("key").alias("key"), F.min_by("stored", "step").alias("leaf"),
            F.max_by("stored", F.when(F.col("stored").isNotNull(), F.col("step"))).alias("subroot"), F.max("top").alias("top"),
            F.sort_array(F.collect_list(F.struct("step", "siblings"))).alias("way"))  # a step per rung
        whole = F.aggregate("way", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["siblings"]))
        hexed = [F.lower(F.hex(c)).alias(name) for c, name in (("leaf", "leaf"), ("subroot", "subroot"), ("top", "folded_root"))]
        return stage(proofs.select("key", *hexed, whole.alias("proof")), "proofs")
