"""Exact top-k search by inner product over an impact-ordered index, score at a time.

Index: vectors of whole numbers are dealt into shards. Within a shard every component is quantised to a
level of ``WIDTH`` values, its impact, and a posting segment lists the vectors of one level of one axis.
A query weighs each segment by its own component times the middle of the level, less the least such
weight of the axis, and takes the segments of all axes by descending weight, adding each to the sums of
the vectors it lists. After some of the segments the most that any vector can still gain is the sum
over axes of the next weight; what a vector may be off by quantisation is at most the norm of the query
times the norm of the vector's remainders (Cauchy-Schwarz). Vectors whose upper bound is below the k-th
best lower bound are out, by proof; that is looked at ``CHECKS`` times. Processing stops only when at most
``RESCORE`` vectors remain, or at the last segment; all that remain are rescored exactly.

Each shard of the index meets each block of queries in one task, and hands on k rows per query; the
best k of all shards are the answer. Shards, blocks and tasks are of fixed size.

Vectors with a component of ``LARGE`` or more once made whole are dealt into shards of their own, without
segments. There, and wherever products of a shard and a query may not fit 64 bits, scores are taken in
floating point with a bound on their error; vectors whose upper bound is below the k-th best lower bound
are out, and the rest are rescored in whole numbers of any size.

Cases: a vector that is null or holds a null or non-finite component takes no part, nor does one without
an id. All others do: a component made whole is a double, which holds it exactly; one that is beyond
doubles once scaled (2**1016 and more, in a column of doubles) is an error. A score that does not fit 64
bits is null; its row has its id, and its rank by the exact score. Only vectors of equal length are compared. Rows
with the query's id are not its candidates. Ties go to the smaller id; rows that repeat an id are
candidates each. A query that repeats id and vector is answered once. Other columns are not kept. Empty
tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartwise.session import stage

K = 5
WIDTH = 16
SHARD = 16_384
QUERY_BLOCK = 4096  # an index is copied once for so many queries
RESCORE = 64
CHECKS = 16
LARGE = 1 << 28


def whole_vectors(vectors: DataFrame, key: str, vector: str, scale: float = 256.0) -> DataFrame:
    """(vec_id, x): components as floor(scale * component), in doubles; vectors that take no part are left out."""
    usable = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))

    def whole(c: Column) -> Column:  # from 2**53 on, every double is whole
        scaled = c.cast("double") * scale
        return F.when(F.abs(scaled) < float(1 << 53), F.floor(scaled).cast("double")).when(F.abs(scaled) < float("inf"), scaled).otherwise(
            F.raise_error(F.lit("a component is beyond doubles once scaled")).cast("double"))

    return (
        vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(F.col(vector), usable))
        .select(F.col(key).cast("long").alias("vec_id"), F.transform(F.col(vector), whole).alias("x"))
    )


def build_index(whole: DataFrame, shard_rows: int = SHARD, width: int = WIDTH) -> DataFrame:
    """Posting segments: dims, shard, axis, level, rows (binary, int32); axis -1 holds ids and vectors of the shard.

    Shards of vectors with large components have negative numbers and no segments; their vectors are doubles.
    """
    shards = max(1, -(-whole.count() // shard_rows))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        ids = group["vec_id"].to_numpy(np.int64)
        x = np.stack(group["x"].to_numpy()) if len(group["x"].iloc[0]) else np.zeros((len(ids), 0))
        dims, shard = int(group["dims"].iloc[0]), int(group["shard"].iloc[0])
        large = shard < 0
        x = x if large else x.astype(np.int64)
        rows = [(dims, shard, -1, 0, ids.tobytes(), x.astype("<f8" if large else "<i4").tobytes())]
        for axis in () if large else range(x.shape[1]):
            level = x[:, axis] // width
            order = np.argsort(level, kind="stable")
            cuts = np.flatnonzero(np.diff(level[order])) + 1
            for part in np.split(order, cuts):
                rows.append((dims, shard, axis, int(level[part[0]]), part.astype("<i4").tobytes(), None))
        return pd.DataFrame(rows, columns=["dims", "shard", "axis", "level", "rows", "vectors"])

    place = F.pmod(F.xxhash64("vec_id", "x"), F.lit(shards)).cast("int")
    large = F.exists("x", lambda c: F.abs(c) >= float(LARGE))
    placed = whole.withColumn("dims", F.size("x")).withColumn("shard", F.when(large, -1 - place).otherwise(place))
    return placed.groupBy("dims", "shard").applyInPandas(build, "dims int, shard int, axis int, level long, rows binary, vectors binary")


def _order(score: int) -> tuple[int, int | None, bytes | None]:
    """(side, score, wide): scores are ordered as these are; ``side`` is 1 or -1 above or below 64 bits, where ``wide`` has the score."""
    if -(1 << 63) <= score < 1 << 63:
        return 0, score, None
    size = -(-abs(score).bit_length() // 8)
    wide = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return (1, None, wide) if score > 0 else (-1, None, bytes(255 - b for b in wide))


class Shard:
    """One shard of the index, loaded."""

    def __init__(self, rows: pd.DataFrame, width: int):
        head = rows[rows["axis"] == -1].iloc[0]
        dims = int(head["dims"])
        self.ids = np.frombuffer(head["rows"], np.int64)
        self.large = int(head["shard"]) < 0
        self.x = np.frombuffer(head["vectors"], "<f8" if self.large else "<i4").reshape(len(self.ids), dims)
        self.most = int(np.abs(self.x).max(initial=0))
        self.scaled = None
        if self.large:
            return
        self.x = self.x.astype(np.int64)
        segments = rows[rows["axis"] >= 0].sort_values(["axis", "level"])
        self.axis = segments["axis"].to_numpy(np.int64)
        self.middle = segments["level"].to_numpy(np.float64) * width + (width - 1) / 2
        self.lists = [np.frombuffer(b, "<i4").astype(np.intp) for b in segments["rows"]]
        rest = self.x - (self.x // width * width + (width - 1) / 2)
        self.off = np.sqrt((rest**2).sum(axis=1))
        self.first = np.searchsorted(self.axis, np.arange(dims))
        self.read = 0  # segments, by all searches

    def search(self, query_id: int, q: np.ndarray, k: int) -> tuple[list[int], list[int]]:
        """Ids and scores of the best k, best first, for ``q``, whole numbers in doubles."""
        if self.large or self.most * int(np.abs(q).max(initial=0)) * len(q) >= 1 << 63 or np.abs(q).max(initial=0) >= LARGE:
            return self._search_wide(query_id, q, k)
        q = q.astype(np.int64)
        weight = q[self.axis] * self.middle
        least = np.minimum.reduceat(weight, self.first) if len(weight) else np.zeros(0)
        gain = weight - least[self.axis]
        order = np.argsort(-gain, kind="stable")
        order = order[gain[order] > 0]
        sums = np.full(len(self.ids), least.sum())
        slack = np.sqrt(float(q @ q)) * self.off
        slack += 1e-9 * (slack + np.abs(weight).sum()) + 1e-6
        left = gain.copy()
        done, alive = 0, np.flatnonzero(self.ids != query_id)
        few = max(k, min(RESCORE, len(self.ids) // 8))  # of a small shard, an eighth
        for step in range(1, CHECKS + 1):
            if len(alive) <= few:
                break
            until = -(-step * len(order) // CHECKS)
            for s in order[done:until].tolist():
                sums[self.lists[s]] += gain[s]
            left[order[done:until]] = 0
            self.read, done = self.read + until - done, until
            to_come = np.maximum.reduceat(left, self.first).sum() if len(left) else 0.0
            lower = (sums - slack)[alive]
            bar = np.partition(lower, len(lower) - k)[len(lower) - k]
            alive = alive[(sums + slack)[alive] + to_come >= bar]
        scores = self.x[alive] @ q
        best = np.lexsort((self.ids[alive], -scores))[:k]
        return self.ids[alive][best].tolist(), scores[best].tolist()

    def _search_wide(self, query_id: int, q: np.ndarray, k: int) -> tuple[list[int], list[int]]:
        """As ``search``, for products of any size."""
        if self.scaled is None:  # by a power of two, to at most 1, so that no product overflows
            self.scaled = np.ldexp(self.x.astype(np.float64), -self.most.bit_length())
        by = np.ldexp(q, -int(np.abs(q).max(initial=0)).bit_length())
        about = self.scaled @ by
        slack = (len(q) + 4) * (2.0**-52 * (np.abs(self.scaled) @ np.abs(by)) + 2.0**-1000)
        alive = np.flatnonzero(self.ids != query_id)
        if len(alive) > k:
            lower = (about - slack)[alive]
            bar = np.partition(lower, len(lower) - k)[len(lower) - k]
            alive = alive[(about + slack)[alive] >= bar]
        whole = [int(c) for c in q]
        found = sorted((-sum(int(a) * b for a, b in zip(self.x[i].tolist(), whole)), int(self.ids[i])) for i in alive.tolist())[:k]
        return [i for _, i in found], [-score for score, _ in found]


def search(index: DataFrame, queries: DataFrame, k: int = K, width: int = WIDTH, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for each of ``queries`` (vec_id, x). ``index`` is a table of ``build_index``."""
    queries = stage(queries.distinct().withColumn("name", F.xxhash64("x")), "queries")
    blocks = max(1, -(-queries.count() // query_block))
    shards = stage(index.select("dims", "shard").distinct(), "shards")
    asked = queries.withColumn("dims", F.size("x")).withColumn("block", F.pmod(F.xxhash64("vec_id", "name"), F.lit(blocks)).cast("int"))
    asked = asked.join(shards, "dims")
    offered = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def answer(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(wanted):
            shard = Shard(rows, width)
            for query_id, name, x in zip(wanted["vec_id"], wanted["name"], wanted["x"]):
                out += [(query_id, name, i, *_order(score)) for i, score in zip(*shard.search(query_id, np.asarray(x, np.float64), k))]
        columns = list(zip(*out)) or [()] * 6
        return pd.DataFrame({"query_id": np.array(columns[0], np.int64), "name": np.array(columns[1], np.int64), "vec_id": np.array(columns[2], np.int64),
                             "side": np.array(columns[3], np.int32), "score": pd.array(columns[4], dtype="Int64"),
                             "wide": pd.Series(columns[5], dtype=object)})

    keys = ["dims", "shard", "block"]
    found = offered.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(
        answer, "query_id long, name long, vec_id long, side int, score long, wide binary")
    best = Window.partitionBy("query_id", "name").orderBy(F.desc("side"), F.desc("score"), F.desc("wide"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
