"""User vectors as running sums, brought up to date by what was added.

A user vector is a weighted mean of product vectors, so two sums are enough: of weight times vector, and of
weights. Both add up over interactions, and over folders of changes (``sources.versions``). The weight of every
user and product is kept as well, so that a product's new vector is worth the difference to its old one, times the
weights it has. What an update writes grows with the update, and with the users of the products whose vectors changed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartwise.operators.upsert import latest
from cartwise.operators.user_vectors import _TOTAL
from cartwise.session import remove, stage
from cartwise.sources.versions import FAN, Folder, Version, like_sized, publish, read_version, unused

_TABLES = ("weights", "sums", "vectors")  # user_id, product_id, weight; user_id, fid, x; product_id, entries
_NONE = "array<struct<fid:int,weight:double>>"


@dataclass(frozen=True)
class UserStore:
    spark: SparkSession
    path: str

    def version(self, number: int | None = None) -> Version:
        return read_version(self.spark, self.path, number)

    def _table(self, folders: tuple[Folder, ...], name: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/changes/{f.name}/{name}" for f in folders])

    def _sums(self, folders: tuple[Folder, ...]) -> DataFrame:
        # a folder has a user's number once, so adding up before the shuffle would find nothing to add
        return self._table(folders, "sums").repartition("user_id").groupBy("user_id", "fid").agg(F.sum("x").alias("x"))

    def entries(self, version: Version | None = None, digits: int = 12) -> DataFrame:
        """(user_id, entries): weighted means; numbers that vanish at ``digits`` are left out."""
        sums = self._sums((version or self.version()).folders)
        rows = sums.groupBy("user_id").agg(
            F.collect_list(F.when(F.col("fid") != _TOTAL, F.struct("fid", "x"))).alias("xs"),  # as long as the vocabulary at most
            F.max(F.when(F.col("fid") == _TOTAL, F.col("x"))).alias("total"))
        means = F.transform("xs", lambda e: F.struct(
            e["fid"].alias("fid"), F.coalesce(F.try_divide(e["x"], F.col("total")), F.lit(0.0)).alias("weight")))
        return rows.select("user_id", F.array_sort(F.filter(means, lambda e: F.round(e["weight"], digits) != 0)).alias("entries"))

    def values(self, version: Version | None = None, digits: int = 12) -> DataFrame:
        """The numbers of ``entries``, a row each: (user_id, fid, weight)."""
        total = F.max(F.when(F.col("fid") == _TOTAL, F.col("x"))).over(Window.partitionBy("user_id"))
        mean = F.coalesce(F.try_divide("x", "total"), F.lit(0.0))
        means = self._sums((version or self.version()).folders).withColumn("total", total).filter(F.col("fid") != _TOTAL)
        return means.select("user_id", "fid", mean.alias("weight")).filter(F.round("weight", digits) != 0)

    def add(self, items: DataFrame, vectors: DataFrame | None = None, batch: int | None = None) -> Version:
        """Publish the version after new vectors of products (product_id, entries), then interactions (user_id, product_id, weight).

        A product whose entries are null has no vector any more.
        """
        now = self.version()
        if now.holds(batch):
            return now
        seq = now.folders[-1].seq + 1 if now.folders else 0
        name = f"{seq:08d}-{uuid.uuid4().hex[:8]}"
        path = f"{self.path}/changes/{name}"
        none = F.array().cast(_NONE)
        empty = self.spark.createDataFrame([], f"product_id long, entries {_NONE}")
        known = latest(self._table(now.folders, "vectors"), "product_id", "seq").select("product_id", "entries") if now.folders else empty
        given = empty if vectors is None else vectors.select("product_id", F.coalesce("entries", none).cast(_NONE).alias("entries"))
        self._write_vectors(path, seq, given)
        fresh = self.spark.read.parquet(f"{path}/vectors").select("product_id", "entries")
        items.groupBy("user_id", "product_id").agg(F.sum("weight").cast("double").alias("weight")).write.parquet(f"{path}/weights")
        current = known if vectors is None else known.join(fresh, "product_id", "left_anti").unionByName(fresh)
        weighed, groups = _with_ids(self.spark.read.parquet(f"{path}/weights"), current, "left", False)
        if vectors is not None and now.folders:
            both = fresh.withColumnRenamed("entries", "new").join(known, "product_id", "left")
            moved = both.select("product_id", F.concat("new", _negative(F.coalesce("entries", none))).alias("entries")).filter(F.size("entries") > 0)
            earlier, differences = _with_ids(self._table(now.folders, "weights"), moved, "inner", True)
            weighed, groups = weighed.unionByName(earlier), groups.unionByName(differences)
        return self._publish(now, self._folder(seq, name, _weighed(weighed, groups)), batch)

    def _publish(self, now: Version, folder: Folder, batch: int | None) -> Version:
        return publish(self.spark, self.path, Version(now.number + 1, (*now.folders, folder), now.batch if batch is None else batch))

    def _write_vectors(self, path: str, seq: int, vectors: DataFrame) -> None:
        vectors.select("product_id", "entries", F.lit(seq).cast("long").alias("seq")).write.parquet(f"{path}/vectors")

    def _folder(self, seq: int, name: str, sums: DataFrame) -> Folder:
        """Write the sums of a folder whose other tables are there."""
        path = f"{self.path}/changes/{name}/sums"
        sums.write.parquet(path)
        return Folder(seq, name, self.spark.read.parquet(path).count())

    def fold(self, fan: int | None = FAN) -> Version:
        """Publish a version in which the newest folders are one where ``fan`` or more are of like size; with None, all."""
        now = self.version()
        folders = now.folders
        while n := like_sized(folders, fan):
            part = folders[-n:]
            seq = part[-1].seq
            name = f"{seq:08d}-{uuid.uuid4().hex[:8]}"
            path = f"{self.path}/changes/{name}"
            self._table(part, "weights").groupBy("user_id", "product_id").agg(F.sum("weight").alias("weight")).write.parquet(f"{path}/weights")
            self._write_vectors(path, seq, latest(self._table(part, "vectors"), "product_id", "seq"))
            folders = (*folders[:-n], self._folder(seq, name, self._sums(part)))
        return now if folders == now.folders else publish(self.spark, self.path, Version(now.number + 1, folders, now.batch))

    def vacuum(self, keep: int = 1) -> None:
        for name in unused(self.spark, self.path, keep):
            remove(self.spark, f"{self.path}/changes/{name}")


def _negative(entries: Column) -> Column:
    return F.transform(entries, lambda e: F.struct(e["fid"].alias("fid"), (-e["weight"]).alias("weight")))


def _with_ids(weights: DataFrame, vectors: DataFrame, how: str, moved: bool) -> tuple[DataFrame, DataFrame]:
    """Weights with the id of their product's vector (user_id, moved, vid, vid2, weight), and the distinct vectors (moved, vid, vid2, entries).

    The id is 128 bits of hashes, so that nothing has to be numbered. ``moved`` tells differences, which weights of
    earlier folders are owed, from vectors.
    """
    kind = F.lit(moved).alias("moved")
    named = vectors.select("product_id", F.xxhash64("entries").alias("vid"), F.xxhash64(F.lit(1), "entries").alias("vid2"), "entries")
    ids = weights.join(named.drop("entries"), "product_id", how).select("user_id", kind, "vid", "vid2", "weight")
    return ids, named.select("vid", "vid2", "entries").distinct().select(kind, "vid", "vid2", "entries")


def _weighed(weights: DataFrame, groups: DataFrame) -> DataFrame:
    """(user_id, fid, x): entries times weights, and the weights under ``_TOTAL``, which differences do not add to.

    Weights are placed by user with the id of a vector; entries meet them there and are not shuffled. A product
    without vector has the total alone.
    """
    total = F.array(F.struct(F.lit(_TOTAL).alias("fid"), F.lit(1.0).alias("weight")))
    parts = F.when(F.col("moved"), F.col("entries")).otherwise(F.concat(total, F.col("entries")))
    owed = stage(groups.select("moved", "vid", "vid2", parts.alias("parts")), "distinct-vectors")
    rows = weights.repartition("user_id").join(owed, ["moved", "vid", "vid2"], "left").select("user_id", "weight", F.inline_outer("parts").alias("fid", "part"))
    x = F.col("weight") * F.coalesce("part", F.lit(1.0))
    return rows.select("user_id", F.coalesce("fid", F.lit(_TOTAL)).alias("fid"), x.alias("x")).groupBy("user_id", "fid").agg(F.sum("x").alias("x"))


def create(spark: SparkSession, path: str) -> UserStore:
    """An empty store."""
    publish(spark, path, Version(0, (), None))
    return UserStore(spark, path)
