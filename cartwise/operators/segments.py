"""A search index on files that is updated by segments.

A segment is written once: the products that an update brought, the copy groups formed anew, their
postings, and the largest weights of their terms. It also names the groups that the update undid, its tombstones,
which hide these groups in all segments before it. An update so writes in proportion to what changed; segments
that have become many are folded into one.

A version of the index is a list of segments (``sources.versions``), published in one step after all of
them are there. Readers take the newest version once and keep it: segments are never changed, so they see
the index before an update or after it, never between. Versions are written by one writer at a time; a second
one fails. A version also says which batch of a stream it holds, and a batch it holds is not applied again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise import constants as K
from cartwise.operators import index as IX
from cartwise.operators import tfidf as TF
from cartwise.operators.index import SearchIndex
from cartwise.operators.upsert import latest
from cartwise.session import remove, stage
from cartwise.sources.versions import FAN, Folder, Version, like_sized, publish, read_version, unused

@dataclass(frozen=True)
class IndexStore:
    """An index at ``path`` for result lists up to ``k``."""

    spark: SparkSession
    path: str
    k: int
    stock_only: bool

    # --- versions

    def version(self, number: int | None = None) -> Version:
        """The newest version, or an earlier one."""
        return read_version(self.spark, self.path, number)

    def publish(self, version: Version) -> Version:
        return publish(self.spark, self.path, version)

    # --- reading

    def _table(self, segments: tuple[Folder, ...], name: str) -> DataFrame:
        """Rows of all segments, with the ``seq`` of theirs."""
        return self.spark.read.parquet(*[f"{self.path}/segments/{s.name}/{name}" for s in segments])

    def _live(self, segments: tuple[Folder, ...], name: str) -> DataFrame:
        """Rows of groups that no later segment hides."""
        rows = self._table(segments, name)
        if len(segments) == 1:
            return rows.drop("seq")
        hidden = self._table(segments, "tombstones").groupBy("gid").agg(F.max("seq").alias("until"))
        return rows.join(hidden, (rows["gid"] == hidden["gid"]) & (F.col("seq") < F.col("until")), "left_anti").drop("seq")

    def open(self, version: Version | None = None) -> SearchIndex:
        """The index of a version, by default of the newest one, over all its segments.

        The best postings of a term are visible ones among the best of each segment, so bounds taken from them hold.
        """
        segments = (version or self.version()).folders
        return SearchIndex(self.vocab(), self._live(segments, "members"), self._live(segments, "postings"),
                           self._live(segments, "heads"), self._blocks(segments), self.k)

    def vocab(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vocab")

    def catalogue(self, version: Version | None = None) -> DataFrame:
        """Products of a version."""
        return _newest(self._table((version or self.version()).folders, "products")).filter(~F.col("removed")).drop("removed")

    def _blocks(self, segments: tuple[Folder, ...]) -> DataFrame:
        """Blocks over all segments. They may count hidden groups, which only makes them less tight."""
        return self._table(segments, "blocks").groupBy("tid", "bucket").agg(
            F.sum("n").alias("n"), F.max("top_dense").alias("top_dense"), F.max("top_sparse").alias("top_sparse"))

    # --- writing

    def _write_segment(self, seq: int, products: DataFrame, groups: DataFrame, gone: DataFrame, vocab: DataFrame) -> Folder:
        """``products`` with ``removed``, ``groups`` of ``copy_groups``."""
        name = f"{seq:08d}-{uuid.uuid4().hex[:8]}"
        folder = f"{self.path}/segments/{name}"
        of = F.lit(seq).cast("long")
        products.withColumn("seq", of).write.parquet(f"{folder}/products")
        groups.select("gid", "copies", "ordinal", "product_id", of.alias("seq")).write.parquet(f"{folder}/members")
        gone.select("gid", of.alias("seq")).write.parquet(f"{folder}/tombstones")
        return self._write_postings(seq, name, IX.postings(groups, vocab))

    def _write_postings(self, seq: int, name: str, postings: DataFrame) -> Folder:
        folder = f"{self.path}/segments/{name}"
        written = postings.withColumn("seq", F.lit(seq).cast("long"))
        written.write.parquet(f"{folder}/postings")
        stored = self.spark.read.schema(written.schema).parquet(f"{folder}/postings")
        IX.term_blocks(stored).write.parquet(f"{folder}/blocks")
        IX.term_heads(stored, self.k).withColumn("seq", F.lit(seq).cast("long")).write.parquet(f"{folder}/heads")
        return Folder(seq, name, stored.count())

    def apply(self, changes: DataFrame, batch: int | None = None) -> Version:
        """Publish the version after ``changes``: whole products that are new or replace those of their product_id, or,
        with ``removed`` true, only their product_id.

        ``changes`` holds a product once. ``ordinal`` is the place of a product in the catalogue. Products that do not share a
        text with a changed one, before or after, are not looked at again. With ``batch``, nothing is done if the index
        already holds that batch or a later one.
        """
        now = self.version()
        if now.holds(batch):
            return now
        stored = self._table(now.folders, "products")
        removed = F.coalesce("removed", F.lit(False)) if "removed" in changes.columns else F.lit(False)
        columns = [c for c in stored.columns if c not in ("removed", "seq")]
        typed = [F.col(c).cast(stored.schema[c].dataType).alias(c) if c in changes.columns else F.lit(None).cast(stored.schema[c].dataType).alias(c)
                 for c in columns]
        changes = stage(changes.select(*typed, removed.alias("removed")), "changes")
        ids = changes.select("product_id")
        new = IX.with_corpus_text(changes.filter(~F.col("removed")).drop("removed"))
        old = IX.with_corpus_text(_newest(stored.join(ids, "product_id", "left_semi")).filter(~F.col("removed")))
        texts = stage(new.select(F.col("text").alias("_text")).union(old.select("text")).distinct(), "touched-texts")

        def touched(products: DataFrame) -> DataFrame:  # a missing text counts as one
            return products.join(texts, products["text"].eqNullSafe(texts["_text"]), "left_semi")

        sharing = touched(IX.with_corpus_text(stored)).select("product_id").distinct()
        before = _newest(stored.join(sharing, "product_id", "left_semi")).filter(~F.col("removed")).drop("removed")
        before = stage(touched(IX.with_corpus_text(before)), "products-before")
        after = before.join(ids, "product_id", "left_anti").unionByName(new)
        gone = IX.copy_groups(before, self.k, self.stock_only).select("gid").distinct()
        groups = stage(IX.copy_groups(after, self.k, self.stock_only), "groups-new")
        segment = self._write_segment(now.folders[-1].seq + 1, changes, groups, gone, self.vocab())
        return self.publish(Version(now.number + 1, (*now.folders, segment), now.batch if batch is None else batch))

    def fold(self, fan: int | None = FAN) -> Version:
        """Publish a version in which the newest segments are one where ``fan`` or more are of like size (``versions.like_sized``).

        Without such a run the newest version stays. With ``fan`` None all segments become one.
        """
        now = self.version()
        segments = now.folders
        while n := like_sized(segments, fan):
            segments = (*segments[:-n], self._fold(segments[:-n], segments[-n:]))
        return now if segments == now.folders else self.publish(Version(now.number + 1, segments, now.batch))

    def _fold(self, old: tuple[Folder, ...], folded: tuple[Folder, ...]) -> Folder:
        seq = folded[-1].seq
        name = f"{seq:08d}-{uuid.uuid4().hex[:8]}"
        folder = f"{self.path}/segments/{name}"
        of = F.lit(seq).cast("long").alias("seq")
        products = _newest(self._table(folded, "products"))
        hidden = self._table(folded, "tombstones").select("gid").distinct()
        if not old:  # nothing is left to hide
            products, hidden = products.filter(~F.col("removed")), hidden.limit(0)
        products.select("*", of).write.parquet(f"{folder}/products")
        hidden.select("gid", of).write.parquet(f"{folder}/tombstones")
        self._live(folded, "members").select("*", of).write.parquet(f"{folder}/members")
        return self._write_postings(seq, name, self._live(folded, "postings"))

    def vacuum(self, keep: int = 1) -> None:
        """Delete segments that none of the newest ``keep`` versions names. Older versions cannot be read from then on."""
        for name in unused(self.spark, self.path, keep):
            remove(self.spark, f"{self.path}/segments/{name}")


def _newest(rows: DataFrame) -> DataFrame:
    return latest(rows, "product_id", "seq").drop("seq")


def create(products: DataFrame, path: str, k: int = K.TOP_CANDIDATES, stock_only: bool = True, vocab: DataFrame | None = None) -> IndexStore:
    """An index of ``products`` at ``path``, with the vocabularies fitted on them (unless given)."""
    spark = products.sparkSession
    texts = IX.with_corpus_text(products)
    (TF.fit_hybrid_vocab(texts, "text") if vocab is None else vocab).write.parquet(f"{path}/vocab")
    spark.createDataFrame([(k, stock_only)], "k int, stock_only boolean").coalesce(1).write.parquet(f"{path}/settings")
    store = IndexStore(spark, path, k, stock_only)
    groups = stage(IX.copy_groups(texts, k, stock_only), "copy-groups")
    none = spark.createDataFrame([], "gid long").select(F.col("gid").cast(groups.schema["gid"].dataType))
    first = store._write_segment(0, products.withColumn("removed", F.lit(False)), groups, none, store.vocab())
    store.publish(Version(0, (first,), None))
    return store


def open_store(spark: SparkSession, path: str) -> IndexStore:
    settings = spark.read.parquet(f"{path}/settings").first()
    return IndexStore(spark, path, settings["k"], settings["stock_only"])
