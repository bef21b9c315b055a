"""Vectors by content: a text is embedded once, whatever documents hold it and however often they come.

The store keeps a vector per hash of a text, in folders that are only added to (``sources.versions``). A run
embeds the distinct texts that have no vector yet and hands all documents the vector of their text. The vectors
are those of the vocabulary the store was made with; another vocabulary is another store.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise.functions import text as X
from cartwise.operators import tfidf as TF
from cartwise.operators.upsert import content_groups, embed_copies, not_embedded
from cartwise.session import stage
from cartwise.sources.versions import Folder, Version, publish, read_version

ENTRIES = "array<struct<fid:int,weight:double>>"


@dataclass(frozen=True)
class Counts:
    """Of one run: documents, distinct texts among them, texts that were embedded, texts whose vector was there."""

    documents: int
    texts: int
    embedded: int
    reused: int


@dataclass(frozen=True)
class VectorStore:
    spark: SparkSession
    path: str
    space: TF.Space

    def version(self) -> Version:
        return read_version(self.spark, self.path)

    def vectors(self, version: Version | None = None) -> DataFrame:
        """text_hash, entries (fid, weight), seq of the run that embedded it."""
        folders = (version or self.version()).folders
        schema = f"text_hash string, entries {ENTRIES}, seq long"
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/vectors/{f.name}" for f in folders]) if folders else \
            self.spark.createDataFrame([], schema)

    def embed(self, docs: DataFrame, key: str, text: str) -> tuple[DataFrame, Counts]:
        """(key, text_hash, entries, seq) of all documents with a text, and what was done. Texts without a known term have no entries."""
        now = self.version()
        docs = docs.filter(F.col(text).isNotNull())
        # texts are written only where they are embedded; what was there is counted by hash
        todo = stage(not_embedded(content_groups(docs, key, text), self.vectors(now)).select("text_hash", text), "texts-to-embed")
        vocab = self.spark.read.parquet(f"{self.path}/vocab")
        weights = TF.tfidf(todo, "text_hash", text, vocab, self.space.max_ngram, self.space.sublinear)
        none = F.array().cast(ENTRIES)
        made = todo.select("text_hash").join(TF.vector_rows(weights, "text_hash"), "text_hash", "left").select(
            "text_hash", F.coalesce(F.col("entries").cast(ENTRIES), none).alias("entries"))
        seq = now.folders[-1].seq + 1 if now.folders else 0
        name = f"{seq:08d}-{uuid.uuid4().hex[:8]}"
        made.withColumn("seq", F.lit(seq).cast("long")).write.parquet(f"{self.path}/vectors/{name}")
        embedded = todo.count()
        after = publish(self.spark, self.path, Version(now.number + 1, (*now.folders, Folder(seq, name, embedded)), now.batch)) if embedded else now
        copies = docs.groupBy(X.content_hash(F.col(text)).alias("text_hash")).agg(F.count("*").alias("copies"))
        sizes = copies.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
        counts = Counts(sizes[1], sizes[0], embedded, sizes[0] - embedded)
        return embed_copies(docs, key, text, self.vectors(after)), counts



def create(spark: SparkSession, path: str, vocab: DataFrame, space: TF.Space) -> VectorStore:
    """An empty store for vectors of ``vocab``."""
    vocab.write.parquet(f"{path}/vocab")
    publish(spark, path, Version(0, (), None))
    return VectorStore(spark, path, space)
