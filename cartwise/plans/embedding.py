"""Product vectors: a full build, and single or streamed additions with the fitted vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.functions import text as X
from cartwise.operators import tfidf as TF


def with_product_text(products: DataFrame) -> DataFrame:
    """Add ``text`` from name, desc (or description), category and brand; missing columns are empty."""
    have = set(products.columns)
    col = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    return products.withColumn(
        "text", X.product_text(col("name"), col("desc"), col("category"), col("brand"), col("description"))
    )


def fit_products(products: DataFrame) -> DataFrame:
    """Vocabulary of the product space, fitted on a catalogue."""
    return TF.fit_vocab(with_product_text(products), "text", TF.LEGACY)


def embed_products(products: DataFrame, vocab: DataFrame, key: str = "product_id") -> DataFrame:
    """Vector rows (key, entries) for all products; without a known term the entries are empty."""
    texts = with_product_text(products).select(key, "text")
    weights = TF.tfidf(texts, key, "text", vocab, TF.LEGACY.max_ngram, TF.LEGACY.sublinear)
    none = F.array().cast("array<struct<fid:int,weight:double>>")
    found = TF.vector_rows(weights, key)
    return texts.select(key).join(found, key, "left").withColumn("entries", F.coalesce("entries", none))
