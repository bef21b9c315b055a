"""TF-IDF vocabulary and weights as plain joins and aggregates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwise import constants as K
from cartwise.functions import text as X
from cartwise.session import stage


@dataclass(frozen=True)
class Space:
    """A vector space: how many terms, which n-grams, how term counts are damped."""

    name: str
    max_features: int
    sublinear: bool
    max_ngram: int
    first_fid: int = 0


LEGACY = Space("legacy", K.LEGACY_DIM, False, 1)
DENSE = Space("dense", K.DENSE_DIM, True, 1)
SPARSE = Space("sparse", K.SPARSE_DIM, True, 2, first_fid=K.DENSE_DIM)


def with_terms(docs: DataFrame, text: str, max_ngram: int) -> DataFrame:
    """Add the array column ``terms``: tokens, and pairs of neighbours if asked for."""
    out = docs.withColumn("terms", X.tokens(F.col(text)))
    if max_ngram == 2:
        out = out.withColumn("terms", F.concat("terms", X.bigrams(F.col("terms"))))
    return out


def term_stats(docs: DataFrame, text: str, max_ngram: int) -> DataFrame:
    """Occurrences (tf) and documents (df) per term.

    Each document emits its own distinct terms next to all terms, so that neither number needs a
    shuffle by document; what is shuffled are counts per term, already combined.
    """
    def entries(terms: Column, tf: int, df: int) -> Column:
        return F.struct(terms.alias("terms"), F.lit(tf).cast("long").alias("tf"), F.lit(df).cast("long").alias("df"))

    terms = with_terms(docs.select(text), text, max_ngram).select("terms")
    # the outer forms: the plain ones would test, and so find, the terms twice
    lists = terms.select(F.inline_outer(F.array(entries(F.col("terms"), 1, 0), entries(F.array_distinct("terms"), 0, 1))))
    rows = lists.select(F.explode_outer("terms").alias("term"), "tf", "df")
    return rows.filter(F.col("term").isNotNull()).groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def vocab_of_stats(stats: DataFrame, n_docs: Column, space: Space) -> DataFrame:
    """The most frequent terms with index, idf and space; ties go to the smaller term.

    Never longer than ``max_features``, which is why its order may be found in one task.
    """
    own = stats if space.max_ngram == 2 else stats.filter(~F.contains("term", F.lit(" ")))
    top = own.orderBy(F.desc("tf"), "term").limit(space.max_features)
    idx = F.row_number().over(Window.orderBy("term")) - 1
    return top.select(
        "term", (idx + space.first_fid).alias("fid"), F.lit(space.name).alias("space"),
        (F.log((1 + n_docs) / (1 + F.col("df"))) + 1).alias("idf"), "tf", "df",
    )


def fit_vocab(docs: DataFrame, text: str, space: Space) -> DataFrame:
    n_docs = docs.agg(F.count("*")).scalar()
    return vocab_of_stats(term_stats(docs, text, space.max_ngram), n_docs, space)


def fit_hybrid_vocab(docs: DataFrame, text: str) -> DataFrame:
    """Dense and sparse vocabulary from one pass; a word of both has a row in each."""
    n_docs = docs.agg(F.count("*")).scalar()
    stats = stage(term_stats(docs, text, SPARSE.max_ngram), "term-stats")
    return vocab_of_stats(stats, n_docs, DENSE).unionByName(vocab_of_stats(stats, n_docs, SPARSE))


def tfidf(docs: DataFrame, key: str, text: str, vocab: DataFrame, max_ngram: int, sublinear: bool) -> DataFrame:
    """L2-normalised weights (key, space, fid, weight) of the known terms of every document.

    Counts per document and known term are summed before they are placed by document, where the norm
    needs them; texts are not shuffled. The vocabulary is at most a few thousand rows by construction
    and is broadcast.
    """
    terms = with_terms(docs.select(key, text), text, max_ngram).select(key, F.explode_outer("terms").alias("term"))
    known = terms.join(F.broadcast(vocab.select("term", "fid", "space", "idf")), "term")
    counted = known.groupBy(key, "space", "fid").agg(F.count("*").alias("tf"), F.first("idf").alias("idf"))
    damped = 1 + F.log("tf") if sublinear else F.col("tf")
    raw = counted.withColumn("raw", damped * F.col("idf"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key, "space")))
    return raw.select(key, "space", "fid", (F.col("raw") / length).alias("weight"))


def hybrid_counts(docs: DataFrame, key: str, text: str, vocab: DataFrame) -> DataFrame:
    """Known terms of every document with their idf in both spaces: (key, tid, tf, dense_idf, sparse_idf).

    ``tid`` is the term's sparse index, or its dense one if it has no other. An idf is 0 where the
    space does not know the term.
    """
    of = lambda space, column: F.max(F.when(F.col("space") == space.name, F.col(column)))
    wide = vocab.groupBy("term").agg(
        F.coalesce(of(SPARSE, "fid"), of(DENSE, "fid")).alias("tid"),
        F.coalesce(of(DENSE, "idf"), F.lit(0.0)).alias("dense_idf"),
        F.coalesce(of(SPARSE, "idf"), F.lit(0.0)).alias("sparse_idf"),
    )
    terms = with_terms(docs.select(key, text), text, SPARSE.max_ngram).select(key, F.explode_outer("terms").alias("term"))
    known = terms.join(F.broadcast(wide), "term")  # as long as the two vocabularies
    return known.groupBy(key, "tid").agg(
        F.count("*").alias("tf"), F.first("dense_idf").alias("dense_idf"), F.first("sparse_idf").alias("sparse_idf"))


def hybrid_weights(counts: DataFrame, key: str) -> DataFrame:
    """Both spaces side by side: (key, tid, dense, sparse), one row per document and term of ``hybrid_counts``."""
    def unit(idf: str) -> Column:
        raw = (1 + F.log("tf")) * F.col(idf)
        return F.coalesce(F.try_divide(raw, F.sqrt(F.sum(raw * raw).over(Window.partitionBy(key)))), F.lit(0.0))

    return counts.select(key, "tid", unit("dense_idf").alias("dense"), unit("sparse_idf").alias("sparse"))


def hybrid_tfidf(docs: DataFrame, key: str, text: str, vocab: DataFrame) -> DataFrame:
    """Weights of both spaces of every document: (key, tid, dense, sparse)."""
    return hybrid_weights(hybrid_counts(docs, key, text, vocab), key)


def vector_rows(weights: DataFrame, key: str) -> DataFrame:
    """One row per document: its entries as an array of (fid, weight), ascending by index."""
    return weights.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("fid", "weight"))).alias("entries")
    )


def dense_array(entries: Column, dim: int) -> Column:
    """Entries of ``vector_rows`` as an array of ``dim`` numbers; null entries give zeros."""
    at = F.map_from_entries(F.coalesce(entries, F.array().cast("array<struct<fid:int,weight:double>>")))
    places = F.sequence(F.lit(0), F.lit(dim - 1))
    # the outer transform over one element builds the map once, not once per place
    filled = F.transform(F.array(at), lambda m: F.transform(
        places, lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0))))
    return F.get(filled, F.lit(0))


def sparse_columns(entries: Column) -> tuple[Column, Column]:
    """Entries as parallel arrays of indices and values."""
    return F.transform(entries, lambda e: e["fid"]), F.transform(entries, lambda e: e["weight"])
